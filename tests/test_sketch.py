"""Plans against the sequential machine, cell by cell and estimate by estimate."""

import pytest
from programs import PROGRAMS

from sketchloom.operators.sketch import build_cells, estimates, fold_cells, merge_cells, stream_of
from sketchloom.plans.program import classify

ITEMS = [f"Customer#{(k * k * 7 + k) % 41:09d}" for k in range(400)] + ["", "é|ü", "日本語テキスト", "x"] * 3


@pytest.fixture(scope="module")
def stream(spark):
    return spark.createDataFrame(list(enumerate(ITEMS)), "seq long, e string").repartition(3).cache()


@pytest.mark.parametrize("name", PROGRAMS)
def test_plan_equals_machine(spark, stream, name):
    kind, program = PROGRAMS[name]
    assert classify(program).overall == kind, classify(program)
    machine = program.machine()
    for e in ITEMS:
        machine.update(e)
    cells = build_cells(stream, program).cache()
    got = {(r.z, r.x, r.y): (r.cnt, r.ovf) for r in cells.collect() if r.cnt or r.ovf}
    want = {c: (machine.count.get(c, 0), bool(machine.flag.get(c))) for c in machine.count.keys() | machine.flag.keys()}
    assert got == {c: v for c, v in want.items() if any(v)}
    keys = stream.select("e").distinct()
    est = {r.e: r.est for r in estimates(keys, cells, program).collect()}
    assert est == {e: machine.query(e) for e in set(ITEMS)}


@pytest.mark.parametrize("name", [n for n, (kind, _) in PROGRAMS.items() if kind in ("C3", "C4")])
def test_tied_order(spark, name):
    """Items of equal order follow each other by name, and equal rows count each."""
    rows = [(k // 3, ITEMS[(k * 5) % 23]) for k in range(90)]
    program = PROGRAMS[name][1]
    machine = program.machine()
    for _, e in sorted(rows, key=lambda r: (r[0], r[1].encode())):
        machine.update(e)
    want = {c: (machine.count.get(c, 0), bool(machine.flag.get(c))) for c in machine.count.keys() | machine.flag.keys()}
    stream = stream_of(spark.createDataFrame(rows, "t long, item string").repartition(3), "item", "t")
    got = {(r.z, r.x, r.y): (r.cnt, r.ovf) for r in build_cells(stream, program).collect() if r.cnt or r.ovf}
    assert got == {c: v for c, v in want.items() if any(v)}
    with pytest.raises(ValueError):
        build_cells(stream_of(stream, "e"), program)


def test_no_order_is_needed_for_sums(spark, stream):
    program = PROGRAMS["triple"][1]
    assert sorted(build_cells(stream_of(stream, "e"), program).collect()) == sorted(build_cells(stream, program).collect())


def test_merge_adds_cells(spark, stream):
    program = PROGRAMS["triple"][1]
    parts = [build_cells(stream.filter(f"seq % 2 = {k}"), program) for k in (0, 1)]
    assert sorted(merge_cells(*parts).collect()) == sorted(build_cells(stream, program).collect())


def test_sketches_fold_apart(spark, stream):
    program = PROGRAMS["conservative"][1]
    both = stream.selectExpr("seq", "e", "cast(seq % 2 as string) as id")
    got = fold_cells(both, program, by="id").collect()
    for k in ("0", "1"):
        own = fold_cells(both.filter(f"id = '{k}'"), program).collect()
        assert sorted(tuple(r)[1:] for r in got if r.sketch_id == k) == sorted(map(tuple, own))


def test_empty_stream(spark):
    empty = spark.createDataFrame([], "seq long, e string")
    for name in ("triple", "gate", "falling", "cycle"):
        assert build_cells(empty, PROGRAMS[name][1]).count() == 0
