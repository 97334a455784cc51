"""Readers, workloads, candidates, streaming ingest, evaluation and search."""

import json
import pickle
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from programs import PROGRAMS
from pyspark.sql import functions as F

from sketchloom.evaluate import RUN_FAILED, Workload, evaluate, evaluate_over, evaluate_programs, judged, like_absent, stored_stream, stored_workload, workload_of
from sketchloom.operators import cases as C
from sketchloom.operators.sketch import build_cells
from sketchloom.plans.analyze import structural_penalty
from sketchloom.plans.columns import Columns
from sketchloom.plans.compiled import Compiled, compiled
from sketchloom.plans.grammar import BUSY, MAIN
from sketchloom.plans.nodes import Call, Const
from sketchloom.plans.program import Program
from sketchloom.plans.semantics import Machine
from sketchloom.search.islands import Config, Island, Member, champions, dump, holdout, load, rescale, search, typical_error
from sketchloom.search.trees import Trees
from sketchloom.sources import candidates as K
from sketchloom.sources import traces as T
from sketchloom.sources.candidates import SAFE
from sketchloom.streaming.ingest import streaming_cells, streaming_fold


def test_npy_files(spark, tmp_path):
    (tmp_path / "univ2_npy").mkdir()
    np.save(tmp_path / "b.flowid.npy", np.array(["x", "y", "x"]))
    np.save(tmp_path / "univ2_npy" / "a.npy", np.array([b"q\xff", b"r"]))
    np.save(tmp_path / "univ2_npy" / "omega.npy", np.array([1]))
    paths = T.discover(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["b.flowid.npy", "a.npy"]
    rows = sorted((r.file[-5:], r.position, r.e) for r in T.read_npy(spark, paths).collect())
    assert rows == [("a.npy", 0, "q"), ("a.npy", 1, "r"), ("d.npy", 0, "x"), ("d.npy", 1, "y"), ("d.npy", 2, "x")]
    assert T.read_npy(spark, []).count() == 0 and T.discover(spark, str(tmp_path / "none")) == []


def test_sampling_takes_even_shares(spark):
    rows = spark.range(300).select(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), (F.col("id") / 3).cast("long").alias("position"), F.col("id").cast("string").alias("e"))
    took = T.take_per_file(rows, 30, 3)
    assert {r.file: r.n for r in took.groupBy("seq.file").agg(F.count("*").alias("n")).collect()} == {"f0": 10, "f1": 10, "f2": 10}
    few = T.take_per_file(rows.filter("file = 'f0' or position < 4"), 60, 3)
    assert few.count() == 60
    a, b = (sorted(r.e for r in T.take_per_file(rows.repartition(n), 30, 3, shuffle=True, seed=4).collect()) for n in (1, 5))
    assert a == b and T.load_sample(rows, 30, 3, True, 1).count() == 30


def test_proxies(spark):
    pool = spark.range(4000).select(F.col("id").cast("string").alias("e"))
    for mode in T.PROXIES:
        s = [r.e for r in T.proxy_stream(pool, mode, 2000, seed=1).orderBy("seq").collect()]
        u, hot = T.proxy_base(mode, 2000, 4000)
        n = Counter(s)
        assert len(s) == 2000 and len(n) == u and sum(v > 1 for v in n.values()) <= hot
    top = Counter(r.e for r in T.proxy_stream(pool, "proxy_head", 2000, seed=1).collect()).most_common()
    assert top[0][1] > 3 * top[35][1]
    assert T.proxy_stream(pool, "other", 10).count() == 10


def test_fixed_stream_and_logs(spark, tmp_path):
    path = T.fixed_path(str(tmp_path), "real", 10, 1, 0, False, 3, "proxy_head")
    made = []
    make = lambda: made.append(1) or T.synthetic_words(spark, 50)
    a, b = (sorted(T.fixed_stream(spark, path, make).collect()) for _ in range(2))
    assert a == b and made == [1]
    T.log_events(spark.createDataFrame([("start", 1)], "event string, n int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 1
    T.write_results(spark.range(2), str(tmp_path / "out"), {"seed": 1})
    assert spark.read.text(str(tmp_path / "out/manifest")).first().value == '{"seed": 1}'


GOOD = {"mode": "team", "init_dex": K.SAFE["init_dex"], "update": "base(update_count(e,0,1), update_count(e,1,2), update_count(e,2,1))", "query": K.SAFE["query"]}


def test_candidates(spark, tmp_path):
    lines = [json.dumps(GOOD), "not json", json.dumps(GOOD), json.dumps({"mode": "mechanism_team", "mechanism_schema": {"mechanism_family": "layered_promotion"}}), json.dumps({"mode": "single_tree", "target": "query", "expr": "```python\nquery = lambda e: base_sel(0, query_date(e,0), query_date(e,1), query_date(e,2)\n```"})]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    objects, bad = K.read_candidates(spark, str(tmp_path / "c.jsonl"))
    assert len(objects) == 4 and len(bad) == 1
    taken, refused = K.ingest(objects)
    assert len(taken) == 3 and refused == {"duplicate": 1}
    assert taken[2].fixes == ["query: unwrapped"] and taken[2].program.query.text().startswith("base_sel(0")
    assert K.load_objects([json.dumps({"candidates": [GOOD]})])[0] == [GOOD]
    broken = K.materialize(GOOD | {"update": "base(update_state(e, 0, 1), nonsense, 0)"})
    assert broken.program.update.text() == K.SAFE["update"] and "replaced" in broken.fixes[0]
    assert K.program_table(spark, taken).count() == 3 and K.describe(spark, taken).count() == 3
    assert K.Provider().fetch({}) == [] and K.Provider(lambda r: [GOOD]).fetch({}) == [GOOD]
    compile(K.export_program(taken[0].program), "export", "exec")


def test_cases_and_evaluation_items(spark):
    cases = spark.createDataFrame([("a", 1, 5.0, "x"), ("a", 1, 7.0, "y"), ("b", 2, 6.0, "x"), ("", 3, 9.0, "x"), ("c", 4, -1.0, None)], "item string, expected int, score double, bucket string")
    assert [(r.item, r.score, r.bucket) for r in C.hardest(cases, 5).collect()] == [("a", 7.0, "y"), ("b", 6.0, "x"), ("c", 0.0, "generic")]
    merged = C.merge_cases(cases, cases.limit(0), 2).collect()
    assert [round(r.score, 3) for r in merged] == [5.95, 5.1]
    freq = spark.createDataFrame([(k, n) for n, k in enumerate("zyxwv", 1)], "e string, cnt long")
    items = C.evaluation_items(freq, C.hardest(cases, 5), 4, 0.5).collect()
    assert [r.e for r in items][:2] == ["v", "w"] and {r.e for r in items[2:]} <= {"a", "b", "c"}
    bank = spark.createDataFrame([(0, "a"), (1, "n")], "i long, e string")
    assert [r.e for r in C.absent_items(C.hardest(cases, 1), bank, 3).collect()] == ["a", "n"]


@pytest.mark.parametrize("how", ["cells", "fold"])
def test_streaming_equals_batch(spark, tmp_path, how):
    program = PROGRAMS["triple" if how == "cells" else "cycle"][1]
    rows = [(k, f"k{k * k % 13}", "s") for k in range(120)]
    table = spark.createDataFrame(rows, "o long, e string, sketch string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    made = streaming_cells(stream, program) if how == "cells" else streaming_fold(stream, program, "sketch", "o").drop("sketch_id")
    name = f"live_{how}"
    q = made.writeStream.format("memory").queryName(name).outputMode("complete" if how == "cells" else "update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    want = build_cells(table.select(F.col("o").alias("seq"), "e"), program)
    assert sorted(map(tuple, spark.table(name).select("z", "x", "y", "cnt", "ovf").collect())) == sorted(map(tuple, want.collect()))


ITEMS = [f"k{(i * i) % 23}" for i in range(300)]


def test_evaluation(spark):
    w = Workload.of(ITEMS, absent=8)
    good = evaluate(PROGRAMS["triple"][1], w, hardest=2)
    assert good.failed is None and good.err >= good.penalty >= 0 and len(good.case_vec) == 7 and len(good.hard) == 6
    assert evaluate(PROGRAMS["constant write"][1], w).err > good.err
    assert evaluate_over(PROGRAMS["triple"][1], [(1.0, w), (1.0, w)]) == good.case_vec
    c = [K.materialize(GOOD), K.materialize(GOOD | {"query": K.SAFE["query"].replace("sel(2", "sel(1")})]
    got = {r.pid: r for r in evaluate_programs(K.program_table(spark, c), w).collect()}
    assert got["p0000"].err == evaluate(c[0].program, w).err and got["p0000"].fingerprint and got["p0001"].failed is None
    bad = spark.createDataFrame([("x", "list_3(1)", "base(0,0,0)", "base_sel(0,1,2,3)")], "pid string, init_dex string, update string, query string")
    assert evaluate_programs(bad, w).first().failed == "parse"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_stored_stream(spark, n):
    """The same workload and results as of a list, and no items within what travels with the tasks."""
    items = [f"item{k * k % 97}" + "__absent__1" * (k % 50 == 0) for k in range(n)]
    rows = spark.createDataFrame([(k, e) for k, e in enumerate(items)], "seq long, e string").repartition(5)
    held, stored = Workload.of(items, absent=8), stored_workload(rows, absent=8)
    assert [list(s) for s in stored.stages] == held.stages and [len(s) for s in stored.stages] == [len(s) for s in held.stages]
    assert stored.absent == held.absent and not any(isinstance(s, list) for s in stored.stages)
    if n == 1000:
        programs = K.program_table(spark, [K.Candidate(PROGRAMS[k][1]) for k in ("triple", "constant write")])
        assert sorted(evaluate_programs(programs, stored).collect()) == sorted(evaluate_programs(programs, held).collect())


def test_compiled_programs_do_what_the_machine_does():
    """Results, cells, flags and writes of random programs of both dialects, with counters that overflow or end at 0."""
    w, ordered = Workload.of(ITEMS, absent=8), set()
    huge = Program.parse(SAFE["init_dex"], "base(update_count(e, 0, 4294967000), update_count(e, 1, -1), updatecount_if(gt(query_count(e, 0), 5), e, 2, 4294967290))", SAFE["query"])
    still = Program.parse(SAFE["init_dex"], "base(update_count(e, 0, 100000000), update_count(e, 1, -1), updatecount_if(gt(3, 2), e, 2, 4294967290))", SAFE["query"])
    programs = [huge, still, *(p for _, p in PROGRAMS.values())]
    for dialect in (MAIN, BUSY):
        trees = Trees(random.Random(5), dialect)
        for k in range(60):
            parts = [trees.ramped(x) for x in ("init_dex", "update", "query")]
            if dialect is MAIN and k % 2:
                parts[0] = dialect.init.parse(SAFE["init_dex"])
            programs.append(Program(*parts, dialect))
    for p in programs:
        fast, machine, rows = compiled(p), p.machine(), []
        if fast is None:
            continue
        ordered.add(fast.ordered)
        for k, items in enumerate(w.stages):
            w.counted().update(fast, k, rows)
            for e in items:
                machine.update(e)
            assert [fast.query(e) for e in ITEMS[:23]] == [machine.query(e) for e in ITEMS[:23]], p
        g = p.dialect.geometry
        place = lambda c, g=g: (c // (g.rows * g.cols), c // g.cols % g.rows, c % g.cols)
        assert {place(c): n for c, n in enumerate(fast.count) if n} == {c: n for c, n in machine.count.items() if n}, p
        assert {place(c) for c, x in enumerate(fast.flag) if x} == {c for c, x in machine.flag.items() if x}, p
        assert (fast.writes, fast.reads) == (machine.writes, machine.reads), p
    assert ordered == {True, False}


def test_evaluation_needs_no_machine(monkeypatch):
    """Items are not run one by one through the sequential machine, which took most of a search's time."""
    w, p = Workload.of(ITEMS, absent=8), PROGRAMS["triple"][1]
    want = evaluate(p, w, hardest=2)
    monkeypatch.setattr(Machine, "update", lambda self, e: 1 / 0)
    assert evaluate(p, Workload.of(ITEMS, absent=8), hardest=2) == want and want.failed is None


def test_ordered_programs_run_by_columns(monkeypatch):
    """Where the order matters, items are not run one by one either; nor is any hashed again for another program."""
    texts = ["base(updatecount_if(lt(query_count(e, 1), 3), e, 0, 2), update_count(e, 1, 1), write_count(str_slice(e, 0, 5), query_count(e, 0), safe_mul(query_count(e, 0), 70000)))",
             "base(write_count(e, 0, safe_sub(7, query_count(e, 0))), update_state(e, 1, gt(query_count(e, 0), 3)), update_count(e, 2, 4294967290))"]
    programs = [Program.parse(SAFE["init_dex"], t, SAFE["query"]) for t in texts]
    items = [f"item{k * k % 97}" for k in range(700)]
    w = Workload.of(items, absent=8)
    want = [judged(p.machine(), w, structural_penalty(p).penalty, [0.0] * 7, 3) for p in programs]
    assert all(compiled(p).ordered for p in programs)
    w = Workload.of(items, absent=8)
    for name in ("update_each", "update_counts"):
        monkeypatch.setattr(Compiled, name, lambda self, *a: 1 / 0)
    assert [judged(Columns(p, compiled(p), w.counted().keys), w, structural_penalty(p).penalty, [0.0] * 7, 3) for p in programs] == want
    monkeypatch.setattr(Machine, "update", lambda self, e: 1 / 0)
    assert [evaluate(p, w).err for p in programs] == [x.err for x in want]


def test_columns_keep_every_digit():
    """Numbers beyond 64 bits, residues of sums of digests, addresses and keys that depend on the state."""
    w, trees = Workload.of(ITEMS, absent=8), Trees(random.Random(11))
    for k in range(60):
        parts = [trees.ramped(x, 3, 5) for x in ("init_dex", "update", "query")]
        p = Program(parts[0] if k % 2 else MAIN.init.parse(SAFE["init_dex"]), *parts[1:])
        want = judged(p.machine(), w, 0.0, [0.0] * 7, 2)
        assert judged(Columns(p, compiled(p), w.counted().keys), w, 0.0, [0.0] * 7, 2) == want, p


def test_failures_are_those_of_the_machine():
    p = PROGRAMS["triple"][1]
    args = p.query.args
    bad = replace(p, query=Call("base_sel", (Const(1), *args[1:3], Call("safe_add", (args[3], Const(10**400))))))
    assert evaluate(p, Workload.of(ITEMS, absent=8)).failed is None and evaluate(bad, Workload.of(ITEMS, absent=8)).failed == "run: OverflowError"


def test_search_over_a_stored_stream(spark):
    """The same islands as over a list, without items in what travels with the tasks."""
    cfg = Config(population=6, islands=2, rounds=1, children=6, seed=3, stop_at=-1)
    items = [f"item{k * k % 97}" + "__absent__1" * (k % 50 == 0) for k in range(700)]
    rows = spark.createDataFrame(list(enumerate(items)), "seq long, e string").repartition(3)
    stored, taken = stored_stream(rows), like_absent(rows)
    first, rest = workload_of(replace(stored, stop=560), taken), workload_of(replace(stored, start=560), taken)
    held = Workload.of(items[:560])
    assert (first.absent, rest.absent) == (held.absent, Workload.of(items[560:]).absent)
    assert [list(s) for s in rest.stages] == Workload.of(items[560:]).stages
    assert [dump(i) for i in search(spark, first, cfg)] == [dump(i) for i in search(spark, held, cfg)]
    first.counted()
    assert b"item1" not in pickle.dumps(replace(first, absent=[])) and b"item1" not in pickle.dumps(first.stages)


def test_search_is_repeatable(spark):
    cfg = Config(population=6, islands=2, rounds=2, children=6, seed=3, stop_at=-1)
    w = Workload.of(ITEMS, absent=4)
    a, b = search(spark, w, cfg), search(spark, w, cfg, )
    assert [dump(i) for i in a] == [dump(i) for i in b] and load(dump(a[0])) == a[0]
    best = champions(a, 3)
    assert best[0].err == min(i.best.err for i in a) or best[0].fit >= best[-1].fit
    ranked = holdout(best, Workload.of(ITEMS[::-1], absent=4))
    assert len(ranked) == len(best)


def test_typical_error_sets_fitness(spark):
    cfg = Config(population=6, islands=2, rounds=1, children=4, seed=3, stop_at=-1)
    islands = search(spark, Workload.of(ITEMS, absent=4), cfg)
    members = [m for i in islands for m in i.members]
    told = {round(m.err * m.fit / (1 - m.fit), 3) for m in members if 0 < m.fit < 1 and m.err > 0}
    assert len(told) == 1 and told.pop() > 1
    failed = Member(("", "", ""), 0.5, RUN_FAILED, [], 0, "x")
    rescale([Island(0, [failed])], 10.0)
    assert failed.fit == 0.0 and typical_error([Island(0, [failed])]) == 1.0


def test_plain_proxy_does_not_depend_on_partitions(spark):
    pool = spark.createDataFrame([(f"k{i % 40}",) for i in range(200)], "e string")
    a, b = ([r.e for r in T.proxy_stream(pool.repartition(n), "plain", 90, seed=2).collect()] for n in (1, 5))
    assert a == b and len(a) == 90 and T.proxy_stream(pool, "plain", 500).count() == 200
