"""Gates for outside candidates, quotas, caches, and the command line."""

import json

from sketchloom import cli
from sketchloom.evaluate import Workload
from sketchloom.operators import population as P
from sketchloom.plans.analyze import MECHANISM_PROGRAMS
from sketchloom.search.immigrants import Gates, Incubator
from sketchloom.search.islands import Config, Island, advance
from sketchloom.sources import traces as T
from sketchloom.sources.candidates import SAFE, materialize

ITEMS = [f"k{(i * i) % 23}" for i in range(300)]


def candidate(family):
    u, q = MECHANISM_PROGRAMS[family]
    return materialize({"mode": "team", "init_dex": SAFE["init_dex"], "update": u, "query": q})


def test_gates_and_promotion():
    w, cfg = Workload.of(ITEMS, absent=4), Config(population=6, children=4, seed=1)
    islands = [advance(Island(k), w, cfg) for k in range(2)]
    box = Incubator(Gates(quality=1e9, family_share=1.1, mechanism_share=1.1))
    assert box.consider(materialize({"mode": "team"}), islands, w, cfg) == "duplicate"
    bad = materialize({"mode": "single_tree", "target": "query", "expr": "base_sel(0, 1, 2, 3)"})
    assert box.consider(bad, islands, w, cfg) == "structure"
    said = [box.consider(candidate(f), islands, w, cfg) for f in ("adaptive_count", "layered_promotion", "witness_gated")]
    assert "waiting" in said
    n = len(box.waiting)
    moved = box.promote(islands, 1)
    assert moved <= 1 and len(box.waiting) == n - moved
    for _ in range(5):
        box.promote(islands, 0)
    assert not box.waiting and box.refused["duplicate"] == 1
    strict = Incubator(Gates(quality=0.0))
    assert strict.consider(candidate("adaptive_count"), islands, w, cfg) in ("quality", "same function")


def test_tables_of_programs(spark):
    programs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "pid string, key string")
    done = spark.createDataFrame([("y",)], "key string")
    assert sorted(r.pid for r in P.unseen(programs, done, "key").collect()) == ["a", "d"]
    failed = spark.createDataFrame([("b1",), ("b1",), ("b2",)], "basin string")
    own = spark.createDataFrame([("a", "b1"), ("b", "b2")], "pid string, basin string")
    assert [r.pid for r in P.blocked(own, failed, 2).collect()] == ["b"]
    rows = [{"score": s, "family": f, "motif": m} for s, f, m in ((9, "a", 1), (8, "a", 1), (7, "a", 2), (6, "b", 3))]
    assert [r["score"] for r in P.quota_trim(rows, 2, 1, 1)] == [9, 6] and len(P.quota_trim(rows, 4, 1, 1)) == 4
    pop = spark.createDataFrame([(0, 1.0, 5.0), (0, 0.5, 7.0), (1, 0.1, 9.0)], "island int, fit double, err double")
    assert {r.island: (r.n, r.median_err) for r in P.island_stats(pop).collect()} == {0: (2, 6.0), 1: (1, 9.0)}


def test_load_proxy(spark):
    rows = spark.range(600).selectExpr("concat('f', id % 2) as file", "cast(id / 2 as long) as position", "cast(id as string) as e")
    assert T.load_proxy(rows, "proxy_balanced", 100, 2, least_distinct=10, retries=2).count() == 100


def test_command_line(spark, tmp_path, capsys):
    data, out = str(tmp_path / "t.parquet"), str(tmp_path / "out")
    spark.createDataFrame([(i, e) for i, e in enumerate(ITEMS)], "o long, e string").write.parquet(data)
    u, q = MECHANISM_PROGRAMS["cms_like"]
    (tmp_path / "c.jsonl").write_text(json.dumps({"mode": "team", "init_dex": SAFE["init_dex"], "update": u, "query": q}))
    cli.main(["report", "--path", data, "--item", "e", "--order", "o", "--candidates", str(tmp_path / "c.jsonl")])
    assert "C0 n=" in capsys.readouterr().out
    cli.main(["search", "--path", data, "--item", "e", "--order", "o", "--out", out, "--items", "200", "--holdout-items", "100", "--population", "4", "--islands", "2", "--rounds", "1", "--children", "2"])
    assert spark.read.parquet(f"{out}/results").count() >= 1
    compile("\n".join(r.value for r in spark.read.text(f"{out}/program").collect()), "program", "exec")
