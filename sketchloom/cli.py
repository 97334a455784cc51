"""Command line: search for programs on a table, report a program's errors, export it.

python -m sketchloom.cli search --path T.parquet --item col [--order col ...] --out DIR
python -m sketchloom.cli report --path T.parquet --item col --candidates C.jsonl"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .evaluate import Workload
from .operators.metrics import error_report, error_summary, exact_frequency
from .operators.sketch import build_cells, estimates, stream_of
from .plans.program import classify
from .search.immigrants import Incubator
from .search.islands import Config, champions, holdout, program_of, search
from .sources.candidates import export_program, ingest, read_candidates
from .sources.traces import write_results


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sketchloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "report"):
        s = sub.add_parser(name)
        s.add_argument("--path", required=True)
        s.add_argument("--item", required=True)
        s.add_argument("--order", nargs="*", default=[])
        s.add_argument("--candidates")
    s = sub.choices["search"]
    s.add_argument("--out", required=True)
    s.add_argument("--items", type=int, default=10_000, help="items of the evaluation stream")
    s.add_argument("--holdout-items", type=int, default=6_000)
    for f, kind in (("population", int), ("islands", int), ("rounds", int), ("children", int), ("migrants", int), ("seed", int), ("risk_weight", float)):
        s.add_argument(f"--{f.replace('_', '-')}", dest=f, type=kind, default=getattr(Config, f))
    return p


def first_items(stream, n: int, skip: int = 0) -> list[str]:
    """A bounded evaluation stream in order."""
    return [r.e for r in stream.orderBy("seq").limit(skip + n).select("e").collect()][skip:]


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    stream = stream_of(spark.read.parquet(a.path), a.item, *(a.order or [a.item]))
    taken, refused = ingest(read_candidates(spark, a.candidates)[0]) if a.candidates else ([], {})
    if a.command == "report":
        freq = exact_frequency(stream)
        for c in taken:
            r = error_report(freq, estimates(freq.select("e"), build_cells(stream, c.program), c.program))
            s = error_summary(r).first()
            print(f"{classify(c.program).overall} n={s.n} sae={s.sae:.1f} aae={s.aae:.3f} {c.program.query.text()}")
            r.orderBy(F.desc("actual"), "e").show(30, False)
        return
    cfg = Config(**{f: getattr(a, f) for f in ("population", "islands", "rounds", "children", "migrants", "seed", "risk_weight")})
    w = Workload.of(first_items(stream, a.items))
    islands = search(spark, w, cfg)
    waiting = Incubator()
    for c in taken:
        waiting.consider(c, islands, w, cfg)
    waiting.promote(islands, cfg.migrants)
    ranked = holdout(champions(islands, 5), Workload.of(first_items(stream, a.holdout_items, a.items) or first_items(stream, a.items)))
    rows = [(*m.texts, m.fit, m.err, err) for m, err in ranked]
    table = spark.createDataFrame(rows, "init_dex string, update string, query string, fit double, err double, holdout_err double")
    write_results(table, a.out, {"seed": a.seed, "holdout_err": ranked[0][1], "refused": refused})
    spark.createDataFrame([(export_program(program_of(ranked[0][0])),)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out}/program")
    print(f"best holdout error {ranked[0][1]:.1f}: {ranked[0][0].texts}")


if __name__ == "__main__":
    main()
