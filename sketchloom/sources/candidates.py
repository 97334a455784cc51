"""Candidate programs from text: reading, unwrapping, parsing, repair, and validation."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.analyze import MECHANISM_PROGRAMS, families, legality, metadata, numeric_risk, structural_penalty
from ..plans.grammar import MAIN, Dialect, Grammar, ProgramError
from ..plans.nodes import Node
from ..plans.program import Program, classify

#: Stand-ins where a part cannot be read: the salted layout, plain counting and the median. The layout's
#: salts decide which cells a stored program addresses, so they are those of the evaluated system.
SAFE = {
    "init_dex": "list_3(select_hash(0, e), safe_mod(hash_salt(0, e, 41), 102), 102, select_hash(1, e), safe_mod(hash_salt(1, e, 48), 102), 102, select_hash(2, e), safe_mod(hash_salt(2, e, 61), 102), 102)",
    "update": MECHANISM_PROGRAMS["cms_like"][0],
    "query": "base_sel(2, query_date(e, 0), query_date(e, 1), query_date(e, 2))",
}
PARTS = tuple(SAFE)
ROOTS = {"init_dex": "list_3", "update": "base", "query": "base_sel"}
PROGRAM_SCHEMA = "pid string, mode string, init_dex string, update string, query string, rationale string, source string"


def load_objects(lines: Iterable[str]) -> tuple[list[dict], list[str]]:
    """Objects of JSON lines, or of one JSON text (a list, an object with candidates, one object); and what is unreadable."""
    lines = list(lines)
    whole = "\n".join(lines).strip()
    try:
        found = json.loads(whole) if whole else []
        found = found.get("candidates", [found]) if isinstance(found, dict) else found
        return [x for x in found if isinstance(x, dict)], []
    except ValueError:
        pass
    out, bad = [], []
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            x = json.loads(line)
            out += [x] if isinstance(x, dict) else []
        except ValueError as why:
            bad.append(f"line {n}: {why}")
    return out, bad


def read_candidates(spark: SparkSession, path: str) -> tuple[list[dict], list[str]]:
    """From any path that Spark reads; candidate files are small."""
    return load_objects(r.value for r in spark.read.text(path, wholetext=not path.endswith(".jsonl")).collect())


def unwrap(text: str, root: str) -> str:
    """The balanced call of root within text that may have fences, a name and an equals sign or a lambda before it."""
    text = re.sub(r"```\w*", "", text).strip()
    at = text.find(root + "(")
    if at < 0:
        return text
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0 and text[i] == ")":
            return text[at : i + 1]
    return text[at:] + ")" * depth


def read_part(part: str, text: str, grammar: Grammar, fixes: list[str]) -> Node:
    """The strict reading, else one after repair: unwrapped, with 0 and 1 for bool, else the safe stand-in."""
    try:
        return grammar.parse(text)
    except ProgramError as first:
        reason = str(first)
    try:
        notes: list[str] = []
        node = grammar.parse(unwrap(text, ROOTS[part]), coerce=True, fixes=notes)
        fixes += [f"{part}: {n}" for n in notes or ["unwrapped"]]
        return node
    except ProgramError:
        fixes.append(f"{part}: replaced ({reason})")
        return grammar.parse(SAFE[part])


@dataclass
class Candidate:
    program: Program
    mode: str = "team"
    rationale: str = ""
    source: str = "offline"
    fixes: list[str] = field(default_factory=list)

    def row(self, pid: str) -> tuple:
        p = self.program
        return pid, self.mode, p.init.text(), p.update.text(), p.query.text(), self.rationale, self.source


def materialize(obj: dict, dialect: Dialect = MAIN, base: Program | None = None, source: str = "offline") -> Candidate:
    """The program of a candidate object: a team of three parts, a single tree set into a base team, or a mechanism."""
    fixes: list[str] = []
    mode = str(obj.get("mode", "team"))
    texts = dict(SAFE)
    if base is not None:
        texts |= {"init_dex": base.init.text(), "update": base.update.text(), "query": base.query.text()}
    if mode == "single_tree":
        texts[str(obj.get("target"))] = str(obj.get("expr", ""))
    elif mode == "mechanism_team":
        family = str((obj.get("mechanism_schema") or {}).get("mechanism_family", "cms_like"))
        texts["update"], texts["query"] = MECHANISM_PROGRAMS.get(family, MECHANISM_PROGRAMS["cms_like"])
    else:
        texts |= {p: str(obj[p]) for p in PARTS if obj.get(p)}
    grammars = {"init_dex": dialect.init, "update": dialect.update, "query": dialect.query}
    nodes = [read_part(p, texts[p], grammars[p], fixes) for p in PARTS]
    return Candidate(Program(*nodes, dialect), mode, str(obj.get("rationale", "")), source, fixes)


def validate(c: Candidate, known: set[tuple[str, str, str]] = frozenset(), most_risk: float = 6.0) -> str | None:
    """Why a candidate is not taken, or None."""
    p = c.program
    for part, node in (("init", p.init), ("update", p.update), ("query", p.query)):
        if legality(part, node):
            return "illegal"
    if structural_penalty(p).cut:
        return "structure"
    if p.canonical_key() in known:
        return "duplicate"
    if numeric_risk(p)[0] > most_risk:
        return "risk"
    return None


def ingest(objects: Iterable[dict], dialect: Dialect = MAIN, known: set = frozenset(), source: str = "offline") -> tuple[list[Candidate], dict[str, int]]:
    """Valid candidates without repeats, and how many were refused for which reason."""
    taken, seen, refused = [], set(known), {}
    for obj in objects:
        c = materialize(obj, dialect, source=source)
        reason = validate(c, seen)
        if reason:
            refused[reason] = refused.get(reason, 0) + 1
            continue
        seen.add(c.program.canonical_key())
        taken.append(c)
    return taken, refused


class Provider:
    """Where further candidates come from: a callable that is asked with a report. None is configured by default."""

    def __init__(self, ask: Callable[[dict], list[dict]] | None = None, retries: int = 2):
        self.ask, self.retries = ask, retries

    def fetch(self, report: dict) -> list[dict]:
        for k in range(self.retries + 1):
            if self.ask is None:
                return []
            try:
                return list(self.ask(report))
            except Exception:
                if k == self.retries:
                    raise
        return []


def program_table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    return spark.createDataFrame([c.row(f"p{i:04d}") for i, c in enumerate(candidates)], PROGRAM_SCHEMA)


def describe(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    """One row of metadata per program: families, schemas, distances, plan class, risk, penalty."""
    rows = []
    for i, c in enumerate(candidates):
        m = metadata(c.program)
        rows.append((f"p{i:04d}", m["family_tag"], *families(c.program).__dict__.values(), m["architecture"]["arch_type"], m["mechanism"]["mechanism_family"], m["mechanism_distance"], classify(c.program).overall, m["numeric_risk"], structural_penalty(c.program).penalty, m["lint"]))
    return spark.createDataFrame(rows, "pid string, family_tag string, init_family string, update_family string, query_family string, arch_type string, mechanism_family string, mechanism_distance double, plan string, numeric_risk double, penalty double, lint array<string>")


def export_program(p: Program, name: str = "sketch") -> str:
    """A script that builds this sketch over a table and reports its most frequent items."""
    s = p.simplified()
    return f'''"""Sketch {name}: plan class {classify(p).overall}."""
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sketchloom.operators.metrics import error_report, exact_frequency
from sketchloom.operators.sketch import Sketch, stream_of
from sketchloom.plans.grammar import {"MAIN" if s.dialect.name == "wide" else "BUSY"} as DIALECT
from sketchloom.plans.program import Program

INIT = {s.init.text()!r}
UPDATE = {s.update.text()!r}
QUERY = {s.query.text()!r}


def main(path, item, *order):
    spark = SparkSession.builder.getOrCreate()
    df = spark.read.parquet(path)
    sketch = Sketch(Program.parse(INIT, UPDATE, QUERY, DIALECT)).build(df, item, *order)
    freq = exact_frequency(stream_of(df, item, *order))
    top = freq.orderBy(F.desc("cnt"), "e").limit(30)
    error_report(freq, sketch.estimate(top.select("e"))).orderBy(F.desc("actual"), "e").show(30, False)


if __name__ == "__main__":
    main(*sys.argv[1:])
'''
