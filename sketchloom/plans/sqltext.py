"""Expressions as DuckDB SQL text, so that results can be held against another engine."""

from __future__ import annotations

from collections.abc import Callable

from .grammar import HASHES, Dialect
from .nodes import Call, Const, Item, Node
from .program import Program
from .rewrite import TERNARY


def hash_mod(i: int, text: str, m: int) -> str:
    fn, digits = (("md5", 32), ("sha1", 40), ("sha256", 64))[i % 3]
    out = ""
    for at in range(0, digits, 7):
        w = min(7, digits - at)
        part = f"CAST(('0x' || substr({fn}({text}), {at + 1}, {w})) AS BIGINT)"
        out = f"({part} % {m})" if not out else f"(({out} * {(1 << 4 * w) % m} + {part}) % {m})"
    return out


def floor_mod(a: str, b: str) -> str:
    b = f"(CASE WHEN {b} = 0 THEN 1 ELSE {b} END)"
    return f"(CASE WHEN {a} % {b} <> 0 AND ({a} % {b} < 0) <> ({b} < 0) THEN {a} % {b} + {b} ELSE {a} % {b} END)"


def floor_div(a: str, b: str) -> str:
    return f"(({a} - {floor_mod(a, b)}) // (CASE WHEN {b} = 0 THEN 1 ELSE {b} END))"


def py_slice(s: str, a: str, b: str) -> str:
    at = lambda x: f"(CASE WHEN {x} < 0 THEN greatest(length({s}) + {x}, 0) ELSE least({x}, length({s})) END)"
    return f"substr({s}, {at(a)} + 1, greatest({at(b)} - {at(a)}, 0))"


def median3(a: str, b: str, c: str) -> str:
    return f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))"


class SqlText:
    """A part of the language that is enough for the registered queries."""

    def __init__(self, dialect: Dialect, item: str, read: Callable[[Call], str] | None = None):
        self.dialect, self.item, self.read = dialect, item, read

    def string(self, n: Node) -> str:
        if isinstance(n, Item):
            return self.item
        if n.name == "str_slice":
            return py_slice(self.string(n.args[0]), self.integer(n.args[1]), self.integer(n.args[2]))
        raise NotImplementedError(n.name)

    def boolean(self, n: Node) -> str:
        if isinstance(n, Const):
            return str(bool(n.value)).lower()
        ops = {"lt": "<", "gt": ">", "eq": "=", "less": "<", "greater": ">", "equal": "="}
        if n.name in ops:
            return f"({self.integer(n.args[0])} {ops[n.name]} {self.integer(n.args[1])})"
        if n.name in ("cnt_rdstate", "query_state"):
            return self.read(n)
        raise NotImplementedError(n.name)

    def modulo(self, n: Node, m: int) -> str:
        if isinstance(n, Call) and n.name in HASHES:
            text = self.string(n.args[1])
            if n.name == "hash_salt":
                text = f"{text} || '|' || '{n.args[2].text()}'"
            if n.name == "hash_on_slice":
                text = py_slice(text, n.args[2].text(), n.args[3].text())
            return hash_mod(int(n.args[0].value), text, m)
        if isinstance(n, Call) and n.name in ("safe_add", "safe_sub", "safe_mul"):
            op = {"safe_add": "+", "safe_sub": "-", "safe_mul": "*"}[n.name]
            return floor_mod(f"({self.modulo(n.args[0], m)} {op} {self.modulo(n.args[1], m)})", str(m))
        return floor_mod(self.integer(n), str(m))

    def integer(self, n: Node) -> str:
        if isinstance(n, Const):
            return f"CAST({int(n.value)} AS BIGINT)"
        a, name = n.args, n.name
        if name in ("query_count", "query_date"):
            return self.read(n)
        if name == "safe_mod" and isinstance(a[1], Const):
            return self.modulo(a[0], int(a[1].value))
        if name in TERNARY:
            return f"(CASE WHEN {self.boolean(a[0])} THEN {self.integer(a[1])} ELSE {self.integer(a[2])} END)"
        v = [self.integer(x) for x in a]
        if name in ("safe_add", "safe_sub", "safe_mul"):
            return f"({v[0]} {'+-*'[('safe_add', 'safe_sub', 'safe_mul').index(name)]} {v[1]})"
        if name == "safe_min":
            return f"least({v[0]}, {v[1]})"
        if name == "safe_max":
            return f"greatest({v[0]}, {v[1]})"
        if name == "sum3":
            return f"({' + '.join(v)})"
        if name == "median3":
            return median3(*v)
        if name == "base_sel":
            mode = f"abs({v[0]}) % 4"
            return f"(CASE WHEN {mode} = 0 THEN least({v[1]}, {v[2]}, {v[3]}) WHEN {mode} = 1 THEN greatest({v[1]}, {v[2]}, {v[3]}) WHEN {mode} = 2 THEN {median3(*v[1:])} ELSE ({v[1]} + {v[2]} + {v[3]}) // 3 END)"
        raise NotImplementedError(name)

    def places(self, init: Node) -> list[tuple[str, str]]:
        g, out = self.dialect.geometry, []
        for k in (0, 3, 6):
            x, y, m = init.args[k : k + 3]
            v = abs(int(m.value)) or 1
            out.append((self.modulo(x, g.rows), f"({self.modulo(y, min(v, g.cap) if g.cap else v)} % {g.cols})"))
        return out


def addresses_sql(program: Program, keys: str, lanes: int = 3) -> str:
    """(e, z, x, y) of a table of items."""
    places = SqlText(program.dialect, "e").places(program.init)
    return " UNION ALL ".join(f"SELECT e, {z} AS z, CAST({places[z][0]} AS INTEGER) AS x, CAST({places[z][1]} AS INTEGER) AS y FROM {keys}" for z in range(lanes))


def estimate_sql(program: Program) -> str:
    """est over a row that has the counts c0, c1, c2 and flags o0, o1, o2 of the item's cells."""
    over = program.dialect.geometry.overflow_read

    def read(n: Call) -> str:
        z = int(n.args[1].value) % 3
        if n.name == "cnt_rdstate":
            return f"coalesce(o{z}, false)"
        return f"(CASE WHEN coalesce(o{z}, false) THEN {over} ELSE coalesce(c{z}, 0) END)"

    return f"CAST({SqlText(program.dialect, 'e', read).integer(program.query)} AS DOUBLE)"
