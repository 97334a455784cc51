"""Lowering of expressions to columns.

Digests have 128 to 256 bits, but nearly always end in a modulus, and reduction commutes with sums, differences and
products: lower_mod pushes a constant modulus down to the digest. Other integers carry an interval; where it could
leave 64 bits, or a digest is compared or divided, BigInteger is raised and the caller evaluates the expression in
Python over distinct keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from .grammar import HASHES, Dialect
from .nodes import Call, Const, Item, Node
from .rewrite import TERNARY


class BigInteger(Exception):
    """The expression may need integers of more than 64 bits."""


Interval = tuple[int, int]
LONG = 1 << 31


def _long(v: int) -> Column:
    return F.lit(int(v)).cast("long")


class Lowering:
    """Lowers expressions over one item column; reads: gives the column and interval of a counter or flag read."""

    def __init__(self, dialect: Dialect, item: Column, reads: Callable[[Call], tuple[Column, Interval]] | None = None):
        self.dialect, self.item, self.reads = dialect, item, reads
        self.extra = dialect.init.columns | dialect.update.columns | dialect.query.columns

    def kind(self, n: Node) -> str:
        if isinstance(n, Item):
            return "str"
        if isinstance(n, Const):
            return "bool" if isinstance(n.value, bool) else "int"
        for g in (self.dialect.init, self.dialect.update, self.dialect.query):
            if n.name in g.signatures:
                return g.signatures[n.name][1]
        raise KeyError(n.name)

    # -- strings and booleans

    def string(self, n: Node) -> Column:
        if isinstance(n, Item):
            return self.item
        a = n.args
        if n.name == "str_slice":
            cut = S.wrapped_slice if self.dialect.geometry.slice_wraps else S.clamped_slice
            return cut(self.string(a[0]), self.integer(a[1])[0], self.integer(a[2])[0])
        if n.name == "str_concat":
            return F.concat(self.string(a[0]), self.string(a[1]))
        if n.name == "int_to_str":
            return self.salt(a[0])
        if n.name == "if_then_else_str":
            return F.when(self.boolean(a[0]), self.string(a[1])).otherwise(self.string(a[2]))
        return self.extra[n.name](*map(self.any, a))

    def salt(self, n: Node) -> Column:
        if self.kind(n) == "bool":
            return F.when(self.boolean(n), "True").otherwise("False")
        return self.integer(n)[0].cast("string")

    def boolean(self, n: Node) -> Column:
        if isinstance(n, Const):
            return F.lit(bool(n.value))
        a, name = n.args, n.name
        if name in ("lt", "less"):
            return self.integer(a[0])[0] < self.integer(a[1])[0]
        if name in ("gt", "greater"):
            return self.integer(a[0])[0] > self.integer(a[1])[0]
        if name in ("eq", "equal"):
            return self.integer(a[0])[0] == self.integer(a[1])[0]
        if name == "and_bool":
            return self.boolean(a[0]) & self.boolean(a[1])
        if name == "or_bool":
            return self.boolean(a[0]) | self.boolean(a[1])
        if name == "not_bool":
            return ~self.boolean(a[0])
        if name == "if_then_else_bool":
            return F.when(self.boolean(a[0]), self.boolean(a[1])).otherwise(self.boolean(a[2]))
        if name == "bit_test":
            x, _ = self.integer(a[0])
            return F.call_function("shiftright", x, self.shift(a[1])).bitwiseAND(_long(1)) == 1
        if name in ("query_state", "cnt_rdstate"):
            return self.reads(n)[0]
        return self.extra[name](*map(self.any, a))

    def any(self, n: Node) -> Column:
        return {"str": self.string, "bool": self.boolean, "int": lambda x: self.integer(x)[0]}[self.kind(n)](n)

    # -- integers

    def digest(self, n: Call, m: int) -> Column:
        a = n.args
        if not isinstance(a[0], Const) or not m < 1 << 34:
            raise BigInteger(n.text())
        text = self.string(a[1])
        if n.name == "hash_salt":
            text = F.concat(text, F.lit("|"), self.salt(a[2]))
        if n.name == "hash_on_slice":
            text = self.string(Call("str_slice", a[1:]))
        return S.hash_mod(int(a[0].value), text, m)

    def shift(self, n: Node) -> Column:
        return S.floor_mod(self.integer(n)[0], _long(31)).cast("int")

    def modulo(self, n: Node, m: int) -> Column:
        """n modulo the positive m, in 0..m-1."""
        if isinstance(n, Call):
            a, name = n.args, n.name
            if name in HASHES:
                return self.digest(n, m)
            if name in ("safe_add", "safe_sub", "safe_mul", "affine") and m < LONG:
                x, y = self.modulo(a[0], m), self.modulo(a[1], m)
                if name == "affine":
                    return (x + self.modulo(a[2], m) * y) % m
                return S.floor_mod({"safe_add": x + y, "safe_sub": x - y, "safe_mul": x * y}[name], _long(m))
            if name == "abs_int" and isinstance(a[0], Call) and a[0].name in HASHES:
                return self.modulo(a[0], m)
            if name in TERNARY:
                return F.when(self.boolean(a[0]), self.modulo(a[1], m)).otherwise(self.modulo(a[2], m))
        x, _ = self.integer(n)
        return F.pmod(x, _long(m))

    def checked(self, c: Column, lo: int, hi: int) -> tuple[Column, Interval]:
        if max(abs(lo), abs(hi)) >= S.LIMIT:
            raise BigInteger(f"{lo}..{hi}")
        return c, (lo, hi)

    def integer(self, n: Node) -> tuple[Column, Interval]:
        """A 64-bit column and the interval of its values."""
        if isinstance(n, Const):
            return self.checked(_long(int(n.value)), int(n.value), int(n.value))
        if self.kind(n) == "bool":
            return self.boolean(n).cast("long"), (0, 1)
        a, name, g = n.args, n.name, self.dialect.geometry
        if name in HASHES:
            raise BigInteger(n.text())
        if name in ("query_count", "query_date"):
            return self.reads(n)
        if name == "safe_mod":
            m = a[1]
            if isinstance(m, Const) and 0 < abs(int(m.value) or 1) < 1 << 34:
                v = int(m.value) or 1
                r = self.modulo(a[0], abs(v))
                return (r, (0, v - 1)) if v > 0 else (F.when(r > 0, r + v).otherwise(r), (v + 1, 0))
            (x, _), (y, (lo, hi)) = self.integer(a[0]), self.integer(m)
            return self.checked(S.floor_mod(x, y), min(lo, 0), max(hi, 0))
        if name == "seg_id" and isinstance(a[1], Const) and isinstance(a[0], Call) and a[0].name in HASHES:
            m = abs(int(a[1].value)) or 1
            return self.modulo(a[0], m), (0, m - 1)
        if name in ("row_route", "seg_row_index"):
            return self.segment(n)
        if name == "str_len":
            return F.length(self.string(a[0])).cast("long"), (0, LONG)
        if name in TERNARY:
            (x, i), (y, j) = self.integer(a[1]), self.integer(a[2])
            return F.when(self.boolean(a[0]), x).otherwise(y), (min(i[0], j[0]), max(i[1], j[1]))
        v = [self.integer(x) for x in a]
        c, lo, hi = [x for x, _ in v], [i[0] for _, i in v], [i[1] for _, i in v]
        if name == "safe_add" or name == "sum3":
            return self.checked(sum(c[1:], c[0]), sum(lo), sum(hi))
        if name == "safe_sub":
            return self.checked(c[0] - c[1], lo[0] - hi[1], hi[0] - lo[1])
        if name == "safe_mul":
            ends = [x * y for x in (lo[0], hi[0]) for y in (lo[1], hi[1])]
            self.checked(c[0], min(ends), max(ends))
            return c[0] * c[1], (min(ends), max(ends))
        if name == "affine":
            ends = [lo[0], hi[0]] + [x + y * z for x in (lo[0], hi[0]) for y in (lo[1], hi[1]) for z in (lo[2], hi[2])]
            self.checked(c[0], min(ends), max(ends))
            return c[0] + c[2] * c[1], (min(ends), max(ends))
        if name == "safe_div":
            most = max(abs(lo[0]), abs(hi[0]))
            return S.floor_div(*c), (-most - 1, most)
        if name == "abs_int":
            return F.abs(c[0]), (0, max(abs(lo[0]), abs(hi[0])))
        if name == "safe_min":
            return F.least(*c), (min(lo), min(hi))
        if name == "safe_max":
            return F.greatest(*c), (max(lo), max(hi))
        if name == "median3":
            return S.median3(*c), (min(lo), max(hi))
        if name in ("bit_xor", "bit_and", "bit_or"):
            bits = 1 << max(map(lambda x: abs(x).bit_length(), lo + hi))
            op = {"bit_xor": "bitwiseXOR", "bit_and": "bitwiseAND", "bit_or": "bitwiseOR"}[name]
            return self.checked(getattr(c[0], op)(c[1]), -bits, bits)
        if name == "shl":
            most = max(abs(lo[0]), abs(hi[0])) << 30
            self.checked(c[0], -most, most)
            return F.call_function("shiftleft", c[0], self.shift(a[1])), (-most, most)
        if name == "shr":
            most = max(abs(lo[0]), abs(hi[0]))
            return F.call_function("shiftright", c[0], self.shift(a[1])), (-most, most)
        if name == "seg_id":
            return c[0] % S.nonzero(F.abs(c[1])) if lo[0] >= 0 else F.abs(c[0]) % S.nonzero(F.abs(c[1])), (0, max(abs(lo[1]), abs(hi[1]), 1) - 1)
        caps = {"cap_half": c[2:], "cap_quartile": c[2:], "cap2_4_16": [_long(4), _long(16)], "cap2_8_16": [_long(8), _long(16)]}
        if name in caps:
            return S.tier(c[0], c[1], caps[name], g.cols), (1, g.cols)
        if name == "base_sel":
            return S.fuse(*c), (min(lo[1:]), max(hi[1:])) if hi and lo else (0, 0)
        if name in self.extra:
            return self.extra[name](*map(self.any, a)), (-S.LIMIT + 1, S.LIMIT - 1)
        raise BigInteger(n.text())

    def segment(self, n: Call) -> tuple[Column, Interval]:
        """seg_row_index(h, sid, count) and row_route(feature, h, count), with a constant count so that digests reduce."""
        a, rows = n.args, self.dialect.geometry.rows
        h, count = (a[1], a[2]) if n.name == "row_route" else (a[0], a[2])
        if isinstance(count, Const):
            k = abs(int(count.value)) or 1
            segments = min(k, rows)
            if n.name == "row_route":
                sid = self.modulo(a[0], k) if isinstance(a[0], Call) and a[0].name in HASHES else F.abs(self.integer(a[0])[0]) % k
            else:
                sid = self.integer(a[1])[0]
            each, more = divmod(rows, segments)
            s = F.abs(sid) % segments
            if isinstance(h, Call) and h.name in HASHES:
                inner = F.when(s < more, self.modulo(h, each + 1)).otherwise(self.modulo(h, max(1, each)))
            else:
                x = F.abs(self.integer(h)[0])
                inner = F.when(s < more, x % (each + 1)).otherwise(x % max(1, each))
            return s * each + F.least(s, _long(more)) + inner, (0, rows - 1)
        (x, _), (c, _) = self.integer(h), self.integer(count)
        sid = F.abs(self.integer(a[0])[0]) % S.nonzero(F.abs(c)) if n.name == "row_route" else self.integer(a[1])[0]
        return S.segment_row(rows, x, sid, c), (0, rows - 1)

    def places(self, init: Node) -> list[tuple[Column, Column]]:
        """(x, y) of the three lanes."""
        if not (isinstance(init, Call) and init.name == "list_3"):
            raise ValueError("the root of an addressing expression is list_3")
        g, out = self.dialect.geometry, []
        for k in (0, 3, 6):
            a, a1, m = init.args[k : k + 3]
            x = self.modulo(a, g.rows)
            if isinstance(m, Const):
                v = abs(int(m.value)) or 1
                v = min(v, g.cap) if g.cap else v
                y = self.modulo(a1, v) % g.cols
            else:
                by = S.nonzero(F.abs(self.integer(m)[0]))
                by = F.least(by, _long(g.cap)) if g.cap else by
                y = S.floor_mod(self.integer(a1)[0], by) % g.cols
            out.append((x.cast("int"), y.cast("int")))
        return out
