"""Integer and string functions with the semantics of sketch programs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1 << 62


def digest_hex(i: int, text: Column) -> Column:
    data = text.cast("binary")
    return (F.md5(data), F.sha1(data), F.sha2(data, 256))[i % 3]


def hash_mod(i: int, text: Column, m: int) -> Column:
    """The digest of a text modulo m (up to 2**34), seven hex digits at a time, so all stays within 64 bits."""
    if not 0 < m < 1 << 34:
        raise ValueError("modulus out of range")
    digits = (32, 40, 64)[i % 3]
    h, out = digest_hex(i, text), None
    for at in range(0, digits, 7):
        width = min(7, digits - at)
        part = F.conv(F.substring(h, at + 1, width), 16, 10).cast("long")
        out = part % m if out is None else (out * ((1 << 4 * width) % m) + part) % m
    return out


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; by 0: by 1."""
    b = F.when(b == 0, F.lit(1).cast("long")).otherwise(b)
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down; by 0: by 1."""
    by = F.when(b == 0, F.lit(1).cast("long")).otherwise(b)
    return F.call_function("div", a - floor_mod(a, by), by)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def wrapped_slice(s: Column, a: Column, b: Column) -> Column:
    """s[a:b], negative bounds counting from the end."""
    n = F.length(s)
    at = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    return F.substring(s, (at(a) + 1).cast("int"), F.greatest(at(b) - at(a), F.lit(0)).cast("int"))


def clamped_slice(s: Column, a: Column, b: Column) -> Column:
    """s[a:b], negative bounds counting as 0."""
    n = F.length(s)
    at = lambda x: F.least(F.greatest(x, F.lit(0)), n)
    return F.substring(s, (at(a) + 1).cast("int"), F.greatest(at(b) - at(a), F.lit(0)).cast("int"))


def nonzero(m: Column) -> Column:
    return F.when(m == 0, F.lit(1).cast("long")).otherwise(m)


def segment_row(rows: int, h: Column, sid: Column, count: Column) -> Column:
    n = F.least(nonzero(F.abs(count)), F.lit(rows).cast("long"))
    s = F.abs(sid) % n
    each, more = F.call_function("div", F.lit(rows).cast("long"), n), F.lit(rows) % n
    return s * each + F.least(s, more) + F.abs(h) % F.greatest(each + (s < more).cast("long"), F.lit(1).cast("long"))


def tier(sid: Column, count: Column, caps: list[Column], most: int) -> Column:
    n = nonzero(F.abs(count))
    k = F.call_function("div", F.abs(sid) % n * len(caps), n)
    chosen = F.element_at(F.array(*[c.cast("long") for c in caps]), (k + 1).cast("int"))
    return F.least(nonzero(F.abs(chosen)), F.lit(most).cast("long"))


def fuse(mode: Column, a: Column, b: Column, c: Column) -> Column:
    """Least, greatest, median or floored mean, by mode modulo 4."""
    k = F.abs(mode) % 4
    mean = floor_div(a + b + c, F.lit(3).cast("long"))
    return F.when(k == 0, F.least(a, b, c)).when(k == 1, F.greatest(a, b, c)).when(k == 2, median3(a, b, c)).otherwise(mean)
