"""Registered queries of the sketch engine: each with the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import Workload, evaluate_programs, like_absent, stored_stream, stored_workload, workload_of
from .functions import scalars as S
from .operators import cases as C
from .operators import metrics as M
from .operators import population as P
from .operators.sketch import addresses, build_cells, estimates, fold_cells, merge_cells, stream_of
from .plans import sqltext as Q
from .plans.analyze import MECHANISM_PROGRAMS, effect_summary, legality, motif
from .plans.grammar import BUSY, MAIN
from .plans.lower import Lowering
from .plans.program import Program
from .search.islands import Config, champions, holdout, search
from .sources import candidates as K
from .sources import traces as T
from .sources.candidates import SAFE
from .streaming.ingest import streaming_cells, windowed_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- streams -------------------------------------------------------------------------------------------------------


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by order: the order key is a total order."""
    t = table(spark, sf, "orders")
    return t.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("e"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    return stream_of(table(spark, sf, "events"), "user_id", "ts", "event_id")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return stream_of(table(spark, sf, "lineitem"), "l_partkey")


ORDERS = "orders_s AS (SELECT o_orderkey AS seq, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS e FROM orders)"
PARTS = "parts_s AS (SELECT CAST(l_partkey AS VARCHAR) AS e FROM lineitem)"
USERS = "users_s AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, CAST(user_id AS VARCHAR) AS e FROM events)"
WITH = {"orders_s": ORDERS, "parts_s": PARTS, "users_s": USERS}
TRIPLE = MECHANISM_PROGRAMS["cms_like"][0]


def salted(update: str = TRIPLE, query_: str = SAFE["query"]) -> Program:
    return Program.parse(SAFE["init_dex"], update, query_)


def sel(mode: int) -> str:
    return f"base_sel({mode}, query_date(e, 0), query_date(e, 1), query_date(e, 2))"


def cells_sql(p: Program, stream: str, gain: str = "1") -> str:
    """Common table expressions up to c(z, x, y, cnt, ovf) of a program that adds gain to each plane."""
    return f"""WITH {WITH[stream]}, f AS (SELECT e, count(*) AS n FROM {stream} GROUP BY e),
    a AS ({Q.addresses_sql(p, "(SELECT DISTINCT e FROM f) k")}),
    s AS (SELECT z, x, y, CAST(sum(n * {gain}) AS BIGINT) AS s FROM a JOIN f USING (e) GROUP BY z, x, y),
    c AS (SELECT z, x, y, least(s, 4294967295) AS cnt, s > 4294967295 AS ovf FROM s)"""


def estimates_sql(p: Program, stream: str, gain: str = "1") -> str:
    lanes = " ".join(f"LEFT JOIN a a{z} ON a{z}.e = f.e AND a{z}.z = {z} LEFT JOIN c k{z} ON k{z}.z = {z} AND k{z}.x = a{z}.x AND k{z}.y = a{z}.y" for z in range(3))
    cols = ", ".join(f"k{z}.cnt AS c{z}, k{z}.ovf AS o{z}" for z in range(3))
    return cells_sql(p, stream, gain) + f""", r AS (SELECT f.e, f.n AS actual, {cols} FROM f {lanes}),
    g AS (SELECT e, actual, {Q.estimate_sql(p)} AS est FROM r)"""


def report(spark: SparkSession, sf: str, p: Program, stream=orders) -> DataFrame:
    s = stream(spark, sf)
    freq = M.exact_frequency(s)
    return M.error_report(freq, estimates(freq.select("e"), build_cells(s, p), p))


# ---- hashes, addresses, scalars ------------------------------------------------------------------------------------


def _hash_query(name: str, i: int, m: int):
    @query(f"SELECT p_partkey AS k, {Q.hash_mod(i, 'p_name', m)} AS h FROM part", f"hash_{name}_mod")
    def f(spark, sf):
        return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.hash_mod(i, F.col("p_name"), m).alias("h"))


for _n, _i, _m in (("md5", 0, 102), ("sha1", 1, 10_240), ("sha256", 2, 16_777_213)):
    _hash_query(_n, _i, _m)


@query(f"SELECT doc_id AS k, {Q.hash_mod(0, 'text', 102)} AS h FROM documents")
def hash_unicode(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), S.hash_mod(0, F.col("text"), 102).alias("h"))


def _lowered(expr: str, item: str, kind: str = "integer", dialect=MAIN):
    node = dialect.init.parse(f"list_3({expr}, 0, 1, 0, 0, 1, 0, 0, 1)").args[0]
    low = Lowering(dialect, F.col(item))
    return low.integer(node)[0] if kind == "integer" else low.string(node)


SALTED_HASH, SLICED_HASH = "safe_mod(hash_salt(1, e, 13), 102)", "safe_mod(hash_on_slice(2, e, -6, -1), 1000)"


@query(f"SELECT c_custkey AS k, {Q.hash_mod(1, chr(99) + '_name || ' + repr('|13'), 102)} AS h FROM customer")
def hash_salted(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _lowered(SALTED_HASH, "c_name").alias("h"))


@query(f"SELECT c_custkey AS k, {Q.hash_mod(2, Q.py_slice('c_name', '-6', '-1'), 1000)} AS h FROM customer")
def hash_slice(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), _lowered(SLICED_HASH, "c_name").alias("h"))


@query(f"WITH {ORDERS}, k AS (SELECT DISTINCT e FROM orders_s) SELECT e, z AS lane, z, x, y FROM ({Q.addresses_sql(salted(), 'k')})")
def list3_address(spark, sf):
    return addresses(orders(spark, sf), salted())


CAPPED = Program.parse("list_3(select_hash(0, e), hash_salt(0, e, 1), 7, select_hash(1, e), hash_salt(1, e, 2), 0, select_hash(2, e), hash_salt(2, e, 3), -250)", TRIPLE, sel(0))


@query(f"WITH {ORDERS}, k AS (SELECT DISTINCT e FROM orders_s) SELECT e, z AS lane, z, x, y FROM ({Q.addresses_sql(CAPPED, 'k')})")
def address_modulus_cap(spark, sf):
    return addresses(orders(spark, sf), CAPPED)


@query(f"WITH {ORDERS}, k AS (SELECT DISTINCT e FROM orders_s ORDER BY e LIMIT 128), a AS ({Q.addresses_sql(salted(), 'k')}) SELECT avg(u) AS avg_unique FROM (SELECT e, count(DISTINCT (z, x, y)) AS u FROM a GROUP BY e)")
def unique_locations(spark, sf):
    """The mean number of distinct cells of the first 128 probes (the limit is the probe's definition)."""
    probe = orders(spark, sf).select("e").distinct().orderBy("e").limit(128)
    a = addresses(probe, salted()).groupBy("e").agg(F.count_distinct("z", "x", "y").alias("u"))
    return a.agg(F.avg("u").alias("avg_unique"))


def _long(name: str) -> Column:
    return F.col(name).cast("long")


@query("SELECT p_partkey AS k, (p_partkey % 5) * 3 + least(p_partkey % 5, 1) + p_size % (CASE WHEN p_partkey % 5 < 1 THEN 4 ELSE 3 END) AS row FROM part")
def segment_route(spark, sf):
    five = F.lit(5).cast("long")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.segment_row(16, _long("p_size"), _long("p_partkey") % five, five).alias("row"))


@query("SELECT p_partkey AS k, CAST(CASE WHEN (p_partkey % 8) * 2 // 8 = 0 THEN 4 ELSE 16 END AS BIGINT) AS half, CAST(CASE (p_partkey % 8) * 4 // 8 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 16 END AS BIGINT) AS quartile FROM part")
def cap_tiers(spark, sf):
    eight, lit = F.lit(8).cast("long"), lambda *v: [F.lit(x) for x in v]
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.tier(_long("p_partkey"), eight, lit(4, 16), 16).alias("half"), S.tier(_long("p_partkey"), eight, lit(2, 4, 8, 99), 16).alias("quartile"))


@query(f"SELECT p_partkey AS k, {Q.py_slice('p_name', '-7', '-2')} AS a, {Q.py_slice('p_name', '2', '5')} AS b, {Q.py_slice('p_name', '(p_size - 20)', '(p_size - 10)')} AS c, substr(p_name, greatest(p_size - 20, 0) + 1, greatest(least(greatest(p_size - 10, 0), length(p_name)) - least(greatest(p_size - 20, 0), length(p_name)), 0)) AS d FROM part")
def py_slice(spark, sf):
    n, s = F.col("p_name"), F.col("p_size")
    cut = lambda a, b: S.wrapped_slice(n, F.lit(a), F.lit(b))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), cut(-7, -2).alias("a"), cut(2, 5).alias("b"), S.wrapped_slice(n, s - 20, s - 10).alias("c"), S.clamped_slice(n, s - 20, s - 10).alias("d"))


A, B = "(p_size - 25)", "(CAST(p_partkey % 7 AS BIGINT) - 3)"


@query(f"SELECT p_partkey AS k, {Q.floor_div(A, B)} AS d, {Q.floor_mod(A, B)} AS m FROM part")
def py_floor_div_mod(spark, sf):
    a, b = _long("p_size") - 25, _long("p_partkey") % 7 - 3
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.floor_div(a, b).alias("d"), S.floor_mod(a, b).alias("m"))


@query("SELECT p_partkey AS k, greatest(least(p_size, p_partkey % 50), least(greatest(p_size, p_partkey % 50), 25)) AS med, p_size + p_partkey % 50 + 25 AS total, least(p_size, p_partkey % 50) AS lo, greatest(p_size, p_partkey % 50) AS hi, CASE WHEN p_size < p_partkey % 50 THEN 1 ELSE 2 END AS tern, CAST(abs(p_size - 25) AS BIGINT) AS dist FROM part")
def scalar_functions(spark, sf):
    a, b, c = _long("p_size"), _long("p_partkey") % 50, F.lit(25).cast("long")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.median3(a, b, c).alias("med"), (a + b + c).alias("total"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(a < b, 1).otherwise(2).alias("tern"), F.abs(a - 25).alias("dist"))


@query("SELECT p_partkey AS k, xor(p_partkey, p_size) AS x, p_partkey & p_size AS a, p_partkey | p_size AS o, p_partkey << (p_size % 31) AS l, p_partkey >> (p_size % 31) AS r, (p_partkey >> (p_size % 31)) & 1 = 1 AS t FROM part")
def bit_ops(spark, sf):
    k, s = _long("p_partkey"), _long("p_size")
    by = S.floor_mod(s, F.lit(31).cast("long")).cast("int")
    right = F.call_function("shiftright", k, by)
    return table(spark, sf, "part").select(k.alias("k"), k.bitwiseXOR(s).alias("x"), k.bitwiseAND(s).alias("a"), k.bitwiseOR(s).alias("o"), F.call_function("shiftleft", k, by).alias("l"), right.alias("r"), (right.bitwiseAND(F.lit(1).cast("long")) == 1).alias("t"))


def _compact(name: str, **columns: tuple[str, str]):
    """A query of integer expressions of the compact dialect over part names, each with its SQL."""
    text = ", ".join(f"CAST({sql} AS BIGINT) AS {c}" for c, (_, sql) in columns.items())

    @query(f"SELECT p_partkey AS k, {text} FROM part", name)
    def f(spark, sf):
        return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), *(_lowered(x, "p_name", dialect=BUSY).cast("long").alias(c) for c, (x, _) in columns.items()))


_compact(
    "compact_strings",
    n=("str_len(e)", "length(p_name)"),
    joined=("safe_mod(select_hash(0, str_concat(e, int_to_str(str_len(e)))), 1000)", Q.hash_mod(0, "p_name || CAST(length(p_name) AS VARCHAR)", 1000)),
    chosen=("safe_mod(select_hash(1, if_then_else_str(greater(str_len(e), 12), str_slice(e, 0, 5), e)), 1000)", Q.hash_mod(1, "(CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 5) ELSE p_name END)", 1000)),
)
_compact(
    "compact_booleans",
    both=("if_then_else_int(and_bool(greater(str_len(e), 8), not_bool(equal(str_len(e), 12))), 1, 0)", "CASE WHEN length(p_name) > 8 AND length(p_name) <> 12 THEN 1 ELSE 0 END"),
    either=("if_then_else_int(or_bool(less(str_len(e), 10), equal(str_len(e), 13)), 4, 2)", "CASE WHEN length(p_name) < 10 OR length(p_name) = 13 THEN 4 ELSE 2 END"),
    nested=("if_then_else_int(if_then_else_bool(greater(str_len(e), 11), less(str_len(e), 14), greater(str_len(e), 9)), 1, 0)", "CASE WHEN CASE WHEN length(p_name) > 11 THEN length(p_name) < 14 ELSE length(p_name) > 9 END THEN 1 ELSE 0 END"),
)
_compact(
    "compact_arithmetic",
    line=("affine(str_len(e), 3, 5)", "length(p_name) + 5 * 3"),
    dist=("abs_int(safe_sub(str_len(e), 12))", "abs(length(p_name) - 12)"),
    segment=("seg_id(safe_sub(3, str_len(e)), 4)", "abs(3 - length(p_name)) % 4"),
    bits=("bit_xor(str_len(e), 9)", "xor(length(p_name), 9)"),
)
_H0, _H1 = Q.hash_mod(0, "p_name", 5), "(CASE WHEN {s} < 1 THEN {a} ELSE {b} END)"
_compact(
    "compact_routes",
    even=("row_route(select_hash(0, e), select_hash(1, e), 4)", f"{Q.hash_mod(0, 'p_name', 4)} * 4 + {Q.hash_mod(1, 'p_name', 4)}"),
    uneven=("row_route(select_hash(0, e), select_hash(1, e), 5)", f"{_H0} * 3 + least({_H0}, 1) + " + _H1.format(s=_H0, a=Q.hash_mod(1, "p_name", 4), b=Q.hash_mod(1, "p_name", 3))),
    tiers=("cap2_4_16(seg_id(select_hash(0, e), 4), 4)", f"CASE WHEN {Q.hash_mod(0, 'p_name', 4)} < 2 THEN 4 ELSE 16 END"),
)


# ---- exact -----------------------------------------------------------------------------------------------------------


@query(f"WITH {PARTS} SELECT e, count(*) AS cnt FROM parts_s GROUP BY e")
def exact_freq(spark, sf):
    return M.exact_frequency(parts(spark, sf))


@query(f"WITH {ORDERS} SELECT e, count(*) AS cnt FROM orders_s GROUP BY e UNION ALL SELECT * FROM (VALUES ('dragonfruit', 0), ('starfruit', 0), ('passionfruit', 0)) z(e, cnt)")
def exact_freq_zero_keys(spark, sf):
    return M.exact_frequency(orders(spark, sf), compat=True)


@query(f"WITH {PARTS} SELECT e, count(*) AS cnt FROM parts_s GROUP BY e ORDER BY cnt DESC, e LIMIT 96")
def top_k_exact(spark, sf):
    return M.top_k(M.exact_frequency(parts(spark, sf)), 96)


@query(f"WITH {ORDERS} SELECT e, count(*) AS cnt, min(seq) AS first_seq FROM orders_s GROUP BY e ORDER BY cnt DESC, first_seq LIMIT 96")
def first_seen_order(spark, sf):
    return M.top_k(M.first_seen(orders(spark, sf)), 96, "first_seq")


@query(f"WITH {PARTS} SELECT count(*) AS n, count(DISTINCT e) AS u, count(DISTINCT e) / count(*) AS u_ratio FROM parts_s")
def distinct_ratio(spark, sf):
    return M.distinct_ratio(parts(spark, sf))


_POSITIONED = "p AS (SELECT event_id AS position, event_type AS e FROM events), n AS (SELECT max(position) + 1 AS n FROM p), s AS (SELECT e, position, CASE WHEN position < greatest(1, n // 3) THEN 0 WHEN position < greatest(greatest(1, n // 3) + 1, 2 * n // 3) THEN 1 ELSE 2 END AS stage FROM p, n)"


def _staged(spark, sf):
    return M.split_stages(table(spark, sf, "events").select(F.col("event_id").alias("position"), F.col("event_type").alias("e")))


@query(f"WITH {_POSITIONED} SELECT stage, count(*) AS n, min(position) AS first, max(position) AS last FROM s GROUP BY stage")
def stage_split(spark, sf):
    return _staged(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query(f"WITH {_POSITIONED} SELECT g.stage, s.e, count(*) AS cnt FROM (VALUES (0), (1), (2)) g(stage) JOIN s ON s.stage <= g.stage GROUP BY g.stage, s.e")
def stage_cumulative_freq(spark, sf):
    return M.cumulative_frequency(_staged(spark, sf))


# ---- cells -----------------------------------------------------------------------------------------------------------


def _cells(name: str, p: Program, stream, stream_sql: str | None, gain: str = "1"):
    @query(cells_sql(p, stream_sql, gain) + " SELECT z, x, y, cnt, ovf FROM c" if stream_sql else None, name)
    def f(spark, sf):
        return build_cells(stream(spark, sf), p)


READ_WRITE = salted("base(write_count(e, 0, safe_add(1, query_count(e, 0))), write_count(e, 1, safe_add(1, query_count(e, 1))), write_count(e, 2, safe_add(1, query_count(e, 2))))")
SATURATING = salted("base(update_count(e, 0, 1000000000), update_count(e, 1, 1000000000), update_count(e, 2, 1000000000))")
DIAGONAL = Program.parse("list_3(select_hash(0, e), safe_mod(select_hash(0, e), 102), 102, select_hash(1, e), safe_mod(select_hash(1, e), 102), 102, select_hash(2, e), safe_mod(select_hash(2, e), 102), 102)", TRIPLE, sel(0))
_cells("cells_triple_update", salted(), parts, "parts_s")
_cells("cells_read_before_write", READ_WRITE, orders, "orders_s")
_cells("cells_saturating", SATURATING, orders, "orders_s", "1000000000")
_cells("cells_diagonal_layout", DIAGONAL, orders, "orders_s")
_cells("cells_big_integer_address", Program.parse("list_3(select_hash(2, e), select_hash(0, str_slice(e, 3, 8)), 102, safe_div(select_hash(1, e), 3), 1, False, abs_int(safe_sub(select_hash(0, e), select_hash(1, e))), 5, select_hash(0, e))", TRIPLE, sel(1)), orders, None)

CONSTANT = salted("base(write_count(e, 0, 1), update_count(e, 1, 1), update_state(e, 2, True))")


@query(f"WITH {ORDERS}, f AS (SELECT e, count(*) AS n FROM orders_s GROUP BY e), a AS ({Q.addresses_sql(CONSTANT, 'f')}) SELECT z, x, y, CAST(CASE z WHEN 0 THEN 1 WHEN 1 THEN sum(n) ELSE 0 END AS BIGINT) AS cnt, z = 2 AS ovf FROM a JOIN f USING (e) GROUP BY z, x, y")
def cells_const_write(spark, sf):
    return build_cells(orders(spark, sf), CONSTANT)


def _per_row(p: Program) -> str:
    """orders_s with the cell of each lane as text p0, p1, p2."""
    places = Q.SqlText(p.dialect, "e").places(p.init)
    return "r AS (SELECT seq, e, " + ", ".join(f"CAST({x} AS INTEGER) AS x{z}, CAST({y} AS INTEGER) AS y{z}" for z, (x, y) in enumerate(places)) + " FROM orders_s)"


GATED = salted("base(updatecount_if(lt(query_count(e, 0), query_count(e, 1)), e, 0, 1), update_count(e, 1, 1), update_count(e, 2, 1))")


@query(f"""WITH {ORDERS}, {_per_row(GATED)}, v AS (SELECT *, count(*) OVER (PARTITION BY x1, y1 ORDER BY seq) - 1 AS before1 FROM r),
g AS (SELECT x0, y0, list_reduce(list_prepend(CAST(0 AS BIGINT), list(before1 ORDER BY seq)), lambda a, b: a + CASE WHEN a < b THEN 1 ELSE 0 END) AS cnt FROM v GROUP BY x0, y0)
SELECT 0 AS z, x0 AS x, y0 AS y, cnt, false AS ovf FROM g WHERE cnt > 0
UNION ALL SELECT 1, x1, y1, count(*), false FROM r GROUP BY x1, y1 UNION ALL SELECT 2, x2, y2, count(*), false FROM r GROUP BY x2, y2""")
def cells_gated(spark, sf):
    """Plane 0 needs its own values: a streaming fold per cell."""
    return build_cells(orders(spark, sf), GATED)


PROMOTION = salted("base(update_count(e, 0, 1), updatecount_if(gt(query_count(e, 0), 2), e, 1, 1), updatecount_if(gt(query_count(e, 1), 2), e, 2, 1))")


@query(f"""WITH {ORDERS}, {_per_row(PROMOTION)}, a AS (SELECT *, count(*) OVER (PARTITION BY x0, y0 ORDER BY seq) AS c0 FROM r),
b AS (SELECT *, sum(CASE WHEN c0 > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY x1, y1 ORDER BY seq) AS c1 FROM a)
SELECT 0 AS z, x0 AS x, y0 AS y, count(*) AS cnt, false AS ovf FROM a GROUP BY x0, y0
UNION ALL SELECT 1, x1, y1, CAST(count(*) FILTER (c0 > 2) AS BIGINT), false FROM a GROUP BY x1, y1 HAVING count(*) FILTER (c0 > 2) > 0
UNION ALL SELECT 2, x2, y2, CAST(count(*) FILTER (c1 > 2) AS BIGINT), false FROM b GROUP BY x2, y2 HAVING count(*) FILTER (c1 > 2) > 0""")
def cells_layered_promotion(spark, sf):
    return build_cells(orders(spark, sf), PROMOTION)


FLAGGED = salted("base(update_count(e, 0, 1), writestate_if(gt(query_count(e, 0), 3), e, 1, True), 0)")


@query(f"""WITH {ORDERS}, {_per_row(FLAGGED)}, a AS (SELECT *, count(*) OVER (PARTITION BY x0, y0 ORDER BY seq) AS c0 FROM r)
SELECT 0 AS z, x0 AS x, y0 AS y, count(*) AS cnt, false AS ovf FROM a GROUP BY x0, y0
UNION ALL SELECT DISTINCT 1, x1, y1, 0, true FROM a WHERE c0 > 3""")
def cells_state_flag(spark, sf):
    return build_cells(orders(spark, sf), FLAGGED)


STATED = salted("base(update_count(e, 0, 1), writestate_if(gt(query_count(e, 0), 3), e, 1, True), updatecount_if(query_state(e, 1), e, 2, 1))")


@query(f"""WITH {ORDERS}, {_per_row(STATED)}, a AS (SELECT *, count(*) OVER (PARTITION BY x0, y0 ORDER BY seq) AS c0 FROM r),
b AS (SELECT *, bool_or(c0 > 3) OVER (PARTITION BY x1, y1 ORDER BY seq) AS s1 FROM a)
SELECT 0 AS z, x0 AS x, y0 AS y, count(*) AS cnt, false AS ovf FROM a GROUP BY x0, y0
UNION ALL SELECT DISTINCT 1, x1, y1, 0, true FROM a WHERE c0 > 3
UNION ALL SELECT 2, x2, y2, count(*), false FROM b WHERE s1 GROUP BY x2, y2""")
def cells_state_read(spark, sf):
    """A plane that counts only where another one's flag is up."""
    return build_cells(orders(spark, sf), STATED)


WRITTEN = salted("base(update_count(e, 0, 1), writecount_if(gt(query_count(e, 0), 3), e, 1, 9), update_count(e, 2, 4))")


@query(f"""WITH {ORDERS}, {_per_row(WRITTEN)}, a AS (SELECT *, count(*) OVER (PARTITION BY x0, y0 ORDER BY seq) AS c0 FROM r)
SELECT 0 AS z, x0 AS x, y0 AS y, count(*) AS cnt, false AS ovf FROM a GROUP BY x0, y0
UNION ALL SELECT DISTINCT 1, x1, y1, 9, false FROM a WHERE c0 > 3
UNION ALL SELECT 2, x2, y2, 4 * count(*), false FROM a GROUP BY x2, y2""")
def cells_guarded_write(spark, sf):
    return build_cells(orders(spark, sf), WRITTEN)


COMPACT_ROUTED = "list_3(row_route(select_hash(0, e), select_hash(1, e), 4), select_hash(2, e), 16, select_hash(1, e), hash_salt(0, e, 5), 16, select_hash(2, e), hash_salt(1, e, 6), 8)"
COMPACT_COUNTS = Program.parse(COMPACT_ROUTED, "base(update_count(e, 0, 2), update_count(e, 1, 0), update_count(e, 2, 1))", sel(0), BUSY)


@query(f"""WITH {ORDERS}, f AS (SELECT e, count(*) AS n FROM orders_s GROUP BY e),
a AS (SELECT e, n * 2 AS n, 0 AS z, {Q.hash_mod(0, "e", 4)} * 4 + {Q.hash_mod(1, "e", 4)} AS x, {Q.hash_mod(2, "e", 16)} AS y FROM f
UNION ALL SELECT e, n, 1, {Q.hash_mod(1, "e", 16)}, {Q.hash_mod(0, "e || '|5'", 16)} FROM f UNION ALL SELECT e, n, 2, {Q.hash_mod(2, "e", 16)}, {Q.hash_mod(1, "e || '|6'", 8)} FROM f)
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(sum(n) AS BIGINT) AS cnt, false AS ovf FROM a GROUP BY z, x, y""")
def cells_compact(spark, sf):
    """Counts in the compact geometry, where an update by 0 counts as one by 1."""
    return build_cells(orders(spark, sf), COMPACT_COUNTS)


CONSERVATIVE = Program.parse("list_3(row_route(select_hash(0, e), select_hash(1, e), 4), select_hash(2, e), 16, select_hash(1, e), hash_salt(0, e, 5), 16, select_hash(2, e), hash_salt(1, e, 6), cap2_8_16(seg_id(select_hash(0, e), 4), 4))", "base(cu_update(e, 1), 0, 0)", sel(0), BUSY)


@query()
def cells_conservative(spark, sf):
    """Conservative update: an ordered fold, no SQL."""
    return build_cells(users(spark, sf), CONSERVATIVE)


@query()
def cells_by_sketch(spark, sf):
    """A fold per event type, side by side."""
    t = table(spark, sf, "events")
    s = t.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").cast("string").alias("e"), "event_type")
    return fold_cells(s, CONSERVATIVE, by="event_type")


@query(cells_sql(salted(), "orders_s") + " SELECT z, x, y, cnt, ovf FROM c")
def sketch_merge(spark, sf):
    """An extension: sketches of parts of a stream add up."""
    s = orders(spark, sf)
    return merge_cells(*(build_cells(s.filter(F.pmod("seq", F.lit(3)) == k), salted()) for k in range(3)))


# ---- estimates and errors --------------------------------------------------------------------------------------------


def _estimate(name: str, p: Program, gain: str = "1"):
    @query(estimates_sql(p, "orders_s", gain) + " SELECT e, actual, est, abs(est - actual) AS abs_err FROM g", name)
    def f(spark, sf):
        return report(spark, sf, p)


for _k, _name in enumerate(("min", "max", "median", "avg")):
    _estimate(f"est_{_name}", salted(query_=sel(_k)))
_estimate("est_inf_on_overflow", salted("base(update_count(e, 0, 1000000000), update_count(e, 1, 1000000000), update_count(e, 2, 1000000000))", sel(3)), "1000000000")
_estimate("est_state_gated", salted(query_="base_sel(0, query_date(e, 0), if_then_else(cnt_rdstate(e, 1), 7, safe_max(query_date(e, 1), query_date(e, 2))), sum3(query_date(e, 2), 1, 1))"))


@query(estimates_sql(READ_WRITE, "orders_s") + " SELECT e, actual, est, abs(est - actual) AS abs_err FROM g ORDER BY actual DESC, e LIMIT 30")
def topk_report(spark, sf):
    """The report of a sketch: its 30 most frequent items (the limit is the report)."""
    s = orders(spark, sf)
    freq = M.exact_frequency(s)
    top = M.top_k(freq, 30)
    return M.error_report(top, estimates(top.select("e"), build_cells(s, READ_WRITE), READ_WRITE))


@query(f"""WITH {ORDERS}, f AS (SELECT e, count(*) AS n FROM orders_s GROUP BY e), b AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r FROM f ORDER BY e LIMIT 64),
i AS (SELECT unnest(range(80)) AS i), m AS (SELECT i, b.e || '__absent__' || i AS e FROM i JOIN b ON b.r = i % (SELECT count(*) FROM b))
SELECT i, e FROM m WHERE e NOT IN (SELECT e FROM f) ORDER BY i LIMIT 16""")
def absent_anti_join(spark, sf):
    return M.absent_keys(M.exact_frequency(orders(spark, sf)), "absent", 16)


def absent_sql(p: Program, stream: str, k: int) -> str:
    """Common table expressions up to h(e, est): estimates of k keys that the stream lacks."""
    lanes = " ".join(f"LEFT JOIN ka a{z} ON a{z}.e = m.e AND a{z}.z = {z} LEFT JOIN c k{z} ON k{z}.z = {z} AND k{z}.x = a{z}.x AND k{z}.y = a{z}.y" for z in range(3))
    cols = ", ".join(f"k{z}.cnt AS c{z}, k{z}.ovf AS o{z}" for z in range(3))
    return f"""b AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r FROM f ORDER BY e LIMIT {max(16, 4 * k)}),
    i AS (SELECT unnest(range({4 * k + 16})) AS i), made AS (SELECT i, b.e || '__absent__' || i AS e FROM i JOIN b ON b.r = i % (SELECT count(*) FROM b)),
    m AS (SELECT e FROM made WHERE e NOT IN (SELECT e FROM f) ORDER BY i LIMIT {k}), ka AS ({Q.addresses_sql(p, "m")}),
    l AS (SELECT m.e, {cols} FROM m {lanes}), h AS (SELECT e, {Q.estimate_sql(p)} AS est FROM l)"""


def _absent(s: DataFrame, p: Program, k: int) -> DataFrame:
    keys = M.absent_keys(M.exact_frequency(s), "absent", k).select("e")
    return estimates(keys, build_cells(s, p), p).select("e", "est")


@query(f"{cells_sql(salted(), 'orders_s')}, {absent_sql(salted(), 'orders_s', 64)} SELECT e, est FROM h")
def absent_probe(spark, sf):
    """False positives: estimates of keys that the stream lacks."""
    return _absent(orders(spark, sf), salted(), 64)


@query(estimates_sql(salted(), "orders_s") + " SELECT count(*) AS n, sum(abs(est - actual)) AS sae, sum(abs(est - actual)) / count(*) AS aae FROM g")
def sae_aae(spark, sf):
    return M.error_summary(report(spark, sf, salted()))


@query(estimates_sql(DIAGONAL, "parts_s") + " SELECT count(*) AS n, sum(abs(est - actual)) AS sae, sum(abs(est - actual)) / count(*) AS aae FROM g")
def sae_diagonal_parts(spark, sf):
    return M.error_summary(report(spark, sf, DIAGONAL, parts))


@query(estimates_sql(salted(query_=sel(3)), "orders_s") + " SELECT e, CASE WHEN est <= 255 THEN CAST(est AS BIGINT) WHEN est <= 4095 THEN CAST(est AS BIGINT) // 8 * 8 WHEN est <= 65535 THEN CAST(est AS BIGINT) // 128 * 128 ELSE 65535 END AS bucket FROM g")
def error_buckets(spark, sf):
    r = report(spark, sf, salted(query_=sel(3)))
    return r.select("e", M.error_bucket(F.col("est")).alias("bucket"))


@query("SELECT s_suppkey AS pid, 1 / (1 + greatest(s_acctbal, 0) / 250.0) AS fit FROM supplier")
def fitness(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pid"), M.fitness(F.col("s_acctbal"), 250.0).alias("fit"))


@query("SELECT greatest(coalesce(median(abs(s_acctbal)), 1.0), 1.0) AS e0 FROM supplier")
def typical_error(spark, sf):
    return M.typical_error(table(spark, sf, "supplier").select(F.abs("s_acctbal").alias("err")))


_BASE = "b AS (" + " UNION ALL ".join(f"SELECT e, n, {i} AS lane, {Q.hash_mod(i, 'e', 10_240)} AS y FROM f" for i in range(3)) + "), c AS (SELECT lane, y, sum(n) AS c FROM b GROUP BY lane, y), g AS (SELECT e, n, min(c) AS est FROM b JOIN c USING (lane, y) GROUP BY e, n)"


@query(f"WITH {PARTS}, f AS (SELECT e, count(*) AS n FROM parts_s GROUP BY e), {_BASE} SELECT count(*) AS n, CAST(sum(est - n) AS DOUBLE) AS sae, sum(est - n) / count(*) AS aae FROM g")
def baseline_cms(spark, sf):
    return M.error_summary(M.baseline_report(parts(spark, sf)))


@query(f"""{estimates_sql(salted(), "orders_s")}, v AS (SELECT est, count(*) AS c FROM g GROUP BY est), {absent_sql(salted(), "orders_s", 64)}
SELECT count(*) AS uniq_present, max(c) / sum(c) AS mode_ratio, max(est) - min(est) AS present_span, sum(est * c) / sum(c) AS present_mean, (SELECT avg(est) FROM h) AS absent_mean FROM v""")
def collapse_stats(spark, sf):
    """Of the stream's own keys and of 64 that it lacks."""
    return M.collapse_stats(report(spark, sf, salted()).select("e", "est"), _absent(orders(spark, sf), salted(), 64))


@query(f"{estimates_sql(salted(), 'orders_s')} SELECT count(*) / 50.0 AS recall FROM (SELECT e FROM g ORDER BY actual DESC, e LIMIT 50) SEMI JOIN (SELECT e FROM g ORDER BY est DESC, e LIMIT 50) USING (e)")
def heavy_hitter_recall(spark, sf):
    return M.heavy_hitter_recall(report(spark, sf, salted()), 50)


@query(f"""WITH {_POSITIONED}, g AS (SELECT k.stage, s.e, count(*) AS n FROM (VALUES (0), (1), (2)) k(stage) JOIN s ON s.stage <= k.stage GROUP BY k.stage, s.e),
a AS ({Q.addresses_sql(salted(), '(SELECT DISTINCT e FROM s) k')}), c AS (SELECT stage, z, x, y, sum(n) AS cnt FROM a JOIN g USING (e) GROUP BY stage, z, x, y),
t AS (SELECT g.stage, g.e, g.n, list_sort(list(c.cnt))[2] AS est FROM g JOIN a USING (e) JOIN c ON c.stage = g.stage AND c.z = a.z AND c.x = a.x AND c.y = a.y GROUP BY g.stage, g.e, g.n)
SELECT stage, count(*) AS n, CAST(sum(abs(est - n)) AS DOUBLE) AS sae, sum(abs(est - n)) / count(*) AS aae FROM t GROUP BY stage""")
def stage_errors(spark, sf):
    """Errors after each of three cumulative stages of a stream."""
    staged = _staged(spark, sf)
    freq = M.cumulative_frequency(staged).cache()
    out = None
    for s in range(3):
        seen = staged.filter(F.col("stage") <= s).select(F.col("position").alias("seq"), "e")
        own = freq.filter(F.col("stage") == s).select("e", "cnt")
        r = M.error_summary(M.error_report(own, estimates(own.select("e"), build_cells(seen, salted()), salted())))
        r = r.select(F.lit(s).alias("stage"), "n", "sae", "aae")
        out = r if out is None else out.unionByName(r)
    return out


# ---- workloads -------------------------------------------------------------------------------------------------------


@query(f"WITH {ORDERS}, d AS (SELECT DISTINCT e FROM orders_s) SELECT e FROM d ORDER BY length(e), substr(e, 1, 4), right(e, 4), e LIMIT 400")
def proxy_pool_collision_order(spark, sf):
    return orders(spark, sf).select("e").distinct().orderBy(*T.collision_order()).limit(400)


@query("SELECT event_type AS file, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 40 GROUP BY event_type")
def share_by_file(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("e"))
    took = T.take_per_file(rows, 200, 5)
    return took.groupBy("seq.file").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("e").cast("long")).alias("first"), F.max(F.col("e").cast("long")).alias("last"))


@query()
def proxy_head_stream(spark, sf):
    s = T.proxy_stream(orders(spark, sf), "proxy_head", 2_000, seed=3)
    return s.groupBy("e").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {ORDERS}, d AS (SELECT count(DISTINCT e) AS d FROM orders_s) SELECT CAST(s AS INTEGER) AS stage, CAST(n AS BIGINT) AS n, least(d, u) AS u FROM d, (VALUES (0, 1250, 275), (1, 1750, 875), (2, 2000, 1000)) v(s, n, u)")
def staged_proxy_stream(spark, sf):
    """Items and distinct items of the three streams: a quarter, a third and the rest, with their shares of distinct items."""
    s = T.staged_proxies(orders(spark, sf), 5_000, seed=3)
    return s.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("e").alias("u"))


@query("SELECT CASE WHEN id % 5 = 0 THEN 'apple' WHEN id % 7 = 0 THEN 'banana' WHEN id % 9 = 0 THEN 'orange' WHEN id % 11 = 0 THEN 'grape' ELSE 'other' END AS e, count(*) AS n FROM (SELECT unnest(range(10000)) AS id) GROUP BY 1")
def synthetic_words(spark, sf):
    i, fixed = F.col("seq"), ("apple", "banana", "orange", "grape")
    other = (i % 5 != 0) & (i % 7 != 0) & (i % 9 != 0) & (i % 11 != 0)
    return T.synthetic_words(spark).groupBy(F.when(other, "other").otherwise(F.col("e")).alias("e")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("e").isin(*fixed, "other"))


# ---- hard cases ------------------------------------------------------------------------------------------------------

_CASES = "SELECT c_name AS item, c_custkey AS expected, CAST(c_nationkey * 10 + c_custkey % 7 AS DOUBLE) AS score, c_mktsegment AS bucket FROM customer"


def _case_table(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_name").alias("item"), F.col("c_custkey").alias("expected"), (F.col("c_nationkey") * 10 + F.col("c_custkey") % 7).cast("double").alias("score"), F.col("c_mktsegment").alias("bucket"))


@query(f"WITH c AS ({_CASES}) SELECT item, expected, score, bucket FROM c ORDER BY score DESC, item LIMIT 48")
def hard_cases_topk(spark, sf):
    return C.hardest(_case_table(spark, sf), 48)


@query(f"WITH c AS ({_CASES}), b AS (SELECT item, expected, score * 0.85 AS score, bucket FROM c UNION ALL SELECT item, expected, score - 40, bucket FROM c WHERE expected % 2 = 0 AND score >= 40), m AS (SELECT item, max(score) AS score, any_value(expected) AS expected, any_value(bucket) AS bucket FROM b GROUP BY item) SELECT item, expected, score, bucket FROM m ORDER BY score DESC, item LIMIT 48")
def hard_case_merge_decay(spark, sf):
    old = _case_table(spark, sf)
    new = old.filter("expected % 2 = 0 and score >= 40").withColumn("score", F.col("score") - 40)
    return C.merge_cases(old, new, 48)


@query(f"WITH c AS ({_CASES}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY score DESC, item) AS INTEGER) AS turn FROM c), s AS (SELECT bucket, count(*) AS size FROM c GROUP BY bucket) SELECT item, expected, score, bucket, turn FROM r JOIN s USING (bucket) ORDER BY turn, size DESC, bucket LIMIT 23")
def bucket_round_robin(spark, sf):
    return C.round_robin(_case_table(spark, sf), 23)


@query(f"WITH {ORDERS}, f AS (SELECT e, count(*) AS n FROM orders_s GROUP BY e) SELECT e, n AS expected FROM f ORDER BY n DESC, e LIMIT 96")
def evaluation_items(spark, sf):
    """No case weighs in: the base set alone."""
    return C.evaluation_items(M.exact_frequency(orders(spark, sf)), _case_table(spark, sf), 96, 0.0)


@query(f"""WITH {ORDERS}, f AS (SELECT e, count(*) AS n FROM orders_s GROUP BY e), rk AS (SELECT e, n AS expected, row_number() OVER (ORDER BY n DESC, e) AS r FROM f),
c AS ({_CASES}), t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, item) AS turn FROM c), s AS (SELECT bucket, count(*) AS size FROM c GROUP BY bucket),
rr AS (SELECT item AS e, expected, turn, bucket FROM t JOIN s USING (bucket) ORDER BY turn, size DESC, bucket LIMIT 24),
ex AS (SELECT e, expected, row_number() OVER (ORDER BY turn, bucket) AS r FROM rr WHERE e NOT IN (SELECT e FROM rk WHERE r <= 72)),
u AS (SELECT e, expected, 0 AS o, r FROM rk WHERE r <= 72 UNION ALL SELECT e, expected, 1, r FROM ex UNION ALL SELECT e, expected, 2, r FROM rk WHERE r > 72 AND r <= 96 AND e NOT IN (SELECT e FROM ex))
SELECT e, expected FROM u ORDER BY o, r LIMIT 96""")
def evaluation_items_replayed(spark, sf):
    """A quarter of the places goes to replayed cases, bucket by bucket."""
    return C.evaluation_items(M.exact_frequency(orders(spark, sf)), _case_table(spark, sf), 96, 0.25)


# ---- populations -----------------------------------------------------------------------------------------------------

_POP = "pop AS (SELECT s_suppkey AS pid, round(s_acctbal / 1000) AS fit, abs(s_acctbal) AS err, s_suppkey % 17 AS birth, 'k' || s_nationkey AS key, CAST(s_nationkey % 4 AS INT) AS island FROM supplier)"


def _pop(spark, sf):
    t = table(spark, sf, "supplier")
    return t.select(F.col("s_suppkey").alias("pid"), F.round(F.col("s_acctbal") / 1000).alias("fit"), F.abs("s_acctbal").alias("err"), (F.col("s_suppkey") % 17).alias("birth"), F.concat(F.lit("k"), F.col("s_nationkey").cast("string")).alias("key"), (F.col("s_nationkey") % 4).cast("int").alias("island"))


@query(f"WITH {_POP}, c AS (SELECT key, greatest(count(*) - 2, 0) AS p FROM pop GROUP BY key) SELECT pid, CAST(row_number() OVER (ORDER BY p DESC, greatest(30 - birth, 0) DESC, fit, err DESC, pid) AS INTEGER) AS rank FROM pop JOIN c USING (key)")
def replacement_rank(spark, sf):
    return P.replacement_rank(_pop(spark, sf), 30).select("pid", "rank")


_BEST = "b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fit DESC, err, pid) AS r FROM pop)"


@query(f"WITH {_POP}, {_BEST} SELECT pid, key, fit FROM b WHERE r = 1 ORDER BY fit DESC, err, pid LIMIT 4")
def migration_pick_elite(spark, sf):
    return P.migration_elite(_pop(spark, sf), 8).select("pid", "key", "fit")


@query(f"""WITH {_POP}, {_BEST}, elite AS (SELECT pid, key, fit FROM b WHERE r = 1 ORDER BY fit DESC, err, pid LIMIT 4),
rest AS (SELECT pid, key, fit, md5(pid || '|5') AS h, row_number() OVER (PARTITION BY key ORDER BY md5(pid || '|5')) AS nth FROM pop WHERE pid NOT IN (SELECT pid FROM elite)),
u AS (SELECT pid, key, fit, 0 AS o, '' AS h FROM elite UNION ALL SELECT pid, key, fit, CASE WHEN nth > 1 OR key IN (SELECT key FROM elite) THEN 2 ELSE 1 END, h FROM rest)
SELECT pid, key, fit FROM u ORDER BY o, h LIMIT 8""")
def migration_pick(spark, sf):
    return P.migrants(_pop(spark, sf), 8, seed=5).select("pid", "key", "fit")


@query(f"WITH {_POP}, {_BEST} SELECT pid, key FROM b WHERE r = 1 ORDER BY fit DESC, err, island LIMIT 5")
def dedupe_canonical(spark, sf):
    return P.top_candidates(_pop(spark, sf), 5).select("pid", "key")


@query(f"WITH {_POP}, h AS (SELECT *, err / 10 AS holdout_err, min(err / 10) OVER () AS best FROM pop) SELECT pid, CASE WHEN holdout_err <= best + greatest(5.0, abs(best) * 0.1) THEN 0 ELSE 1 END AS bucket, CAST(row_number() OVER (ORDER BY CASE WHEN holdout_err <= best + greatest(5.0, abs(best) * 0.1) THEN 0 ELSE 1 END, fit DESC, err, pid) AS INTEGER) AS rank FROM h")
def holdout_rerank(spark, sf):
    return P.holdout_rerank(_pop(spark, sf).withColumn("holdout_err", F.col("err") / 10)).select("pid", "bucket", "rank")


@query(f"WITH {_POP}, a AS (SELECT * FROM pop WHERE birth <= (SELECT min(birth) FROM pop) + 3), b AS (SELECT * FROM a WHERE island <= (SELECT min(island) FROM a)) SELECT pid, fit FROM b")
def lexicase_filter(spark, sf):
    p = _pop(spark, sf).withColumn("case_vec", F.array(F.greatest(F.col("birth") - 3, F.lit(0)).cast("double"), F.col("island").cast("double")))
    return P.lexicase(p, [0, 1]).select("pid", "fit")


@query(f"WITH {_POP}, r AS (SELECT *, row_number() OVER (ORDER BY err, fit DESC, pid) AS r, count(*) OVER () AS n FROM pop) SELECT pid, r <= greatest(ceil(n * 0.6), 1) AS keep, CASE WHEN r <= greatest(ceil(n * 0.6), 1) THEN err ELSE err + 250000 END AS final_err FROM r")
def successive_halving(spark, sf):
    return P.halve(_pop(spark, sf), 0.6, 250_000.0).select("pid", "keep", "final_err")


@query(f"WITH {_POP}, a AS (SELECT key AS schema_hash, 'm' || island AS motif_key, err FROM pop), b AS (SELECT schema_hash, motif_key, min(err) AS err FROM a GROUP BY 1, 2) SELECT schema_hash, motif_key, err FROM b ORDER BY err, motif_key LIMIT 16")
def archive_topk(spark, sf):
    rows = _pop(spark, sf).select(F.col("key").alias("schema_hash"), F.concat(F.lit("m"), F.col("island").cast("string")).alias("motif_key"), "err", "pid")
    a, b = (rows.filter(F.col("pid") % 2 == k).drop("pid") for k in (0, 1))
    return P.archive_merge(a, b, 16)


@query(f"WITH {_POP}, a AS (SELECT key, max(pid) AS v FROM pop WHERE fit <= 5 GROUP BY key), b AS (SELECT key, max(pid) AS v FROM pop WHERE fit > 2 GROUP BY key) SELECT coalesce(b.key, a.key) AS key, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.key = b.key")
def incubator_upsert(spark, sf):
    """Two parts by fitness that overlap and together hold every row."""
    p = _pop(spark, sf)
    a, b = (p.filter(part).groupBy("key").agg(F.max("pid").alias("v")) for part in ("fit <= 5", "fit > 2"))
    return P.upsert(a, b, "key", "v")


@query(f"WITH {_POP} SELECT island, count(*) AS n, min(err) AS min_err, median(err) AS median_err, max(err) AS max_err, avg(fit) AS avg_fit, avg(err) AS avg_err FROM pop GROUP BY island")
def island_stats(spark, sf):
    return P.island_stats(_pop(spark, sf))


@query(f"WITH {_POP} SELECT min(pid) AS pid, key, birth FROM pop p WHERE NOT EXISTS (SELECT 1 FROM pop d WHERE d.fit > 4 AND d.key = p.key AND d.birth = p.birth) GROUP BY key, birth")
def unseen_candidates(spark, sf):
    """What is left to evaluate where the fitter programs have stored results."""
    p = _pop(spark, sf)
    return P.unseen(p.select("pid", "key", "birth"), p.filter("fit > 4"), "key", "birth")


@query(f"WITH {_POP}, x AS (SELECT key FROM pop WHERE fit < 3 GROUP BY key HAVING count(*) >= 2) SELECT pid, key AS basin FROM pop WHERE key NOT IN (SELECT key FROM x)")
def basin_blocklist(spark, sf):
    p = _pop(spark, sf).withColumnRenamed("key", "basin")
    return P.blocked(p.select("pid", "basin"), p.filter("fit < 3"), 2)


@query(f"""WITH {ORDERS}, f AS (SELECT DISTINCT e FROM orders_s), c AS ({_CASES}), h AS (SELECT item AS e, -score AS o FROM c ORDER BY score DESC, item LIMIT 20),
b AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r FROM f ORDER BY e LIMIT 64), i AS (SELECT unnest(range(80)) AS i),
m AS (SELECT i, b.e || '__absent__' || i AS e FROM i JOIN b ON b.r = i % (SELECT count(*) FROM b)), k AS (SELECT i, e FROM m WHERE e NOT IN (SELECT e FROM f) ORDER BY i LIMIT 16)
SELECT e, source FROM (SELECT e, 0 AS source, o FROM h UNION ALL SELECT e, 1, CAST(i AS DOUBLE) FROM k WHERE e NOT IN (SELECT e FROM h)) ORDER BY source, o, e LIMIT 30""")
def absent_eval_items(spark, sf):
    """Hard cases first, then keys that the stream lacks."""
    bank = M.absent_keys(M.exact_frequency(orders(spark, sf)), "absent", 16)
    return C.absent_items(C.hardest(_case_table(spark, sf), 20), bank, 30)


@query(f"WITH {_POP} SELECT 'island' AS axis, CAST(island AS VARCHAR) AS value, count(*) AS n FROM pop GROUP BY 2 UNION ALL SELECT 'key', key, count(*) FROM pop GROUP BY 2")
def family_histogram(spark, sf):
    return P.histogram(_pop(spark, sf), "island", "key")


@query(f"WITH {_POP}, c AS (SELECT key, count(*) AS c FROM pop GROUP BY key) SELECT count(*) AS unique_keys, max(c) AS max_cluster FROM c")
def cluster_summary(spark, sf):
    return P.cluster_summary(_pop(spark, sf))


@query(f"WITH {_POP} SELECT key, count(*) AS n FROM pop GROUP BY key ORDER BY n DESC, min(pid) LIMIT 1")
def mainstream_mode(spark, sf):
    return P.commonest(_pop(spark, sf), "key", "pid")


@query(f"WITH {_POP} SELECT pid, island FROM (SELECT *, row_number() OVER (PARTITION BY island ORDER BY pid DESC) AS r FROM pop) WHERE r <= 3")
def recency_window(spark, sf):
    return P.recent(_pop(spark, sf), "island", "pid", 3).select("pid", "island")


@query(f"WITH {_POP} SELECT 'island ' || island AS reason, count(*) AS n FROM pop GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def reject_reason_counts(spark, sf):
    return P.reject_reasons(_pop(spark, sf).select(F.concat(F.lit("island "), F.col("island").cast("string")).alias("reason")))


@query(f"WITH {_POP}, v AS (SELECT island AS pid, birth + 1.0 AS w, err AS a, fit AS b FROM pop) SELECT pid, 0 AS pos, sum(a * w) / sum(w) AS value FROM v GROUP BY pid UNION ALL SELECT pid, 1, sum(b * w) / sum(w) FROM v GROUP BY pid")
def weighted_case_mean(spark, sf):
    v = _pop(spark, sf).select(F.col("island").alias("pid"), (F.col("birth") + 1.0).alias("weight"), F.array("err", "fit").alias("case_vec"))
    return P.weighted_case_mean(v)


@query("SELECT n_nationkey AS pid, CASE WHEN n_nationkey % 3 = n_regionkey AND n_regionkey = n_nationkey % 2 THEN 0.0 WHEN n_nationkey % 3 <> n_regionkey AND n_regionkey <> n_nationkey % 2 AND n_nationkey % 3 <> n_nationkey % 2 THEN 1.0 ELSE -(2.0/3 * log2(2.0/3) + 1.0/3 * log2(1.0/3)) END AS h FROM nation")
def role_entropy(spark, sf):
    t = table(spark, sf, "nation")
    roles = F.array(*(c.cast("string") for c in (F.col("n_nationkey") % 3, F.col("n_regionkey"), F.col("n_nationkey") % 2)))
    return t.select(F.col("n_nationkey").alias("pid"), P.role_entropy(roles).alias("h"))


# ---- programs --------------------------------------------------------------------------------------------------------

_TEXTS = [(SAFE["init_dex"], u, q) for u, q in MECHANISM_PROGRAMS.values()] + [
    (DIAGONAL.init.text(), READ_WRITE.update.text(), sel(3)),
    ("list_3(hash_on_slice(0, e, 0, 4), select_hash(0, e), 102, 1, 2, 3, 4, 5, 6)", "base(update_state(e, 0, True), write_count(e, 1, query_count(e, 0)), 0)", "base_sel(1, query_date(e, 0), safe_min(1, 2), median3(1, 2, 3))"),
    ("list_3(hash_on_slice(0, e, 0, 4), 1, 102, 1, 2, 3, 4, 5, 6)", "base(update_count(e, 0, 1), update_count(e, 1, 1), 0)", "base_sel(2, query_date(e, 0), query_date(e, 1), 0)"),
    ("list_3(hash_salt(0, e, 1), hash_salt(0, e, 2), 102, hash_salt(1, e, 3), hash_salt(2, e, 4), 3, 4, 5, 6)", "base(updatecount_if(True, e, 0, 1), writecount_if(True, e, 1, 1), 0)", "base_sel(0, query_date(e, 0), query_date(e, 1), 0)"),
]
_VALUES = ", ".join(f"({i}, '{a}', '{b}', '{c}')" for i, (a, b, c) in enumerate(_TEXTS))
_N = lambda col, word: f"(length({col}) - length(replace({col}, '{word}(', ''))) // {len(word) + 1}"


@query(f"""WITH t AS (SELECT * FROM (VALUES {_VALUES}) v(pid, i, u, q)), n AS (SELECT pid,
 {_N('i', 'hash_on_slice')} + {_N('i', 'str_slice')} > 0 AS sl, {_N('i', 'select_hash')} > 0 AS se, {_N('i', 'hash_salt')} AS sa, ({_N('i', 'select_hash')} > 0)::INT + ({_N('i', 'hash_salt')} > 0)::INT + ({_N('i', 'hash_on_slice')} > 0)::INT AS kinds,
 {_N('u', 'update_count')} + {_N('u', 'write_count')} AS w, {_N('u', 'updatecount_if')} + {_N('u', 'writecount_if')} + {_N('u', 'writestate_if')} AS g, {_N('u', 'update_state')} + {_N('u', 'writestate_if')} > 0 AS st, {_N('u', 'query_count')} > 0 AND {_N('u', 'update_count')} + {_N('u', 'write_count')} + {_N('u', 'updatecount_if')} + {_N('u', 'writecount_if')} > 0 AS rb,
 {_N('q', 'cnt_rdstate')} > 0 AS qs, {_N('q', 'safe_min')} + {_N('q', 'safe_max')} + {_N('q', 'median3')} > 0 AS mx, q FROM t)
SELECT pid, CASE WHEN sl AND (se OR sa > 0) THEN 'hybrid-slice-init' WHEN sa >= 4 THEN 'layered-init' WHEN sl THEN 'slice-hash-init' WHEN kinds >= 2 THEN 'asymmetric-init' ELSE 'symmetric-init' END AS init_family,
 CASE WHEN st AND rb THEN 'rescue-write' WHEN st THEN 'stateful-write' WHEN g >= 2 AND w <= 1 THEN 'conditional-write' WHEN rb THEN 'read-before-write' WHEN w >= 3 OR g >= 3 THEN 'triple-write' WHEN w = 2 OR g = 2 THEN 'double-write' ELSE 'mixed-write' END AS update_family,
 CASE WHEN qs AND mx THEN 'fallback-query' WHEN mx THEN 'mixed-aggregator-query' WHEN qs THEN 'state-gated-query' WHEN contains(q, 'base_sel(0') THEN 'min-query' WHEN contains(q, 'base_sel(1') THEN 'max-query' WHEN contains(q, 'base_sel(2') THEN 'median-query' ELSE 'avg-query' END AS query_family FROM n""")
def family_tags(spark, sf):
    c = [K.Candidate(Program.parse(*t)) for t in _TEXTS]
    return K.describe(spark, c).select(F.substring("pid", 2, 4).cast("int").alias("pid"), "init_family", "update_family", "query_family")


@query()
def program_metadata(spark, sf):
    return K.describe(spark, [K.Candidate(Program.parse(*t)) for t in _TEXTS]).drop("lint")


@query(f"""WITH t AS (SELECT * FROM (VALUES {_VALUES}) v(pid, i, u, q)) SELECT pid, {_N('u', 'update_count')} + {_N('u', 'write_count')} + {_N('u', 'update_state')} AS writes,
{_N('u', 'updatecount_if')} + {_N('u', 'writecount_if')} + {_N('u', 'writestate_if')} AS guarded, {_N('u', 'query_count')} AS counter_reads, {_N('q', 'query_date')} AS reads, {_N('q', 'cnt_rdstate')} AS state_reads,
{_N('u', 'query_date')} + {_N('u', 'cnt_rdstate')} = 0 AS update_legal, {_N('q', 'update_count')} + {_N('q', 'write_count')} + {_N('q', 'query_count')} = 0 AS query_legal FROM t""")
def effect_counts(spark, sf):
    """What each program's parts read and write, and whether a part holds primitives of another."""
    rows = []
    for i, t in enumerate(_TEXTS):
        p = Program.parse(*t)
        u, q = effect_summary(p.update), effect_summary(p.query)
        rows.append((i, u["real_write_calls"], u["conditional_write_calls"], u["counter_read_calls"], q["query_date_calls"], q["state_read_calls"], not legality("update", p.update), not legality("query", p.query)))
    return spark.createDataFrame(rows, "pid int, writes long, guarded long, counter_reads long, reads long, state_reads long, update_legal boolean, query_legal boolean")


@query()
def motif_distance(spark, sf):
    """Distances of each program's motif to the first one's."""
    flat = [(i, *(str(v) for v in motif(Program.parse(*t)).values())) for i, t in enumerate(_TEXTS)]
    names = [f"m{k}" for k in range(len(flat[0]) - 1)]
    df = spark.createDataFrame(flat, ["pid", *names])
    return df.select("pid", P.flags_distance([F.col(n) for n in names], [F.lit(v) for v in flat[0][1:]]).alias("distance"))


# ---- evaluation, search, streaming -----------------------------------------------------------------------------------


def _workload(spark, sf) -> Workload:
    """All orders in order, as one stored stream of three stages."""
    return stored_workload(orders(spark, sf))


@query()
def evaluate_candidates(spark, sf):
    """Fitness, error, penalty, case vector and fingerprint of each program over three cumulative stages."""
    programs = K.program_table(spark, [K.Candidate(Program.parse(*t)) for t in _TEXTS])
    return evaluate_programs(programs, _workload(spark, sf))


@query()
def search_champions(spark, sf):
    """An island search with its defaults on the first four fifths of the orders; its champions with their errors on the
    rest, which the search has not seen."""
    stream = orders(spark, sf)
    items, taken = stored_stream(stream), like_absent(stream)
    cut = len(items) * 4 // 5
    w, held = workload_of(replace(items, stop=cut), taken), workload_of(replace(items, start=cut), taken)
    found = holdout(champions(search(spark, w, Config(seed=1)), 3), held)
    return spark.createDataFrame([(*m.texts, m.fit, m.err, h) for m, h in found], "init_dex string, update string, query string, fit double, err double, holdout_err double")


@query(cells_sql(salted(), "users_s") + " SELECT z, x, y, cnt, ovf FROM c")
def cells_streaming(spark, sf):
    """The cells of a stream read by Structured Streaming until nothing is left."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    live = spark.readStream.schema(schema).parquet(f"{path[:-3]}*").select(F.col("user_id").cast("string").alias("e")).filter("e is not null")
    name = f"cells_{uuid.uuid4().hex}"
    q = streaming_cells(live, salted()).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query(f"""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS e, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS start FROM events),
a AS ({Q.addresses_sql(salted(), "(SELECT DISTINCT e FROM u) k")}) SELECT start, z, x, y, count(*) AS cnt FROM u JOIN a USING (e) GROUP BY start, z, x, y""")
def cells_windowed(spark, sf):
    """An extension: cells of each week of event time."""
    t = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("e"))
    w = windowed_cells(t, salted(), "ts", "7 days", "1 day")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "z", "x", "y", "cnt")
