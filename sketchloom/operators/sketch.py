"""Sketches of streams: cells built by a program's update, estimates by its query.

Cells are a sparse table (z, x, y, cnt, ovf): planes * rows * cols of them at most, whatever the stream, so they are
the one side that is broadcast. A cell that is not there counts 0 and is not flagged."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grammar import COUNTER_MAX, PLANES, READS
from ..plans.lower import BigInteger, Lowering
from ..plans.nodes import Call, Const, Item, Node, walk
from ..plans.program import Effect, Plan, Program, classify, read_at
from ..plans.semantics import Machine, pure

CELLS = "z int, x int, y int, cnt long, ovf boolean"


UNORDERED = "sketchloom.unordered"


def stream_of(df: DataFrame, item: Column | str, *order: Column | str) -> DataFrame:
    """(seq, e) of any table: seq is the rank-free order struct of the given columns; rows without an item are dropped.

    A struct of the order columns sorts as they do, so no global numbering is needed. Rows of equal order follow each
    other by item. Without order columns only programs whose effects ask for no order can be built."""
    e = F.col(item) if isinstance(item, str) else item
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    seq = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(cols))) if cols else F.lit(None).cast("long")
    return df.select(seq.alias("seq", metadata={} if cols else {UNORDERED: True}), e.cast("string").alias("e")).filter("e is not null")


def need_order(stream: DataFrame) -> None:
    if stream.schema["seq"].metadata.get(UNORDERED):
        raise ValueError("the program's effects depend on the order of items, and the stream has no order columns")


def in_full_order(stream: DataFrame) -> DataFrame:
    """(seq, e) with seq unique: order, item and the number among rows equal in both, which are the same to a program."""
    need_order(stream)
    each = stream.groupBy("seq", "e").agg(F.count(F.lit(1)).alias("n")).select("seq", "e", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    return each.select(F.struct("seq", "e", "k").alias("seq"), "e")


def with_places(df: DataFrame, program: Program, keys: list[Node], item: str = "e") -> DataFrame:
    """The rows with columns x{k}_{z}, y{k}_{z}: the cells of the k-th key expression in each plane.

    Lowered to columns where 64 bits do; else evaluated by Arrow batches, best over distinct items."""
    try:
        made = {}
        for k, key in enumerate(keys):
            text = Lowering(program.dialect, F.col(item)).string(key)
            for z, (x, y) in enumerate(Lowering(program.dialect, text).places(program.init)):
                made |= {f"x{k}_{z}": x, f"y{k}_{z}": y}
        return df.withColumns(made)
    except BigInteger:
        pass
    names = [f"{a}{k}_{z}" for k in range(len(keys)) for z in range(PLANES) for a in "xy"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.IntegerType()) for n in names)])

    def run(batches):
        machine = Machine(program.dialect, program.init)
        texts = [machine.compile(k) for k in keys]
        for b in batches:
            rows = [[v for t in texts for xy in machine.places_of(t(e)) for v in xy] for e in b.column(b.schema.get_field_index(item)).to_pylist()]
            cols = [pa.array(c, pa.int32()) for c in zip(*rows)] if rows else [pa.array([], pa.int32()) for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def addresses(keys: DataFrame, program: Program) -> DataFrame:
    """(e, lane, z, x, y) of distinct items (e)."""
    placed = with_places(keys.select("e").distinct(), program, [Item()])
    lanes = F.array(*(F.struct(F.lit(z).alias("lane"), F.lit(z).alias("z"), F.col(f"x0_{z}").alias("x"), F.col(f"y0_{z}").alias("y")) for z in range(PLANES)))
    return placed.select("e", F.explode(lanes).alias("a")).select("e", "a.*")


def frequencies(stream: DataFrame) -> DataFrame:
    return stream.groupBy("e").agg(F.count(F.lit(1)).alias("n"))


# ---- building --------------------------------------------------------------------------------------------------------


def build_cells(stream: DataFrame, program: Program, plan: Plan | None = None) -> DataFrame:
    """The cells after the whole stream (seq, e). seq orders items where the program's effects depend on order; items of
    equal seq follow each other by name, and a stream of stream_of without order columns is refused."""
    program = program.simplified()
    plan = plan or classify(program)
    if plan.overall == "C4":
        return fold_cells(stream, program)
    if plan.overall in ("C0", "C2"):
        return summed_cells(frequencies(stream), program, plan)
    wanted = [z for z in plan.order if plan.classes[z] == "C3"]
    simple = Plan({z: c for z, c in plan.classes.items() if z not in wanted}, {z: e for z, e in plan.effects.items() if z not in wanted})
    parts = [last_states(h, z) for z, h in histories(stream, program, plan).items() if z in wanted]
    if simple.effects:
        parts.append(summed_cells(frequencies(stream), program, simple))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summed_cells(counts: DataFrame, program: Program, plan: Plan) -> DataFrame:
    """C0 and C2 planes from the counts (e, n) of distinct items: each item is hashed once."""
    keys = list(dict.fromkeys(e.key for es in plan.effects.values() for e in es))
    placed = with_places(counts, program, keys)
    rows = []
    for z, es in plan.effects.items():
        for e in es:
            k, v = keys.index(e.key), int(e.value.value)
            gain = F.col("n") * v if e.kind == "add" else F.lit(v if e.kind == "put" else 0).cast("long")
            flag = F.lit(bool(v) if e.kind == "mark" else False)
            rows.append(F.struct(F.lit(z).alias("z"), F.col(f"x{k}_{z}").alias("x"), F.col(f"y{k}_{z}").alias("y"), gain.alias("d"), flag.alias("f")))
    each = placed.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    put = [z for z, es in plan.effects.items() if es[0].kind != "add"]
    total = F.when(F.col("z").isin(put), F.max("d")).otherwise(F.sum("d")) if put else F.sum("d")
    summed = each.groupBy("z", "x", "y").agg(total.alias("s"), F.max("f").alias("f"))
    return summed.select("z", "x", "y", F.least("s", F.lit(COUNTER_MAX)).alias("cnt"), (F.col("f") | (F.col("s") > COUNTER_MAX)).alias("ovf"))


def merge_cells(*parts: DataFrame) -> DataFrame:
    """Cells of the union of streams, for C0 programs, whose cells add up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    s = out.groupBy("z", "x", "y").agg(F.sum("cnt").alias("s"), F.max("ovf").alias("o"))
    return s.select("z", "x", "y", F.least("s", F.lit(COUNTER_MAX)).alias("cnt"), (F.col("o") | (F.col("s") > COUNTER_MAX)).alias("ovf"))


def fold_cells(stream: DataFrame, program: Program, by: str | None = None) -> DataFrame:
    """C4: the machine applied to the items in order. One task per sketch; `by` names a column of sketches, each folded
    by itself. A task streams its rows and holds only cells, so its memory does not grow with the stream."""
    need_order(stream)

    def run(batches):
        now, machine = None, None

        def cells():
            places = sorted(machine.count.keys() | machine.flag.keys())
            cols = [*zip(*places), [machine.count.get(p, 0) for p in places], [bool(machine.flag.get(p)) for p in places]] if places else [[]] * 5
            kinds = pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()
            arrays, names = [pa.array(c, t) for c, t in zip(cols, kinds)], ["z", "x", "y", "cnt", "ovf"]
            if by:
                arrays, names = [pa.array([now] * len(places), pa.string()), *arrays], ["sketch_id", *names]
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            ids = b.column(0).to_pylist() if by else [None] * b.num_rows
            for i, e in zip(ids, b.column(b.num_columns - 1).to_pylist()):
                if machine is None or i != now:
                    if machine is not None:
                        yield cells()
                    now, machine = i, program.machine()
                machine.update(e)
        if machine is not None:
            yield cells()

    if by:
        ordered = stream.select(F.col(by).cast("string").alias("sketch_id"), "seq", "e").repartition("sketch_id").sortWithinPartitions("sketch_id", "seq", "e")
        return ordered.select("sketch_id", "e").mapInArrow(run, "sketch_id string, " + CELLS)
    return stream.repartition(1).sortWithinPartitions("seq", "e").select("e").mapInArrow(run, CELLS)


def histories(stream: DataFrame, program: Program, plan: Plan) -> dict[int, DataFrame]:
    """Per plane that a C3 plane is or reads: (x, y, seq, at, cnt, ovf) after each of its writes."""
    needed = {z for z in plan.order if plan.classes[z] == "C3"}
    needed |= {r.args[1].value for z in list(needed) for e in plan.effects[z] for r in e.reads()}
    keys = list(dict.fromkeys([e.key for z in plan.effects for e in plan.effects[z]] + [r.args[0] for z in plan.effects for e in plan.effects[z] for r in e.reads()]))
    # each distinct item is hashed once, and its places joined to the rows
    places = with_places(stream.select("e").distinct(), program, keys)
    base = in_full_order(stream.select("seq", "e")).join(places, "e")
    out: dict[int, DataFrame] = {}
    for z in plan.order:
        if z in needed:
            out[z] = plane_history(base, program, plan, z, keys, out)
    return out


def plane_history(base: DataFrame, program: Program, plan: Plan, z: int, keys: list[Node], upstream: dict[int, DataFrame]) -> DataFrame:
    es = plan.effects[z]
    reads = {read_at(r): r for e in es for r in e.reads() if r.args[1].value != z}
    rows = base
    for lane in sorted({r.args[1].value for r in reads.values()}):
        own = {at: r for at, r in reads.items() if r.args[1].value == lane}
        if lane not in upstream:  # a plane that nothing writes
            rows = rows.withColumns({f"r{at}": F.lit(0).cast("long") for at in own})
            continue
        told = upstream[lane].select(F.col("x").alias("at_x"), F.col("y").alias("at_y"), F.col("seq").alias("at_seq"), "at", (F.col("cnt") * 2 + F.col("ovf").cast("long")).alias("v"))
        w = W.partitionBy("at_x", "at_y").orderBy("at_seq", "at").rowsBetween(W.unboundedPreceding, 0)
        for at, r in own.items():
            # the rows go through the window themselves, so what they read need not be joined to them
            k = keys.index(r.args[0])
            asks = rows.select("*", F.col(f"x{k}_{lane}").alias("at_x"), F.col(f"y{k}_{lane}").alias("at_y"), F.col("seq").alias("at_seq"), F.lit(at).alias("at"), F.lit(None).cast("long").alias("v"))
            seen = asks.unionByName(told, allowMissingColumns=True).withColumn("v", F.last("v", ignorenulls=True).over(w)).filter("seq is not null")
            state = F.coalesce("v", F.lit(0).cast("long"))
            value = F.call_function("div", state, F.lit(2).cast("long")) if r.name in ("query_count", "query_date") else state % 2
            rows = seen.withColumn(f"r{at}", value).drop("at_x", "at_y", "at_seq", "at", "v")
    if z in plan.own:
        return own_history(rows, program, es, z, keys, sorted(reads))

    def column(e: Effect, node: Node, flag: bool = False) -> Column:
        low = Lowering(program.dialect, F.col("e"), lambda n: (F.col(f"r{read_at(n)}") if n.name in ("query_count", "query_date") else F.col(f"r{read_at(n)}") == 1, (0, COUNTER_MAX)))
        return low.boolean(node) if flag else low.integer(node)[0]

    events = None
    for e in es:
        k = keys.index(e.key)
        value = column(e, e.value, True).cast("long") if e.kind == "mark" else column(e, e.value)
        part = rows if e.condition is None else rows.filter(column(e, e.condition, True))
        part = part.select(F.col(f"x{k}_{z}").alias("x"), F.col(f"y{k}_{z}").alias("y"), "seq", F.lit(e.at).alias("at"), F.lit(e.kind).alias("kind"), value.alias("val"))
        events = part if events is None else events.unionByName(part)
    order = W.partitionBy("x", "y").orderBy("seq", "at").rowsBetween(W.unboundedPreceding, 0)
    since = W.partitionBy("x", "y", "put").orderBy("seq", "at").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumn("put", F.sum((F.col("kind") == "put").cast("int")).over(order))
    events = events.withColumn("s", F.sum(F.when(F.col("kind") == "mark", 0).otherwise(F.col("val"))).over(since))
    flag = F.when(F.col("kind") == "mark", F.col("val") != 0).otherwise(F.col("s") > COUNTER_MAX)
    return events.select("x", "y", "seq", "at", F.least("s", F.lit(COUNTER_MAX)).alias("cnt"), flag.alias("ovf"))


def own_history(rows: DataFrame, program: Program, es: list[Effect], z: int, keys: list[Node], reads: list[int]) -> DataFrame:
    """A plane whose writes read its own cell: cells are dealt to tasks, each streams its writes in order."""
    k = keys.index(es[0].key)
    told = F.array(*(F.col(f"r{at}").cast("long") for at in reads)) if reads else F.array().cast("array<long>")
    plain = rows.select(F.col(f"x{k}_{z}").alias("x"), F.col(f"y{k}_{z}").alias("y"), "seq", "e", told.alias("told"))
    table, geometry = pure(program.dialect.geometry), program.dialect.geometry

    def compiled(n: Node):
        if isinstance(n, Item):
            return lambda s: s["e"]
        if isinstance(n, Const):
            return lambda s: n.value
        if n.name in READS:
            at, flag = read_at(n), n.name in ("query_state", "cnt_rdstate")
            if n.args[1].value == z:
                return (lambda s: s["ovf"]) if flag else (lambda s: s["cnt"])
            i = reads.index(at)
            return (lambda s: bool(s["told"][i])) if flag else (lambda s: s["told"][i])
        args, f = [compiled(a) for a in n.args], table[n.name]
        return lambda s: f(*(a(s) for a in args))

    def run(batches):
        steps = [(e.kind, e.at, compiled(e.value), compiled(e.condition) if e.condition is not None else None) for e in es]
        state, now = {"cnt": 0, "ovf": False}, None
        for b in batches:
            out = []
            seqs = b.column(b.schema.get_field_index("seq"))
            for i, (x, y, e, told_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("x", "y", "e", "told")))):
                if now != (x, y):
                    now, state = (x, y), {"cnt": 0, "ovf": False}
                state["e"], state["told"] = e, told_
                for kind, at, value, condition in steps:
                    if condition is not None and not condition(state):
                        continue
                    v = value(state)
                    if kind == "mark":
                        state["ovf"] = bool(v)
                    else:
                        v = int(v) or int(geometry.zero_is_one and kind == "add")
                        v += state["cnt"] if kind == "add" else 0
                        state["cnt"], state["ovf"] = min(max(v, 0), COUNTER_MAX), v > COUNTER_MAX
                    out.append((x, y, i, at, state["cnt"], state["ovf"]))
            if out:
                c = list(zip(*out))
                kinds = pa.int32(), pa.int32(), None, pa.int32(), pa.int64(), pa.bool_()
                yield pa.RecordBatch.from_arrays([seqs.take(pa.array(v)) if t is None else pa.array(v, t) for v, t in zip(c, kinds)], ["x", "y", "seq", "at", "cnt", "ovf"])

    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("seq", rows.schema["seq"].dataType), T.StructField("at", T.IntegerType()), T.StructField("cnt", T.LongType()), T.StructField("ovf", T.BooleanType())])
    return plain.repartition("x", "y").sortWithinPartitions("x", "y", "seq").mapInArrow(run, schema)


def last_states(history: DataFrame, z: int) -> DataFrame:
    last = history.groupBy("x", "y").agg(F.max(F.struct("seq", "at", "cnt", "ovf")).alias("s"))
    return last.select(F.lit(z).alias("z"), "x", "y", "s.cnt", "s.ovf")


# ---- queries ---------------------------------------------------------------------------------------------------------


def estimates(keys: DataFrame, cells: DataFrame, program: Program) -> DataFrame:
    """The rows of keys (with a column e) and est, the query's estimate of each."""
    program = program.simplified()
    g = program.dialect.geometry
    reads = list(dict.fromkeys(n for n in walk(program.query) if isinstance(n, Call) and n.name in READS))
    wanted = list(dict.fromkeys((n.args[0], z) for n in reads for z in ([int(n.args[1].value) % PLANES] if isinstance(n.args[1], Const) else range(PLANES))))
    texts = list(dict.fromkeys(k for k, _ in wanted))
    rows = with_places(keys, program, texts)
    small = cells.select("z", "x", "y", "cnt", "ovf")
    for k, z in wanted:
        i = texts.index(k)
        own = small.filter(F.col("z") == z).select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.struct("cnt", "ovf").alias(f"c{i}_{z}"))
        rows = rows.join(F.broadcast(own), (F.col(f"x{i}_{z}") == F.col("cx")) & (F.col(f"y{i}_{z}") == F.col("cy")), "left").drop("cx", "cy")

    def state(n: Call, z: int) -> Column:
        c = F.col(f"c{texts.index(n.args[0])}_{z}")
        flag = F.coalesce(c["ovf"], F.lit(False))
        if n.name == "cnt_rdstate":
            return flag
        return F.when(flag, F.lit(g.overflow_read)).otherwise(F.coalesce(c["cnt"], F.lit(0).cast("long")))

    def read(n: Call):
        interval = (0, max(COUNTER_MAX, g.overflow_read))
        if isinstance(n.args[1], Const):
            return state(n, int(n.args[1].value) % PLANES), interval
        lane = F.pmod(low.integer(n.args[1])[0], F.lit(PLANES).cast("long"))
        return F.when(lane == 0, state(n, 0)).when(lane == 1, state(n, 1)).otherwise(state(n, 2)), interval

    low = Lowering(program.dialect, F.col("e"), read)
    try:
        est = low.integer(program.query)[0].cast("double")
        return rows.select(*(F.col(c) for c in keys.columns), est.alias("est"))
    except BigInteger:
        pass
    packed = [F.coalesce(F.col(f"c{texts.index(k)}_{z}")[c].cast("long"), F.lit(0).cast("long")) for k, z in wanted for c in ("cnt", "ovf")]
    plain = rows.select(*(F.col(c) for c in keys.columns), F.array(*packed).alias("__cells"))
    schema = T.StructType([*keys.schema.fields, T.StructField("est", T.DoubleType())])

    def run(batches):
        machine = Machine(program.dialect, program.init, None, program.query)
        compiled = [(machine.compile(k), z) for k, z in wanted]
        for b in batches:
            out = []
            for e, told in zip(b.column(b.schema.get_field_index("e")).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                for i, (key, z) in enumerate(compiled):
                    cell = machine.cell(key(e), z)
                    machine.count[cell], machine.flag[cell] = told[2 * i], bool(told[2 * i + 1])
                out.append(machine.query(e))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], [*b.schema.names[:-1], "est"])

    return plain.mapInArrow(run, schema)


class Sketch:
    """A program over a stream: build its cells, then ask.

    >>> Sketch(program).build(events, "user_id", "ts", "event_id").estimate(keys)"""

    def __init__(self, program: Program):
        self.program, self.plan, self.cells = program, classify(program), None

    def build(self, df: DataFrame, item: Column | str, *order: Column | str) -> Sketch:
        self.cells = build_cells(stream_of(df, item, *order), self.program, self.plan)
        return self

    def estimate(self, keys: DataFrame) -> DataFrame:
        return estimates(keys, self.cells, self.program)
