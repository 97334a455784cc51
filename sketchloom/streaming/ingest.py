"""Sketches of unbounded streams with Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sketch import frequencies, summed_cells, with_places
from ..plans.program import Program, classify


def streaming_cells(stream: DataFrame, program: Program) -> DataFrame:
    """Cells of a C0 or C2 program over a streaming (e): state is one row per cell, so it is bounded by the geometry.

    Write it in complete or update mode. Planes of other classes need an order and go through streaming_fold."""
    program = program.simplified()
    plan = classify(program)
    if plan.overall not in ("C0", "C2"):
        raise ValueError(f"{plan.overall} programs need streaming_fold: {plan.reason or 'their effects depend on order'}")
    # one item is one count of itself here: distinct items are not bounded, cells are
    return summed_cells(stream.select("e", F.lit(1).cast("long").alias("n")), program, plan)


def windowed_cells(stream: DataFrame, program: Program, ts: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """An extension: cells of each window of event time; state of a window goes once its watermark has passed."""
    program = program.simplified()
    plan = classify(program)
    if plan.overall != "C0":
        raise ValueError("windowed cells are for C0 programs")
    placed = with_places(stream.withWatermark(ts, late), program, list(dict.fromkeys(e.key for es in plan.effects.values() for e in es)))
    keys = list(dict.fromkeys(e.key for es in plan.effects.values() for e in es))
    rows = [F.struct(F.lit(z).alias("z"), F.col(f"x{keys.index(e.key)}_{z}").alias("x"), F.col(f"y{keys.index(e.key)}_{z}").alias("y"), F.lit(int(e.value.value)).cast("long").alias("d")) for z, es in plan.effects.items() for e in es]
    each = placed.select(F.window(ts, width, slide).alias("window"), F.explode(F.array(*rows)).alias("r"))
    return each.groupBy("window", "r.z", "r.x", "r.y").agg(F.sum("r.d").alias("cnt"))


def streaming_fold(stream: DataFrame, program: Program, sketch: str | Column, order: str) -> DataFrame:
    """(sketch_id, z, x, y, cnt, ovf) after each batch, for programs of any class over a streaming table with e.

    State of a sketch is its cells. A batch is applied in the order of the given column; order across batches is that
    of their arrival. Many sketches run side by side, one is a single task, as its items depend on each other."""
    init, update, query, dialect = program.init, program.update, program.query, program.dialect

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = Program(init, update, query, dialect).machine()
        if state.exists:
            machine.count.update(pickle.loads(state.get[0]))
            machine.flag.update(pickle.loads(state.get[1]))
        rows = pd.concat(list(pdfs)).sort_values("o", kind="stable")
        for e in rows["e"]:
            machine.update(e)
        state.update((pickle.dumps(dict(machine.count)), pickle.dumps(dict(machine.flag))))
        cells = sorted(machine.count.keys() | machine.flag.keys())
        yield pd.DataFrame([(key[0], *c, machine.count.get(c, 0), bool(machine.flag.get(c))) for c in cells], columns=["sketch_id", "z", "x", "y", "cnt", "ovf"])

    name = F.col(sketch) if isinstance(sketch, str) else sketch
    own = stream.select(name.cast("string").alias("sketch_id"), F.col(order).alias("o"), "e").filter("e is not null")
    return own.groupBy("sketch_id").applyInPandasWithState(step, "sketch_id string, z int, x int, y int, cnt long, ovf boolean", "count binary, flag binary", "update", "NoTimeout")


def batch_cells(stream: DataFrame, program: Program) -> DataFrame:
    """The batch plan of the same cells, for comparison."""
    program = program.simplified()
    return summed_cells(frequencies(stream), program, classify(program))
