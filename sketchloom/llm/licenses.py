"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over word n-grams, made sparse by an L1 penalty, is trained on the templates below
and on a bounded sample of the corpus's own paragraphs as the unknown class. Its probabilities are calibrated on
held-out rows. Scoring runs in DataFrame functions only. A paragraph is a run of lines with words; where it has enough
word pairs of a template, the lines that hold the notice are looked for in it, whether it is wrapped or not."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_or_null, materialize
from .decontamination import run_hash, shingles, words

UNKNOWN = "unknown"
#: Lines of the corpus that the unknown class is trained on, in hash order of their places.
SAMPLE = 3_000
#: n-grams in more than this share of sampled lines tell nothing and are no features.
COMMON = 0.01
#: The share of the n-grams of a template's notice that its lines must have to confirm the prediction.
CONFIRM = 0.6
#: What a further line must add to the share of a span: less than one word pair of the longest template.
LINE_COST = 0.01

# The wording of common licence notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def plain_words(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def ngrams(w: list[str]) -> set[str]:
    return {*w, *map(" ".join, zip(w, w[1:]))}


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text), line_no and line of each line."""
    own = columns_or_null(docs, doc_id="long", text="string").filter("text is not null and doc_id is not null")
    return own.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def known_grams(templates: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """(gram, templates of which it is a word pair) for all n-grams of the templates."""
    own = {g: [] for _, text in templates for g in ngrams(plain_words(text))}
    for t, (_, text) in enumerate(templates):
        for g in template_pairs(text):
            own[g].append(t)
    return sorted(own.items())


def template_pairs(text: str) -> set[str]:
    w = plain_words(text)
    return set(map(" ".join, zip(w, w[1:])))


def notice_paragraphs(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """doc_id, version, line_no, run, w and ahead (the last word of the line before in the run): the lines of each
    paragraph, a run of lines with words, that has CONFIRM of the word pairs of some template, wrapped or not."""
    pairs = F.broadcast(docs.sparkSession.createDataFrame([(g, of) for g, of in known_grams(templates) if of], "gram string, templates array<int>"))
    sizes = [max(1, len(template_pairs(text))) for _, text in templates]

    def holding(grams: DataFrame, *key: str, pairs: DataFrame = pairs) -> DataFrame:
        hits = grams.join(pairs, "gram").dropDuplicates([*key, "gram"]).select(*key, F.explode("templates").alias("t"))
        least = F.element_at(F.array(*(F.lit(CONFIRM * n - 1e-9) for n in sizes)), F.col("t") + 1)
        return hits.groupBy(*key, "t").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).select(*key).distinct()

    own = columns_or_null(docs, doc_id="long", text="string").filter("text is not null and doc_id is not null").withColumn("version", F.xxhash64("text"))
    # the pairs of a paragraph are among those of its text, which are looked up by their hashes
    two = F.split("gram", " ")
    hashed = F.broadcast(pairs.select(F.xxhash64(two[0], two[1]).alias("gram"), "templates"))
    runs = own.select("doc_id", "version", words("text").alias("w")).select("doc_id", "version", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0)))).alias("i"))
    texts = holding(runs.select("doc_id", "version", run_hash("w", F.col("i"), 2).alias("gram")), "doc_id", "version", pairs=hashed)
    found = materialize(own.join(texts, ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]), "license-texts")
    lines = numbered_lines(found).withColumn("w", words("line")).drop("line")
    at = W.partitionBy("doc_id", "version").orderBy("line_no")
    lines = lines.withColumn("run", F.sum((F.size("w") == 0).cast("int")).over(at)).withColumn("ahead", F.get(F.lag("w").over(at), F.size(F.lag("w").over(at)) - 1))
    lines = materialize(lines.filter(F.size("w") > 0), "license-lines")
    key = ["doc_id", "version", "run"]
    joined = lines.select(*key, F.concat(F.array_compact(F.array("ahead")), "w").alias("w")).select(*key, F.explode(shingles("w", 2)).alias("gram"))
    return materialize(lines.join(holding(joined, *key), key, "left_semi"), "license-paragraphs")


@dataclass
class LicenseModel:
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def training_rows(templates: list[tuple[str, str]], negatives: list[list[str]], seed: int, copies: int = 24) -> list[tuple[str, list[str]]]:
    """Each template whole, with words lost, and among words of the corpus; and the sampled paragraphs."""
    rng = np.random.default_rng(seed)
    pool = sorted({x for w in negatives for x in w}) or ["text"]
    rows = [(UNKNOWN, w) for w in negatives]
    for family, text in templates:
        w = plain_words(text)
        for k in range(copies):
            own = [x for x in w if k == 0 or rng.random() > 0.06]
            extra = [str(x) for x in rng.choice(pool, rng.integers(0, 12))] if k else []
            cut = int(rng.integers(0, len(extra) + 1))
            rows.append((family, extra[:cut] + own + extra[cut:]))
    # parts of notices, and their words out of order, are no notice
    for k in range(4):
        for _, text in templates:
            w = plain_words(text)
            some = [str(x) for x in rng.permutation(w)[: max(1, len(w) // 4)]]
            rows.append((UNKNOWN, some + [str(x) for x in rng.choice(pool, 10)]))
    return rows


def train(negatives: list[list[str]], templates=TEMPLATES, l1: float = 2e-4, rounds: int = 400, seed: int = 11) -> LicenseModel:
    """Fit by proximal gradient steps; every fourth row is held out to calibrate temperature and threshold."""
    share = {}
    for w in negatives:
        for g in ngrams(w):
            share[g] = share.get(g, 0) + 1
    most = COMMON * max(1, len(negatives))
    vocabulary = sorted({g for _, t in templates for g in ngrams(plain_words(t)) if share.get(g, 0) <= most})
    place = {g: i for i, g in enumerate(vocabulary)}
    families = [UNKNOWN, *dict.fromkeys(f for f, _ in templates)]
    rows = training_rows(templates, negatives, seed)
    x, y = np.zeros((len(rows), len(vocabulary)), np.float32), np.zeros(len(rows), np.int64)
    for i, (family, w) in enumerate(rows):
        y[i] = families.index(family)
        for g in ngrams(w):
            if g in place:
                x[i, place[g]] = 1
    held = np.arange(len(rows)) % 4 == 3
    weight = 1.0 / np.bincount(y, minlength=len(families)).clip(1)[y]
    model = LicenseModel(families, vocabulary, np.zeros((len(vocabulary), len(families))), np.zeros(len(families)), 1.0, 0.5)
    xt, yt, wt = x[~held], y[~held], weight[~held] / weight[~held].sum()
    target = np.eye(len(families))[yt]
    step = 8.0
    mv, last = model.weights.copy(), model.weights.copy()
    for k in range(rounds):
        model.weights = mv
        gradient = (model.probabilities(xt) - target) * wt[:, None]
        new = mv - step * (xt.T @ gradient)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        model.bias = model.bias - step * gradient.sum(axis=0)
        mv, last = new + k / (k + 3) * (new - last), new
    model.weights = last
    grid = np.array([0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5])
    loss = []
    for t in grid:
        model.temperature = float(t)
        loss.append(-(weight[held] * np.log(model.probabilities(x[held])[np.arange(held.sum()), y[held]] + 1e-12)).sum())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = model.probabilities(x[held])
    best, right = p[:, 1:].max(axis=1), (p[:, 1:].argmax(axis=1) + 1 == y[held]) & (y[held] > 0)
    cuts = np.linspace(0.3, 0.95, 27)
    unknown = y[held] == 0
    gain = [(right & (best >= c)).sum() / max(1, (~unknown).sum()) + (unknown & (best < c)).sum() / max(1, unknown.sum()) for c in cuts]
    top = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    model.threshold = float(cuts[top[len(top) // 2]])
    return model


def unlabelled(docs: DataFrame, notices: DataFrame, sample: int) -> list[list[str]]:
    """The words of so many lines, in hash order of their places, that stand in no paragraph of notices and have no word
    starting with licen or copyright."""
    letters = r"\p{L}\p{M}\p{N}"
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "line_no"), 1)
    every = numbered_lines(docs).withColumn("place", place)
    order, n = ["place", "doc_id", "line_no", "version"], max(1, docs.count())
    share = sample / (4 * n)
    while True:
        # the first lines of the order, about as many as are asked for, so that few are sorted
        near = every if share >= 1 else every.filter(F.col("place") < F.lit(int(share * (1 << 63))))
        drawn = near.filter(F.col("line").rlike(f"[{letters}]") & ~F.lower("line").rlike(f"(?<![{letters}])(licen|copyright)"))
        kept = drawn.join(notices.select("doc_id", "version", "line_no"), ["doc_id", "version", "line_no"], "left_anti")
        rows = kept.orderBy(*order).limit(sample).select(words("line")).collect()
        if len(rows) >= sample or share >= 1:
            return [list(r[0]) for r in rows]
        share *= 4


def spans(grams: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, version, run, s, e, t, share, held): for each first line s of a paragraph and template t the last line e whose
    lines from s to e have most of its word pairs, fewest lines first, if they reach CONFIRM."""
    sizes = F.array(*(F.lit(float(max(1, len(template_pairs(text))))) for _, text in templates))
    key = ["doc_id", "version", "run", "s", "t"]
    own = grams.select("doc_id", "version", "run", "s", "line_no", F.explode("templates").alias("t"))
    own = own.withColumn("held", F.count(F.lit(1)).over(W.partitionBy(*key).orderBy("line_no")))
    own = own.withColumn("share", F.col("held") / F.element_at(sizes, F.col("t") + 1)).filter(F.col("share") >= CONFIRM - 1e-9)
    best = F.max_by(F.struct("line_no", "share", "held"), F.struct(F.col("share") - LINE_COST * (F.col("line_no") - F.col("s")), -F.col("line_no")))
    return own.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.line_no").alias("e"), F.col("b.share").alias("share"), F.col("b.held").alias("held"))


def license_scan(docs: DataFrame, templates=TEMPLATES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, line_no, last_line, family, probability and template_share of each licence notice, which stands in the
    lines line_no to last_line of a paragraph (a run of lines with words).

    family is the classifier's most probable one for these lines, where its calibrated probability reaches the threshold
    and a template of that family has at least CONFIRM of its word pairs in them; all else is of unknown family and not
    returned. Of overlapping lines of one family those with most word pairs of a template are taken, the fewest of these. Whole texts
    are scanned. A null or empty text has no paragraphs; equal rows of one doc_id count as one; rows without a doc_id
    are left out. An empty table gives an empty result; further columns are ignored."""
    spark = docs.sparkSession
    notices = notice_paragraphs(docs, templates)
    model = train(unlabelled(docs, notices, sample), templates)
    told = {model.vocabulary[i]: model.weights[i].tolist() for i in np.flatnonzero(np.abs(model.weights).sum(axis=1) > 0)}
    gone = [0.0] * len(model.families)
    # bounded by the templates: a few thousand n-grams
    known = F.broadcast(spark.createDataFrame([(g, told.get(g, gone), of) for g, of in known_grams(templates)], "gram string, weights array<double>, templates array<int>"))

    # each n-gram of a line counts for all first lines from which a notice of one word a line could reach it
    longest = max(len(plain_words(text)) for _, text in templates)
    none = F.array().cast("array<string>")
    own = F.concat("w", F.when(F.size("w") > 1, shingles("w", 2)).otherwise(none))
    across = F.when(F.col("ahead").isNotNull(), F.array(F.concat_ws(" ", "ahead", F.get("w", F.lit(0))))).otherwise(none)
    key = ["doc_id", "version", "run"]
    marked = notices.select(*key, "line_no", F.explode(F.concat(F.transform(own, lambda g: F.struct(g.alias("gram"), F.lit(0).alias("back"))), F.transform(across, lambda g: F.struct(g.alias("gram"), F.lit(1).alias("back"))))).alias("x"))
    hits = materialize(marked.select(*key, "line_no", F.col("x.gram").alias("gram"), F.col("x.back").alias("back")).join(known.select("gram"), "gram"), "license-hits")
    first = hits.select(*key, F.col("line_no").alias("s")).distinct()
    starts = F.sequence(F.col("line_no") - (longest - 1), F.col("line_no") - F.col("back"))
    reach = hits.select(*key, "gram", "line_no", F.explode(starts).alias("s")).join(first, [*key, "s"], "left_semi")
    grams = reach.groupBy(*key, "s", "gram").agg(F.min("line_no").alias("line_no")).join(known, "gram")
    grams = materialize(grams, "license-grams")

    found = spans(grams, templates)
    k = len(model.families)
    scored = found.join(grams.select(*key, "s", F.col("line_no").alias("at"), "weights"), [*key, "s"]).filter("at <= e")
    scored = scored.groupBy(*key, "s", "e", "t", "share", "held").agg(*(F.sum(F.col("weights")[i]).alias(f"z{i}") for i in range(k)))
    z = [(F.col(f"z{i}") + F.lit(float(model.bias[i]))) / F.lit(model.temperature) for i in range(k)]
    scored = scored.select("doc_id", "s", "e", "t", "share", "held", F.array(*z).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    best = F.array_max(F.slice("z", 2, k - 1))
    scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, model.families)), F.array_position("z", best).cast("int")))
    scored = scored.withColumn("probability", F.exp(best - top) / total)
    same = F.element_at(F.array(*(F.lit(f) for f, _ in templates)), F.col("t") + 1) == F.col("family")
    sure = scored.filter(same & (F.col("family") != UNKNOWN) & (F.col("probability") >= F.lit(model.threshold)))
    ranked = sure.groupBy("doc_id", "family").agg(F.sort_array(F.collect_set(F.struct((-F.col("held")).alias("order"), (F.col("e") - F.col("s")).alias("more"), "s", "e", "probability", "share"))).alias("c"))
    empty = F.slice("c", F.lit(1), F.lit(0))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["s"] <= y["e"]) & (y["s"] <= x["e"]))
    ranked = ranked.select("doc_id", "family", F.explode(F.aggregate("c", empty, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))).alias("x"))
    return ranked.select("doc_id", F.col("x.s").alias("line_no"), F.col("x.e").alias("last_line"), "family", F.col("x.probability").alias("probability"), F.col("x.share").alias("template_share"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs of all documents. A null or empty text has none; long texts are scanned whole; repeated rows of a
    doc_id count as one; rows without a doc_id are left out; an empty table gives no rows."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
