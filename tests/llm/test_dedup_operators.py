"""Repeat removal, SimHash, line dedup and decontamination against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sketchloom.llm import common, decontamination, lines, simhash, suffix_dedup


def plain_repeats(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length, chunk", [(50, 1 << 21), (50, 900), (24, 4000)])
def test_repeats(corpus, docs, length, chunk):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, length, chunk=chunk).collect()}
    assert got == plain_repeats(corpus, length)


def test_repeats_edges(nothing, clashing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    rows = suffix_dedup.remove_repeats(clashing, keep_text=True).collect()
    twice = [r for r in rows if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1] and twice[0].n_removed == 0
    assert sum(r.doc_id is None for r in rows) == 1
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(nothing, 8)


def test_records_cover_each_window_once():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 4, 60):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        offsets = np.array([0, 10, 700, 749, 800, 3000])
        _, first, last = suffix_dedup.records(data, offsets)
        got = sorted(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]).tolist())
        assert got == [p for s, e in zip(offsets, offsets[1:]) for p in range(s, e - 49)]


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, near):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in near:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(corpus, docs):
    fp = {i: plain_fingerprint(t) for i, t in corpus if t is None or len(t) < 5000}
    got = {r.doc_id: r for r in simhash.simhash_components(docs.filter("text is null or length(text) < 5000")).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fp
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == plain_components(fp, near)


def test_simhash_edges(nothing, clashing):
    assert simhash.simhash_components(nothing).count() == 0
    rows = simhash.simhash_components(clashing).collect()
    assert len(rows) == clashing.count() and all(r.component_id is not None for r in rows)
    kept = simhash.keep_first_of_group(clashing)
    assert kept.columns == clashing.columns and kept.filter("doc_id is null").count() == 1


def test_links_of_one_posting(monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 60:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(32)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = [(a, b) for a in range(60) for b in range(60) if a < b and int(fps[a] ^ fps[b]).bit_count() <= 4]
    want = plain_components(range(60), near)
    for limit in (simhash.BLOCKWISE, 10):
        monkeypatch.setattr(simhash, "BLOCKWISE", limit)
        u, v = simhash.posting_links(fps)
        place = {int(x): i for i, x in enumerate(fps)}
        assert plain_components(range(60), [(place[int(a)], place[int(b)]) for a, b in zip(u, v)]) == want


def test_tallies_reject_pairs():
    """Pairs of one posting that share its three bytes only are not verified; the tally equals a plain count."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    x[::3] &= np.uint64(0x00FF00FFFF000000)
    plain = (x[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    assert (simhash.shared_bytes(x) == plain).all()
    posting = (rng.integers(0, 1 << 40, 300, dtype=np.uint64) << np.uint64(24)) | np.uint64(0x123456)
    tallies = simhash.shared_bytes(posting[:, None] ^ posting[None, :])
    assert tallies.min() == 3 and (tallies < simhash.MIN_MATCHES).mean() > 0.9
    for _ in range(200):
        bits = rng.choice(64, 4, replace=False)
        assert simhash.shared_bytes(np.array([sum(1 << int(b) for b in bits)], np.uint64))[0] >= simhash.MIN_MATCHES


def test_links_find_all_near_pairs(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps += [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for x in fps]
    own = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in own], "fp long")
    near = [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 4]
    got = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df).collect()]
    assert plain_components(own, got) == plain_components(own, near)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == plain_components(nodes, edges)
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def line_set(line):
    return {line[i : i + lines.SHINGLE] for i in range(max(1, len(line) - lines.SHINGLE + 1))}


def test_lines(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(30)) for _ in range(20)]
    rows, line_at = [], {}
    for d in range(30):
        own = []
        for _ in range(4):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = word()
            own.append(" ".join(w))
        own.insert(2, rng.choice(["", "  ", "short one", own[0]]))
        rows.append((d, "\n".join(own)))
        line_at |= {(d, k): x for k, x in enumerate(own)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = {at: x for at, x in line_at.items() if x.strip()}
    near = []
    for a in real:
        for b in real:
            if a < b:
                x, y = line_set(real[a]), line_set(real[b])
                if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                    near.append((a, b))
    want = {d: sorted(k for (e, k), root in plain_components(real, near).items() if e == d and root != (e, k)) for d in range(30)}
    got = {r.doc_id: sorted(r.removed) for r in lines.line_decisions(docs).collect()}
    assert got == want
    text = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert text == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t in rows}


def test_lines_of_one_template(spark):
    """Twins around one template: all share its bands, but only twins are similar enough."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    template, texts = [word() for _ in range(36)], []
    for _ in range(150):
        w = list(template)
        for k in rng.sample(range(36), 3):
            w[k] = word()
        twin = list(w)
        twin[rng.randrange(36)] = word()
        texts += [" ".join(w), " ".join(twin)]
    rng.shuffle(texts)
    sets = [line_set(x) for x in texts]
    near = [(a, b) for b in range(300) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in lines.line_decisions(docs).collect() if r.removed}
    roots = plain_components(range(300), near)
    assert got == {a for a in range(300) if roots[a] != a} and 100 < len(got) < 200


def test_shingle_hashes_are_worked_out_once(spark):
    """Not once more for each condition of the filter behind them."""
    rows = [(1, b"x", 40, 2**59, "a line of forty characters, more or less"), (2, b"y", 5, 2**60 - 1, "short")]
    every = spark.createDataFrame(rows, "node long, digest binary, n int, cut long, line string")
    found = lines.looked_at(every)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1
    assert {r.node for r in found.collect()} == {1, 2} and "row" not in found.columns


def test_lines_are_fetched_from_texts_that_hold_them(spark):
    """Also of ids below zero; texts that hold none are not split."""
    docs = spark.createDataFrame([(-3, "a\nb"), (5, "c\nd\ne"), (None, "f"), (6, None)], "doc_id long, text string")
    needed = spark.createDataFrame([(-3 * lines.LINES + 1, "x"), (5 * lines.LINES, "y"), (5 * lines.LINES + 2, "z")], "node long, more string")
    for wide in (False, True):
        found = lines.fetched(needed, docs, wide)
        assert sorted((r.line, r.more) for r in found.collect()) == [("b", "x"), ("c", "y"), ("e", "z")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") > plan.index("split(")  # nearer to the table


def test_lines_of_any_script_and_length(spark):
    """Against all pairs of plain sets: no word starts, no least size."""
    rng = random.Random(17)
    cjk, ascii_ = [chr(c) for c in range(0x4E00, 0x4F80)], "abcdefghijklmnop0123456789"
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for k in range(12):
        long = [run(cjk, 150), "\t".join(run(ascii_, 6) for _ in range(22)), "https://x.org/" + run(ascii_, 130), "😀" + run(cjk, 140)]
        texts += long + [t[:70] + "Z" + t[71:] for t in long]
        short = run(ascii_, 16) + f" {k}"
        texts += [short, short + "x", "  " + short, " ".join(run(ascii_, 5) for _ in range(4)), run(ascii_, 12), run(ascii_, 5)]
    texts += ["a b c d e f g h", "  a b c d e f g h", "    a b c d e f g h", "a" * 15, "a" * 30, "b c", " b c"]
    rng.shuffle(texts)
    sets = [{x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))} for x in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in lines.line_decisions(docs).collect() if r.removed}
    roots = plain_components(range(len(texts)), near)
    assert got == {a for a in range(len(texts)) if roots[a] != a} and len(got) > 50


def test_lines_of_many_repeats(spark, monkeypatch):
    """Long lines that repeat themselves, whose least hashes are few, and long lines that do not."""
    rng = random.Random(23)
    run = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = []
    for k in range(8):
        phrase, long = run(20 + 9 * k), run(1500)
        texts += [phrase * 40, (phrase[5:] + phrase[:5]) * 40, phrase * 30 + "Z", long, long[:700] + "Z" + long[701:], run(900) + long[:600]]
    texts += ["=" * 300, "=" * 500, "- " * 100, "- " * 150 + "x"]
    rng.shuffle(texts)
    sets = [line_set(x) for x in texts]
    near = [(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    roots = plain_components(range(len(texts)), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for broadcast in (lines.BROADCAST_LINES, 0):
        monkeypatch.setattr(lines, "BROADCAST_LINES", broadcast)
        got = {r.doc_id for r in lines.line_decisions(docs).collect() if r.removed}
        assert got == {a for a in range(len(texts)) if roots[a] != a} and len(got) > 20


def test_lines_of_a_large_band(spark, monkeypatch):
    """One template line in 800 wordings, 400 of them copies with one word changed: bands are cut into runs."""
    monkeypatch.setattr(lines, "RUN", 50)
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    template, texts = [word() for _ in range(40)], []
    for _ in range(400):
        w = list(template)
        for k in rng.sample(range(40), 3):
            w[k] = word()
        twin = list(w)
        twin[rng.randrange(40)] = word()
        texts += [" ".join(w), " ".join(twin)]
    rng.shuffle(texts)
    sets = [line_set(x) for x in texts]
    near = [(a, b) for b in range(800) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    got = {r.doc_id for r in lines.line_decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.removed}
    roots = plain_components(range(800), near)
    want = {a for a in range(800) if roots[a] != a}
    assert not got - want and len(got) >= 0.99 * len(want) and len(want) >= 390


@pytest.mark.parametrize("full, outside", [(4, 2), (4, 256), (32, 256)])
def test_lines_of_split_bands(spark, monkeypatch, full, outside):
    """Bands of several components: by sketches alone, by outsiders, by prefix filters."""
    monkeypatch.setattr(lines, "FULL", full)
    monkeypatch.setattr(lines, "OUTSIDE", outside)
    rng = random.Random(53)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    texts = []
    for _ in range(4):
        template = [word() for _ in range(36)]
        for k in range(40):
            w = list(template)
            for j in rng.sample(range(36), 1 + k % 4):
                w[j] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [line_set(x) for x in texts]
    near = [(a, b) for b in range(160) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    roots = plain_components(range(160), near)
    got = {r.doc_id for r in lines.line_decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.removed}
    assert got == {a for a in range(160) if roots[a] != a} and 20 < len(got) < 156


def test_sketches_reject_no_similar_pair(spark):
    """Repeats within a line included; few pairs that are not similar get past."""
    rng = random.Random(59)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage, texts = " ".join(word() for _ in range(20)), []
    for k in range(40):
        own = [word() for _ in range(10 + k)] * (1 + k % 3)
        texts += [" ".join(own) + " " + passage, " ".join(own[1:]) + " " + passage, passage + " " + word() * 3]
    sets = [line_set(x) for x in texts]
    sketch = lines.sketches(spark.createDataFrame(list(enumerate(texts)), "node long, line string"))
    assert {r.node: r.n for r in sketch.collect()} == {k: len(x) for k, x in enumerate(sets)}
    every = [(a, b) for a in range(len(texts)) for b in range(a)]
    near = {(a, b) for a, b in every if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = {(r.u, r.v) for r in lines.close_pairs(spark.createDataFrame(every, "u long, v long"), sketch).collect()}
    assert near <= got and len(near) > 40 and len(got) < 2 * len(near) + 200


def test_lines_edges(nothing, clashing):
    assert lines.dedup_lines(nothing).count() == 0 and lines.line_decisions(nothing).count() == 0
    out = lines.dedup_lines(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[60].text == "" and by[60].n_chars == 0 and by[0].text is not None
    assert out.filter("text is null").count() == clashing.filter("text is null").count()
    odd = clashing.withColumn("__line_dedup", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("text.x", F.lit("clash"))
    again = lines.dedup_lines(odd)
    assert again.columns == odd.columns and again.filter("`text.x` = 'clash'").count() == odd.count()


def plain_contained(docs, items):
    def runs(t):
        w = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = {}
    for d, t in docs:
        own = runs(t)
        for k, x in items:
            s = runs(x)
            if s and len(s & own) >= np.ceil(0.8 * len(s) - 1e-9):
                out[d, k] = (len(s & own), len(s))
    return out


def test_decontamination(spark, corpus, docs):
    rng = random.Random(8)
    items = [(k, " ".join(t.split()[a : a + rng.randint(1, 30)])) for k, (_, t) in enumerate(rng.sample([c for c in corpus if c[1]], 25)) for a in [rng.randint(0, 3)]]
    items += [(100, None), (101, ""), (102, "... !"), (103, "a b c d"), (104, corpus[4][1].upper().replace(" ", ", "))]
    some = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontamination.contaminated(docs, some).collect()}
    want = plain_contained(corpus, items)
    assert got == want and (4, 104) in got and (corpus[-1][0], 103) in got
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, some).collect()}
    assert kept == {i for i, _ in corpus} - {d for d, _ in want}


def test_candidates_come_from_signatures(spark):
    """A text of a few shingles of an item is verified only where one of them is in the signature."""
    rng = random.Random(12)
    item = [f"w{rng.randrange(10**6)}" for _ in range(104)]
    rows = [(a, " ".join(item[a : a + 5])) for a in range(100)] + [(500, " ".join(item)), (501, " ".join(item[:90])), (502, " ".join(item[:60]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = decontamination.item_shingles(spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    signature = {r.shingle for r in known.filter("in_signature").collect()}
    assert len(signature) == 21
    texts = docs.select("doc_id", decontamination.words("text").alias("w"))
    got = {r.doc_id for r in decontamination.candidates(texts, known).collect()}
    # short texts have too few words for the item's partition by size; of long ones those with a signature shingle
    assert {500, 501} <= got and not got & set(range(100))
    filler = " ".join(f"x{k}" for k in range(200))
    longer = spark.createDataFrame([(i, f"{t} {filler}") for i, t in rows[:100]], "doc_id long, text string")
    got = {r.doc_id for r in decontamination.candidates(longer.select("doc_id", decontamination.words("text").alias("w")), known).collect()}
    assert got == {i for i, t in rows[:100] if t in signature}


def test_decontamination_edges(spark, nothing, clashing, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert decontamination.contaminated(nothing, items).count() == 0
    assert decontamination.contaminated(clashing, items.limit(0)).count() == 0
    out = decontamination.drop_contaminated(clashing, items)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    a = decontamination.contaminated(clashing, clashing.select(F.col("doc_id").alias("item_id"), "text"))
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    b = decontamination.contaminated(clashing, clashing.select(F.col("doc_id").alias("item_id"), "text"))
    assert sorted(a.collect()) == sorted(b.collect())
