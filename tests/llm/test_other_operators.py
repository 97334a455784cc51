"""Quality rules, packing, archives, token counts, language model, licences and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import licenses, lm, packing, quality, token_counts, warc


def test_rule_statistics():
    s = quality.rule_statistics
    assert s("") == s(" \n\t") == (0, 0, 0, 0, 0, 0)
    assert s("a b\na b\n\nc#") == (5, 6, 1, 3, 1, 0)
    assert s("x y z x y z") == (6, 6, 0, 1, 0, 6)
    assert s("x y z q x y z") == (7, 7, 0, 1, 0, 6)
    assert s("é é a")[:2] == (2, 4)


def test_path_lengths():
    assert quality.average_path(np.array([1, 2])).tolist() == [0.0, 1.0]
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.01, (400, 3)), rng.normal(3, 1, (8, 3))]
    f = quality.Forest.fit(x)
    s = f.score(x)
    assert s[400:].min() > np.quantile(s[:400], 0.95)
    f.calibrate(x, np.arange(408) < 400)
    odd = f.odd(x)[1]
    assert odd[400:].mean() > 0.7 and odd[:400].mean() < 0.03


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    rows = []
    for i in range(300):
        w = [rng.choice(words) + rng.choice(words) + rng.choice(words) for _ in range(rng.randint(60, 200))]
        bad = i % 5 == 0
        rows.append((i, " ".join(x + rng.choice("#*$%") * 3 if bad and rng.random() < 0.6 else x for x in w), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_verdicts(judged):
    got = quality.quality_verdicts(judged, judged.filter("doc_id % 3 = 0").select("doc_id", "quality"))
    held = got.join(judged.select("doc_id", "quality"), "doc_id").filter("doc_id % 3 <> 0").collect()
    assert np.mean([r.kept == bool(r.quality) for r in held]) > 0.96
    assert quality.keep_quality(judged, judged).columns == judged.columns


def test_quality_thresholds_of_all_labels(spark, judged):
    """The thresholds of all labelled rows, of which the first 20,000 in hash order would not do."""
    rng = np.random.default_rng(5)
    n = 24_000
    rows = [(i, 200, 900, int(a), 20, int(b), int(c)) for i, a, b, c in zip(range(n), rng.integers(0, 60, n), rng.integers(0, 6, n), rng.integers(0, 40, n))]
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    good = {r[0]: bool(rng.random() < 1.1 - (r[3] / 45 + r[5] / 8 + r[6] / 45) / 1.5) for r in rows}
    labels = spark.createDataFrame([(i, int(g)) for i, g in good.items()], "doc_id long, quality int")
    forest = quality.fit_forest(stats, labels)
    x = np.array([r[1:] for r in rows], float)
    same = quality.Forest(forest.trees, forest.sample)
    same.calibrate(quality.features(*x.T), np.array([good[r[0]] for r in rows]))
    assert forest.thresholds.tolist() == same.thresholds.tolist() and np.isfinite(same.thresholds).any()


def test_quality_edges(nothing, clashing, judged):
    assert quality.quality_verdicts(nothing, judged).count() == 0
    rows = quality.quality_verdicts(clashing, judged.limit(0)).collect()
    assert len(rows) == clashing.count() and not any(r.kept for r in rows if r.n_words < 50)


def test_packing():
    rng = np.random.default_rng(2)
    n = np.minimum(rng.geometric(0.003, 3000), 8192)
    bins, offsets, sizes = packing.pack_lengths(n)
    used = Counter()
    for b, k in zip(bins.tolist(), n.tolist()):
        used[b] += k
    cap = dict(zip(bins.tolist(), sizes.tolist()))
    assert set(cap.values()) <= set(packing.CAPACITIES)
    for b, u in used.items():
        assert u <= cap[b] and all(c < u for c in packing.CAPACITIES if c < cap[b])
    order = np.lexsort((offsets, bins))
    for i, j in zip(order, order[1:]):
        if bins[i] == bins[j]:
            assert offsets[i] + n[i] <= offsets[j]
    assert n.sum() / sum(cap.values()) > 0.97
    a, b, c = packing.pack_lengths(np.array([8192, 1, 1]))
    assert sorted(c.tolist()) == [512, 512, 8192]


def plain_best_fit(lengths, capacities, overhead):
    """The rule of pack_lengths step by step, with all open bins looked at for each piece."""
    todo = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins, out = [], {}
    for k, i in enumerate(todo):
        x, later = lengths[i], [lengths[j] for j in todo[k + 1 :]]
        fits = [(cap - used, b) for b, (cap, used) in enumerate(bins) if cap - used >= x]
        if fits:
            b = min(fits)[1]
        else:
            room = sum(cap - used for cap, used in bins)
            costs = []
            for c in sorted(c for c in capacities if c >= x):
                more = max(0, sum(y for y in later if y <= c - x) - room)
                costs.append(((c + overhead) / (x + min(c - x, more)), c))
            b = len(bins)
            bins.append((min(costs)[1], 0))
        out[i] = b, bins[b][1]
        bins[b] = bins[b][0], bins[b][1] + x
    return out, [min(c for c in capacities if c >= used) for _, used in bins]


def test_packing_is_best_fit():
    rng = np.random.default_rng(3)
    other = 0
    for k in range(120):
        caps = [(40,), (16, 40), (8, 16, 32, 64)][k % 3]
        n = rng.integers(1, max(caps) + 1, rng.integers(0, 60))
        want, final = plain_best_fit(n.tolist(), caps, 3)
        bins, offsets, sizes = packing.pack_lengths(n, caps, 3)
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(n))]
        assert sizes.tolist() == [final[want[i][0]] for i in range(len(n))]
        if len(caps) == 1:
            # the first open bin that holds a piece, in place of the fullest, gives other bins
            first, rooms = [], []
            for i in sorted(range(len(n)), key=lambda i: (-n[i], i)):
                at = next((b for b, r in enumerate(rooms) if r >= n[i]), len(rooms))
                rooms += [caps[0]] * (at == len(rooms))
                rooms[at] -= n[i]
                first.append((i, at))
            other += dict(first) != {i: b for i, (b, _) in want.items()}
    assert other > 10


def test_packing_table(spark, nothing, clashing):
    rows = packing.best_fit_packing(packing.word_counts(clashing)).collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in clashing.collect()}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0)
    assert got[5] == 2 * words[5] and all(got[d] == n for d, n in words.items() if d != 5)
    assert sum(r.doc_id == 82 for r in rows) == 2 and {r.start for r in rows if r.doc_id == 82} == {0, 8192}
    assert packing.best_fit_packing(packing.word_counts(nothing)).count() == 0
    small = packing.best_fit_packing(packing.word_counts(clashing), shard=10)
    assert small.agg(F.sum("n_tokens")).first()[0] == sum(got.values()) and small.select("bin_id").distinct().count() > 5


@pytest.fixture(scope="module")
def pages(spark):
    same = "<html>" + "same é " * 40 + "</html>"
    rows = [(k, f"http://h{k % 3}.example.com/p/{k}?q=1", same if k % 4 == 0 else f"<p>{k}</p>" * k) for k in range(40)]
    rows += [(100, None, None), (101, "no url\r\nX: y", "tiny"), (102, "http://[bad", "tiny"), (103, "http://h.example", same)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(pages, tmp_path):
    index = warc.archive_pages(pages, str(tmp_path / "archive"))
    got = {r.page_id: r for r in index.read(pages).collect()}
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        source = r.refers_to if r.record_type == "revisit" else k
        assert bytes(got[source].payload) == want[k] and r.payload_bytes == len(want[k])
        first = min(i for i, h in want.items() if h == want[k])
        assert r.refers_to == (first if len(want[k]) >= 100 and first != k else None)
    (headers, payload), = index.lookup("http://h1.example.com/p/7?q=1", 7)
    assert payload == want[7] and headers["WARC-Target-URI"].endswith("/p/7?q=1")
    assert index.lookup("http://absent.example/", 7) == []


def test_index_blocks(pages, tmp_path):
    folder = str(tmp_path / "archive")
    captures = warc.write_archives(warc.plan_records(pages), folder, most=2000)
    index = warc.CaptureIndex.build(captures, folder, block=5)
    assert len(index.directory) > 5 and captures.select("file").distinct().count() > 3
    keys = [warc.capture_key(r.url, r.page_id) for r in pages.collect()]
    assert all(any(e[0] == k for n in index.blocks_of(k) for e in index.read_block(n)) for k in keys)
    assert warc.reversed_host("http://www.Example.com:81/a?b") == "com,example,www:81)/a?b"


def test_archive_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none).read(none).count() == 0
    odd = spark.createDataFrame([(None, "http://a.example/", "x" * 200, 1), (3, "http://a.example/", "x" * 200, 2), (3, "http://a.example/", "x" * 200, 2)], "page_id long, url string, html string, key long")
    rows = warc.archive_pages(odd).read(odd).collect()
    assert {(r.page_id, r.record_type) for r in rows} == {(None, "response"), (3, "response")}


def test_token_counts_equal_the_library(corpus, docs, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.load_vocabulary()
    own = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = [t or "" for _, t in corpus] + [" ", "  a", "a  b \n", "▁x ▁", "テ\U0001f600\U0001f600", "<s> <0x0A>", "\n\n x", "ŧħe ŋew"]
    counter = token_counts.Counter(pieces, most=50)
    assert [counter.tokens(t) for t in texts] == [len(e.ids) for e in own.encode_batch(texts)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, pieces).collect()}
    assert got == {i: counter.tokens(t or "") for i, t in corpus}
    assert token_counts.token_counts(nothing, pieces).count() == 0


def test_viterbi_ties():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), ("c", -9.0)]
    c = token_counts.Counter(pieces)
    assert c.tokens("ab") == 1 and c.tokens("abab") == 2 and c.tokens("ac") == 2 and c.tokens("é") == 3


def test_language_model(corpus, docs):
    rows = {r.doc_id: r for r in lm.score_documents(docs, chunk=4000).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in corpus}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}
    c = Counter(w for i, t in tokens.items() if fold[i] != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i] == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    one = {r.doc_id: r.score for r in lm.score_documents(docs, chunk=1 << 21).collect()}
    assert all(math.isclose(one[i], rows[i].score, rel_tol=1e-9) for i in tokens)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution():
    """The mixture over all words and one unknown sums to 1 in a context, whatever the weights."""
    w, hw = np.array([5, 3, 2]), np.array([2, 0, 1])
    mixed = np.array([0.5, 0.4, 0.1])
    p = mixed[0] * hw / hw.sum() + mixed[1] * w / w.sum() + mixed[2] / 4
    assert math.isclose(p.sum() + mixed[2] / 4, 1.0)


def test_weights_follow_held_out_counts(spark):
    sure = spark.createDataFrame([(9, 10, 50, 900), (1, 10, 50, 30)], "hw long, h long, w long, n long")
    weights = lm.learn_weights(sure, 1000, 1e-4)
    b = int(lm.context_bucket(np.array([10]))[0])
    assert weights[b][0] > 0.9 and np.allclose(weights.sum(axis=1), 1)


def test_language_model_edges(nothing, clashing):
    assert lm.score_documents(nothing).count() == 0
    rows = lm.score_documents(clashing).collect()
    assert len(rows) == clashing.count() and sum(r.doc_id is None for r in rows) == 1


@pytest.fixture(scope="module")
def notices(spark):
    rng = random.Random(12)
    words = ["lorem", "ipsum", "dolor", "the", "of", "software", "and", "free", "version", "work", "is", "under", "public"] + [f"w{k}" for k in range(300)]
    rows, want = [], {}
    for d in range(150):
        own = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 40))) for _ in range(4)]
        if d % 3 == 0:
            family, text = licenses.TEMPLATES[(d // 3) % len(licenses.TEMPLATES)]
            at = rng.randint(0, 4)
            own.insert(at, text if d % 2 else text + " " + " ".join(rng.choice(words) for _ in range(4)))
            want[d, at] = family
        rows.append((d, "\n".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_license_families(notices):
    docs, want = notices
    got = {(r.doc_id, r.line_no): r.family for r in licenses.license_scan(docs, sample=300).collect()}
    right = sum(got.get(k) == f for k, f in want.items())
    assert right / len(want) > 0.9 and len(set(got) - set(want)) <= 2


def test_license_wrapped(spark):
    """Hard-wrapped notices, alone between blank lines or straight among other lines, with their line spans."""
    import textwrap

    rng = random.Random(5)
    prose = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(12))
    long = [x for x in licenses.TEMPLATES if len(x[1].split()) > 18]
    rows, want = [], {}
    for d in range(4 * len(long)):
        family, text = long[d % len(long)]
        own = [f" * {x}" for x in textwrap.wrap(text, (64, 34)[d % 2])]
        gap = ["", " *"][d % 2 : d % 2 + 1] if d % 3 else []
        rows.append((d, "\n".join([prose(), prose(), *gap, *own, *gap, prose()])))
        want[d, 2 + len(gap)] = (family, 1 + len(gap) + len(own))
    rows += [(1000 + d, "\n".join(prose() for _ in range(4))) for d in range(100)]
    got = {(r.doc_id, r.line_no): (r.family, r.last_line) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), sample=300).collect()}
    assert sum(got.get(k) == v for k, v in want.items()) / len(want) > 0.9 and len(set(got) - set(want)) <= 2


@pytest.mark.parametrize("family", ["mit", "bsd"])
def test_license_of_a_third_of_all_rows(spark, family):
    """A notice without the words licence and copyright, in a third of the rows, is not learned as unknown."""
    rng = random.Random(8)
    text = next(x for f, x in licenses.TEMPLATES if f == family and len(x.split()) > 18)
    prose = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(20))
    rows = [(d, text if d % 3 == 0 else prose()) for d in range(600)]
    got = {r.doc_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), sample=600).collect() if r.family == family}
    assert got == set(range(0, 600, 3))


def test_license_edges(nothing, clashing):
    assert licenses.license_scan(nothing).count() == 0
    assert licenses.license_scan(clashing).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline as cp

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfghklmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    body = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    clean = [body(12) for _ in range(20)]
    item = " ".join(word() for _ in range(25))
    copies = [clean[0], clean[1][:-3] + "xyz"]
    dirty = ["### $$$ " * 100, " ".join(["spam ham egg"] * 60), "too short"]
    leak = [clean[2].replace("\n", " ") + " " + item + " " + body(3).replace("\n", " ")]
    texts = clean + copies + dirty + leak
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 20), 0) for i in list(range(18)) + [22, 23]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = cp.run(spark, sf).collect()
    packed = {r.doc_id for r in out if r.n_tokens}
    # of the near copy only its one changed line is new
    assert packed - {21} == set(range(20))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def stored(spark, path, documents, labels=(), items=()):
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_of_empty_tables(spark, tmp_path, nothing):
    import corpus_pipeline as cp

    assert cp.run(spark, stored(spark, tmp_path, nothing)).collect() == []


def test_pipeline_edges(spark, tmp_path, clashing):
    """Null ids, texts and items, repeated rows and clashing columns go through; what is packed was kept before."""
    import corpus_pipeline as cp

    sf = stored(spark, tmp_path, clashing, [(i, i % 2, None) for i in range(20)] + [(None, 1, 0)], [(0, None), (1, ""), (None, "a b c d")])
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == clashing.columns
    ids = {r.doc_id for r in kept.collect()}
    packed = {r.doc_id for r in cp.run(spark, sf).collect()}
    assert packed <= ids and 0 < len(ids) < clashing.count()
