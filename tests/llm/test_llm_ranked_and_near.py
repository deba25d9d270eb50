"""Max-sketch search, b-bit MinHash and fill-in-middle against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ragmill.llm")

from ragmill.llm import _kernels as kernels  # noqa: E402
from ragmill.llm import _tiles, fill_middle, licenses, max_sketch, minhash, warc  # noqa: E402

DOCS = "doc_id long, text string, source string, n long, form string, score long, rank int, bucket long, output string, _text string"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "s", 1, "f", 2, 3, 4, "o", "x") for i, t in pairs], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- fill-in-middle


def brute_cut(doc_id, text):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_middle(spark):
    texts = [None, "", "a", "<P>", "x<M>y", "< P >", "\n\r\n", "é😀́e", "日本語テキスト" * 50, "a<S", "M>P>" * 40, "line one\nline two " * 40000]
    pairs = [(i * 7 + k, t) for k in range(6) for i, t in enumerate(texts)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = docs_of(spark, pairs).repartition(3)
    got = fill_middle.transformed(docs)
    assert set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    rows = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((repr((i, *brute_cut(i, t))) for i, t in pairs))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in rows) == want
    assert all(r.back == (r.text or "") and r._text == "x" for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(docs_of(spark, [])).count() == 0


def test_fill_middle_by_words(spark):
    """Other units: cuts fall between them, and a text that isn't made of them stays plain."""
    got = fill_middle.transformed(docs_of(spark, [(i, "one two  three four") for i in range(40)] + [(99, " leading")]), unit=r"\S+\s*", plain_from=100)
    for r in got.collect():
        if r.doc_id == 99:
            assert (r.n, r.form, r.output) == (None, "plain", " leading")
        else:
            assert r.n == 4 and r.prefix_chars in (0, 4, 9, 15, 19) and r.prefix_chars + r.middle_chars in (0, 4, 9, 15, 19)
    for wrong in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "x")):
        with pytest.raises(ValueError):
            fill_middle.transformed(docs_of(spark, []), sentinels=wrong)


# ---- near copies


def near_texts(seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        if out and r.random() < 0.6:
            base = list(r.choice(out))
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                base[r.randrange(len(base))] = f"x{r.randint(0, 9)}"
        else:
            base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 2, 3, 4, 8, 30, 120, 300]))]
        out.append(base)
    return [" ".join(x) for x in out]


def brute_components(pairs, n, num, den):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            k = len(sets[i] & sets[j])
            if k and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_near_copies(spark, seed, n, num):
    pairs = [*enumerate(near_texts(seed, 70)), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b"), (1004, "a B"), (1005, "a" * 30000 + " long " * 5000), (1006, "one two three " * 9000)]
    docs = docs_of(spark, [*pairs, (1003, "A b"), (None, "A b")]).repartition(5)
    assert sorted(tuple(r) for r in minhash.near_copies(docs, n, num, 100).collect()) == brute_components(pairs, n, num, 100)


def test_near_copies_in_blocks(spark, monkeypatch):
    """A chain whose far ends aren't linked, in buckets and groups that are cut."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    r = random.Random(9)
    base, pairs = [f"w{r.randint(0, 400)}" for _ in range(200)], []
    for i in range(60):
        t = list(base)
        for k in range(i // 2):
            t[k * 3 % 200] = f"y{k}"
        pairs.append((i, " ".join(t)))
    got = minhash.near_copies(docs_of(spark, pairs), 3, 85, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(pairs, 3, 85, 100)
    assert minhash.near_copies(docs_of(spark, [])).count() == 0


def test_estimates_are_corrected_for_chance():
    """The mean estimate follows the similarity, also for unlike sets, and pairs at the threshold pass."""
    family, r = minhash.Family(), np.random.default_rng(5)
    enough = family.enough(0.85)
    for similarity in (0.0, 0.3, 0.6, 0.85, 0.95):
        got = []
        for _ in range(60):
            both = round(400 * similarity)
            x = r.integers(0, 2**64, 800 - both, dtype=np.uint64)
            a, b = np.unique(x[:400]), np.unique(np.concatenate([x[:both], x[400:]]))
            minima = family.least(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            signature = family.packed(minima)
            agreeing = family.agreeing(signature[0], signature[1:])
            assert agreeing[0] == ((minima[0] ^ minima[1]) & 3 == 0).sum()
            got.append((family.estimate(agreeing)[0], agreeing[0] >= enough, len(set(family.buckets(minima)[0].tolist()) & set(family.buckets(minima)[1].tolist()))))
        true = both / (800 - both)
        assert abs(np.mean([x[0] for x in got]) - true) < 0.02
        if true >= 0.85:
            assert all(x[1] and x[2] for x in got)
        if true < 0.2:
            assert not any(x[1] for x in got)
    with pytest.raises(ValueError):
        minhash.Family(minima=100, rows=3)


def test_tiles_meet_every_block(spark):
    """Links are found whichever blocks their ends are in."""
    rows = spark.createDataFrame([(t, i, 1, i % 10) for t in range(2) for i in range(t, 200, 2)], "tile long, doc_id long, weight int, kind int")

    def link(t, guests):
        kind, m = t.column("kind").to_numpy(), t.num_rows
        label = np.arange(m)
        for i in range(m - guests, m) if guests else range(m):
            for j in range(m - guests if guests else i):
                if kind[i] == kind[j]:
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
        return label

    edges = {tuple(r) for r in _tiles.tile_edges(rows.drop("kind"), ["tile"], lambda m: m.join(rows.select("doc_id", "kind"), "doc_id"), link, 16, 1000).collect()}
    top = list(range(200))
    for _ in range(8):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    assert all(top[i] == i % 10 for i in range(200)) and len(edges) < 2000


# ---- ranked search


def brute_ranking(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    tf = {i: Counter(words(t)) for i, t in docs}
    tf = {i: c for i, c in tf.items() if c}
    n_docs, n_terms = len(tf), sum(sum(c.values()) for c in tf.values())
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tf.items():
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in words(text) if w in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_search(spark, monkeypatch, seed):
    monkeypatch.setattr(max_sketch, "BLOCK_ITEMS", 4)  # several blocks of items
    monkeypatch.setattr(max_sketch, "NARROWEST", 2)  # and coordinates that many terms share
    monkeypatch.setattr(max_sketch, "WIDEST", 32)
    r = random.Random(seed)
    words = lambda n: " ".join(f"W{int(r.paretovariate(0.7)) % 300}é" for _ in range(n))
    docs = [(i, words(r.choice([1, 3, 20, 80, 400]))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, None), (301, ""), (302, " .,;"), (303, "w1é " * 400 + "tail"), (304, docs[4][1].upper())]
    items = [(i, words(r.choice([1, 4, 30]))) for i in range(12)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "w1é W1É w2é"), (54, docs[3][1])]
    frame = docs_of(spark, [*docs, (300, None), (5, docs[5][1]), (None, "w1é")]).repartition(4)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in [*items, (53, "w1é W1É w2é"), (None, "w1é")]], "item_id long, text string, doc_id long, score long")
    got = max_sketch.search(max_sketch.build(frame), frame, asked, k=7, depth=8)
    assert sorted(tuple(x) for x in got.collect()) == brute_ranking(docs, items, 7)


def test_search_of_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, [(1, "a b"), (2, "...")])
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert max_sketch.search(max_sketch.build(none), none, items).count() == 0
    assert max_sketch.search(max_sketch.build(some), some, items.limit(0)).count() == 0
    assert [tuple(x)[:3] for x in max_sketch.search(max_sketch.build(some), some, items).collect()] == [(1, 1, 1)]


def test_bounds_never_fall_below_scores():
    """For whatever sketches: the bound of a document and an item is at least its score."""
    r = np.random.default_rng(3)
    vocabulary = kernels.mix(np.arange(1, 400).astype(kernels.U))

    class Row:
        def __init__(self, item_id, term, df, times):
            self.item_id, self.term, self.df, self.times = item_id, int(np.uint64(term).view(np.int64)), df, times

    block = max_sketch.Block([Row(i, t, int(r.integers(1, 50)), int(r.integers(1, 3))) for i in range(20) for t in r.choice(vocabulary, 10, replace=False)], 50, 40000)
    row = np.sort(r.integers(0, 50, 40000))
    h = vocabulary[np.minimum(r.pareto(0.6, 40000).astype(int), 398)]
    terms, tf, at = max_sketch.term_counts(h, row, 50)
    width, flat = max_sketch.sketched(terms, tf, at)
    ends = np.concatenate([[0], np.cumsum(2 * width)])
    bounds = block.bounds(np.bincount(row, minlength=50), width, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    scores = block.scores(h, row, 50)
    assert (bounds >= scores).all() and (scores > 0).any() and tf.max() > 255
    assert (bounds > 1.02 * scores).mean() < 0.7  # and they aren't far above


# ---- whole licences


def test_whole_licences_are_found_where_a_fifth_is_changed(spark):
    """The default licences, whole in a long text, with words changed, in halves, and one line of one only."""
    r = random.Random(4)
    noise = lambda n: " ".join(f"n{r.randint(0, 9999)}" for _ in range(n))
    texts, want = [], set()
    for k, (name, text) in enumerate(licenses.LICENSES):
        w = text.split()
        edited = " ".join(f"other{i}" if i % 60 == 30 else x for i, x in enumerate(w))
        texts += [(10 * k, f"{noise(700)} {text} {noise(40)}"), (10 * k + 1, f"{noise(90)} {edited.upper()}"), (10 * k + 2, " ".join(w[: len(w) // 2])), (10 * k + 3, noise(400))]
        want |= {(10 * k, name), (10 * k + 1, name)}
    got = {(x.doc_id, x.license_id) for x in licenses.scan(docs_of(spark, texts), licenses.notices(spark)).collect()}
    assert got == want


# ---- archives


def test_segments_that_repeat_or_share_an_origin(spark, tmp_path):
    """A segment that comes twice, and two records of one id, are no whole record: nothing of them is taken for one."""
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\nhello world"
    half = len(body) // 2

    def record(kind, name, block, *more):
        own = b"WARC-Record-ID: <%s>" % name if kind == b"response" else b"WARC-Record-ID: <%s:x>\r\nWARC-Segment-Origin-ID: <%s>" % (name, name)
        return b"\r\n".join([b"WARC/1.1", b"WARC-Type: " + kind, own, *more, b"Content-Length: %d" % len(block), b"", block, b"", b""])

    last = b"WARC-Segment-Total-Length: %d" % len(body)
    n = lambda k: b"WARC-Segment-Number: %d" % k
    good = record(b"continuation", b"a", body[half:], n(2), last) + record(b"response", b"a", body[:half], n(1))
    twice = record(b"response", b"b", body[:half], n(1)) + record(b"response", b"b", body[:half], n(1)) + record(b"continuation", b"b", body[half:], n(2), last)
    shared = record(b"response", b"c", body[:half], n(1)) + record(b"continuation", b"c", body[half:], n(2), last) + record(b"response", b"c", body[:half], n(1)) + record(b"continuation", b"c", body[half:], n(2), last)
    lost = record(b"response", b"d", body[:half], n(1))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(good + lost) + gzip.compress(twice + shared))
    got = {x.origin: (x.complete, x.payload) for x in warc.read(spark, str(tmp_path)).collect()}
    assert got.pop("<a>") == (True, b"hello world") and set(got) == {"<b>", "<c>", "<d>"} and all(x == (False, None) for x in got.values())
