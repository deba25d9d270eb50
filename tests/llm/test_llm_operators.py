"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ragmill.llm")

from ragmill.llm import ball_tree, bpe, decontaminate, jaccard_join, licenses, preferences, resampling, sharding, suffix_dedup, warc  # noqa: E402
from ragmill.llm import _kernels as kernels  # noqa: E402
from ragmill.llm._graph import components, contracted  # noqa: E402

DOCS = "doc_id long, text string, source string, word string, h1 long, score long, rank int, slot int"


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "s", "w", 1, 2, 3, 4) for i, t in pairs], DOCS)


def words(r, n, pool=400):
    return [f"w{r.randint(0, pool)}" for _ in range(n)]


def near_texts(seed, n=60):
    """Texts with exact and near copies of some."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            base = list(r.choice(out))
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                base[r.randrange(len(base))] = "x%d" % r.randint(0, 9) if base else ""
            out.append(base)
        else:
            out.append(words(r, r.choice([1, 2, 3, 4, 5, 8, 30, 120, 300])))
    return [" ".join(x) for x in out]


def brute_components(pairs, n, num, den):
    sets = {}
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
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
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80), (3, 2, 50)])
def test_jaccard_components(spark, seed, n, num):
    pairs = [*enumerate(near_texts(seed)), (1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b"), (1004, "a B"), (1005, "a" * 30000 + " long " * 5000)]
    got = jaccard_join.jaccard_components(docs_of(spark, [*pairs, (1003, "A b"), (None, "A b")]).repartition(5), n, num, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(pairs, n, num, 100)


def test_jaccard_large_tiles_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    r = random.Random(9)
    base = words(r, 200)
    pairs = []
    for i in range(60):
        t = list(base)
        for k in range(i // 2):  # a chain: far ends aren't linked directly
            t[k * 3 % 200] = f"y{k}"
        pairs.append((i, " ".join(t)))
    got = jaccard_join.jaccard_components(docs_of(spark, pairs), 4, 85, 100)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(pairs, 4, 85, 100)


def test_jaccard_keeps_one_of_each_group(spark):
    pairs = list(enumerate(near_texts(4)))
    kept = jaccard_join.keep_one_per_group(docs_of(spark, pairs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in brute_components(pairs, 5, 80, 100)})
    assert kept.columns == docs_of(spark, []).columns
    assert jaccard_join.jaccard_components(docs_of(spark, [])).count() == 0


def test_parts_never_miss_a_linked_pair():
    bands, r = jaccard_join.Bands(80, 100), np.random.default_rng(3)
    for n in (1, 2, 5, 9, 10, 11, 40, 41, 200, 1000):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, n).astype(kernels.U))
            drop = r.integers(0, max(1, int(0.1 * n)) + 1)
            b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, r.integers(0, max(1, n // 10) + 1)).astype(kernels.U)]))
            same = len(np.intersect1d(a, b))
            if not len(b) or 100 * same < 80 * (len(a) + len(b) - same):
                continue
            at = np.array([0, len(a), len(a) + len(b)])
            s = np.concatenate([a, b])
            keys, owner = jaccard_join._keys(s, at, s % kernels.U(r.integers(1, 9)) > 0, bands)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_linked_rows_agree_in_as_many_parts_as_they_state():
    bands, r = jaccard_join.Bands(80, 100), np.random.default_rng(4)
    stated = 0
    for n in (3, 10, 40, 41, 200, 1000):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**64, n, kernels.U))
            b = np.unique(np.concatenate([a[int(0.1 * n) :], r.integers(0, 2**64, n // 10, kernels.U)]))
            same = len(np.intersect1d(a, b))
            if 100 * same < 80 * (len(a) + len(b) - same):
                continue
            s = np.concatenate([a, b])
            keys, owner, scheme, need = jaccard_join._sent(s, np.array([0, len(a), len(s)]), s % kernels.U(r.integers(1, 9)) > 0, bands)
            common = np.intersect1d(keys[owner == 0], keys[owner == 1])
            by = Counter(scheme[(owner == 0) & np.isin(keys, common)].tolist())
            assert any(by[k] >= need[scheme == k].max() for k in by)  # in one of the two bands they are compared
            stated = max(stated, need.max())
    assert stated > 20


def test_counts_of_shared_keys_over_batches():
    rows = [(1, 5), (1, 5), (1, 7), (2, 5), (2, 7), (2, 9), (3, 9), (3, 9), (4, 5), (4, 9)]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size])], ["key", "vertex"]) for i in range(0, len(rows), size)]
        got = [tuple(x.values()) for b in jaccard_join.shared_keys(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == [(5, 5, 3), (5, 7, 2), (5, 9, 2)]


def test_shared_passages_chain_no_candidates(spark, monkeypatch):
    r, seen = random.Random(6), []
    passages = [words(r, 60, 10**6) for _ in range(31)]
    texts = [[*passages[i], *words(r, 400, 10**6), *passages[i + 1]] for i in range(30)]
    texts.append([*texts[3][:-9], *words(r, 9, 10**6)])
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    real = jaccard_join.tile_edges
    monkeypatch.setattr(jaccard_join, "tile_edges", lambda members, *a: seen.extend(x.doc_id for x in members.collect()) or real(members, *a))
    got = jaccard_join.jaccard_components(docs_of(spark, pairs))
    assert sorted(tuple(x) for x in got.collect()) == brute_components(pairs, 5, 80, 100)
    assert set(seen) == {3, 30}  # each document shares a passage with the next, which makes no link


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_logarithmic_rounds(spark):
    chain = spark.range(1000).selectExpr("id as a", "id + 1 as b")
    assert len(contracted(chain)) <= 2 * np.log2(1000)
    assert components(chain).agg(F.max("root"), F.count("*")).first() == (0, 1001)


def brute_removal(pairs, length):
    seen, out = set(), []
    for i, t in sorted(pairs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if (w := b[k : k + length]) in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup(spark, seed):
    r = random.Random(seed)
    passages = ["".join(r.choices("abcdé \n", k=r.choice([60, 99, 100, 101, 250]))) for _ in range(8)]
    pairs = [(i, "".join(r.choice([r.choice(passages), "".join(r.choices("xyzä ", k=r.randint(0, 80)))]) for _ in range(r.randint(0, 9)))) for i in range(80)]
    pairs += [(500, None), (501, ""), (502, "The " * 400), (503, "a" * 5000), (504, "ab" * 99), (505, passages[0] * 3), (506, "q" * 99), (507, "q" * 100)]
    got = suffix_dedup.without_repeats(docs_of(spark, [*pairs, (506, "q" * 99), (None, "z" * 500)]).repartition(4), 100).drop("kept")
    assert sorted(tuple(r) for r in got.collect()) == brute_removal(pairs, 100)


def test_suffix_dedup_parts_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SCAN", 64)
    r = random.Random(8)
    text = "".join(r.choices("abcdefgh", k=3000))
    pairs = [(1, text), (2, text[500:1700] + "zz" + text[2000:]), (3, text)]
    raw, offs = "".join(t for _, t in pairs).encode(), np.cumsum([0, *(len(t) for _, t in pairs)])
    found = []
    for lo, _, bounds in suffix_dedup._pieces(offs, 100):
        doc, a, b, *_ = suffix_dedup.runs(np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0], 100)
        found += [(lo, x) for d, i, j in zip(doc, a, b, strict=True) for x in range(i + bounds[0] - offs[lo], j + 1 + bounds[0] - offs[lo])]
    assert sorted(found) == [(k, x) for k, (_, t) in enumerate(pairs) for x in range(len(t) - 99)]


def test_suffix_dedup_drops_text_and_follows_n_chars(spark):
    p = "".join(random.Random(5).choices("éàüöäß", k=80))
    d = spark.createDataFrame([(1, p + "a", "x", 81), (2, "b" + p + "c", "x", 82), (2, "a", "other row", 1), (None, p, "no id", 80)], "doc_id long, text string, kept string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.drop_repeats(d).collect()}
    assert got[None].text == p and suffix_dedup.drop_repeats(d.limit(0)).count() == 0 and suffix_dedup.without_repeats(d.limit(0)).count() == 0
    assert got[1].text == p + "a" and got[2].text == "bc" and got[2].n_chars == 2 and got[2].kept == "x"


def test_suffix_arrays_merge_levels_and_find_all():
    r, family, seen = np.random.default_rng(2), suffix_dedup.SuffixArrays(5), set()
    for _ in range(40):
        b = r.integers(0, 3, 60).astype(np.uint8)  # zero bytes too
        start = np.sort(r.choice(56, 30, replace=False))
        want = []
        for i in start:
            want.append(bytes(b[i : i + 5]) in seen)
            seen.add(bytes(b[i : i + 5]))
        assert family.add(b, start).tolist() == want
    assert len(family.levels) <= 8 and all((x[1:] > x[:-1]).all() for x in family.levels)


def test_family_merges_levels_and_finds_all():
    r, family, seen = np.random.default_rng(1), suffix_dedup.Family(), set()
    for _ in range(60):
        v = r.integers(0, 500, r.integers(1, 40)).astype(kernels.U)
        want = []
        for x in v.tolist():
            want.append(x in seen)
            seen.add(x)
        assert family.add(v * kernels.U(7), v).tolist() == want
    assert len(family.levels) <= 8


@pytest.mark.parametrize(("rows", "shard", "block"), [(300, 40, 3), (300, 10_000, 100), (5, 2, 1)])
def test_ball_tree_top_k(spark, rows, shard, block):
    r = np.random.default_rng(rows)
    x = r.normal(size=(rows, 8))
    x[: rows // 2] = x[0]  # ties
    v = [(i, [float(a) for a in row], 0, 1) for i, row in enumerate(x)]
    bad = [(9001, None, 0, 1), (9002, [1.0, None], 0, 1), (9003, [float("nan")] * 8, 0, 1), (9004, [float("inf")] * 8, 0, 1), (9005, [], 0, 1), (None, [1.0] * 8, 0, 1), (9006, [1.0], 0, 1), v[1]]
    got = ball_tree.top_k(spark.createDataFrame(v + bad, "vec_id long, embedding array<double>, label int, score int"), F.col("vec_id") % 10 == 0, 10, shard_rows=shard, block_queries=block)
    q = np.floor(1024 * x).astype(np.int64)
    want = []
    for i in range(0, rows, 10):
        s = q @ q[i]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(rows), -s)) if j != i][:10])]
    assert sorted(tuple(r) for r in got.collect()) == want
    if rows > 5:
        tree = ball_tree.BallTree(q, np.arange(rows), leaf=8)
        far = np.sort(q @ q[-1])[-10]
        tree.search(q[-1:], np.array([rows - 1]), np.array([far]), 10)
        assert 0 < tree.opened < 0.9 * len(tree.rows)
    huge = [(0, [1e300, 1.0]), (1, [1e300, 1.0]), (100, [-1e300, 1.0])]
    top = ball_tree.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 10).collect()
    assert [(x.vec_id, x.score) for x in top] == [(1, 2**63 - 1), (100, -(2**63))]
    assert ball_tree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_resampling_rejects_what_the_target_lacks(spark):
    r = random.Random(2)
    clean = [(i, " ".join(words(r, 60))) for i in range(600)]
    bad = [(1000 + i, " ".join([*words(r, 60), "awful"])) for i in range(100)]
    junk = [(2000 + i, "buy " * 50) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean[:400]] + [(i, 1, 1) for i, _ in bad[:50]] + [(i, 0, 0) for i, _ in junk] + [(5, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resampling.resample(docs_of(spark, [*clean, *bad, *junk, (3000, None), (3001, ""), (None, "w1")]), labels, bits=17).collect()}
    assert len(kept & {i for i, _ in clean}) >= 595 and len(kept & {i for i, _ in bad}) <= 3 and not kept & {i for i, _ in junk}  # weights of 0.002 each: no cutoff, so one may be drawn
    assert {3000, 3001, None} <= kept
    everything = resampling.resample(docs_of(spark, clean), labels.limit(0), bits=17)
    assert everything.count() == 600 and resampling.resample(docs_of(spark, []), labels, bits=17).count() == 0


def test_resampling_draws_in_proportion_to_weights(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("double").alias("log_weight"))
    drawn = []
    for seed in (1, 2):
        key, cut = resampling.draw(rows, 800, seed)
        drawn.append({r.doc_id for r in rows.where(key >= cut).collect()})
    for ids in drawn:  # odd ids weigh e times as much; a tenth is drawn
        assert len(ids) == 800 and abs(sum(i % 2 for i in ids) / 800 - np.e / (1 + np.e)) < 0.05
    assert len(drawn[0] & drawn[1]) < 200


def test_resampling_takes_k_and_odd_columns(spark):
    r = random.Random(3)
    d = [(2**60 + i, " ".join(words(r, 40)) + (" telling" if i < 100 else ""), 0.5, "x") for i in range(300)] + [(None, "w1 w2", 0.5, "x"), (7, None, None, None), (8, "long " * 60_000, 0.5, "x")]
    docs = spark.createDataFrame(d, "doc_id long, text string, log_weight double, sample_key string")
    labels = spark.createDataFrame([(2**60 + i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = resampling.resample(docs, labels, k=60, bits=17)
    assert got.columns == ["doc_id", "text", "log_weight", "sample_key"] and dict(got.dtypes)["sample_key"] == "double"
    rows = got.collect()
    assert len(rows) == 60 and sum("telling" in (x.text or "") for x in rows) >= 30  # a third of all rows, twice and more as likely
    assert {x.doc_id for x in rows} != {x.doc_id for x in resampling.resample(docs, labels, k=60, seed=8, bits=17).collect()}


def test_resampling_on_held_out_labels(spark, sf):
    """Fitted on the labels of four fifths, judged on the rest, which it has not seen."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    kept = resampling.resample(docs, labels.where(~fold)).select("doc_id").withColumn("kept", F.lit(1))
    rest = labels.where(fold).join(kept, "doc_id", "left").groupBy((F.expr("quality = 1 and toxic = 0")).alias("clean")).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share"))
    share = {x.clean: x.share for x in rest.collect()}
    assert share[True] >= 0.97 and share[False] <= 0.2  # few labels: a fifth of toxic words are in too few of them


def test_resampling_is_fit_weights_and_draw(spark):
    """Model, weights and drawn rows against plain code; the draw alone decides, with no cutoff."""
    r = random.Random(6)
    texts = {i: " ".join(words(r, r.choice([3, 30, 200]), 60) + (["good good"] if i % 3 == 0 else ["vile"] if i % 7 == 0 else [])) for i in range(400)}
    texts[401], texts[402] = None, ""
    labels = {i: (1, 0) if i % 3 == 0 else (0, i % 7 == 0) for i in range(0, 400, 2)}
    docs = docs_of(spark, texts.items())
    frame = spark.createDataFrame([(i, q, int(t)) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    held = {}
    for i, t in texts.items():
        w = (t or "").split()
        pairs = list(zip(w, w[1:]))
        again = sum(a == b for a, b in pairs)
        held[i] = set(w) | set(pairs) | ({again.bit_length()} if again else set())
    good = {i for i, (q, t) in labels.items() if q == 1 and not t}
    count = lambda ids: Counter(x for i in ids for x in held[i])
    raw, target, share = count(held), count(good), len(good) / len(held)
    ratio = {}
    for x, n in raw.items():
        e, t = n * share, target[x]
        if abs(t - e) / math.sqrt(e * (1 - share) + 1) >= 3:
            z = math.log((t + 0.1) / (e + 0.1))
            ratio[x] = z / 2 if z > 0 else z
    assert 0 < len(ratio) < 200
    weight = {}
    for i, xs in held.items():
        told = [ratio[x] for x in xs if x in ratio]
        weight[i] = sum(told) / max(1, math.sqrt(len(told) / 16))
    scored = resampling.weighted(docs, resampling.fit(docs, frame, bits=20), bits=20)
    got = {x.doc_id: x.log_weight for x in scored.collect()}
    assert got.keys() == weight.keys() and all(abs(got[i] - weight[i]) < 1e-4 for i in weight)
    noise = {x.doc_id: x.g for x in scored.select("doc_id", resampling.gumbel(7, scored.columns).alias("g")).collect()}
    k = round(sum(min(1, math.exp(w)) for w in got.values()))
    assert {x.doc_id for x in resampling.resample(docs, frame, bits=20).collect()} == set(sorted(got, key=lambda i: -(got[i] + noise[i]))[:k])
    k = 150
    best = sorted(got, key=lambda i: -(got[i] + noise[i]))[:k]
    drawn = {x.doc_id for x in resampling.resample(docs, frame, k=k, bits=20).collect()}
    assert drawn == set(best) and min(got[i] for i in drawn) < max(got[i] for i in got.keys() - drawn)  # no threshold parts them


def test_resampling_rows_without_ids_are_drawn_one_by_one(spark):
    docs = docs_of(spark, [(None, f"text {i} " + ("x y " * (i % 5))) for i in range(200)])
    n = resampling.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), k=50, bits=17).count()
    assert n == 50


def test_kth_largest(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=500), np.full(100, 3.0), [-1e9, 1e9]])
    df = spark.createDataFrame([(float(v),) for v in x], "k double")
    for k in (1, 2, 50, 101, 102, 400, len(x)):
        cut = resampling.kth_largest(df, "k", k, bins=16)
        assert (x >= cut).sum() >= k and (x > cut).sum() < k


def test_decontamination_of_repetitive_texts(spark):
    """A document of one word over and over meets an item of the same: its lines carry an item's length each, not the text."""
    bench = spark.createDataFrame([(1, "ha " * 12), (2, "ha " * 60)], "item_id long, text string")
    d = [(1, "ha " * 40_000), (2, "ho " * 40_000), (3, "ha " * 11), (4, "x y z " + "ha " * 30)]
    got = {tuple(x) for x in decontaminate.overlaps(docs_of(spark, d), bench).collect()}
    assert got == {(1, 1, 12, 12), (1, 2, 20, 20), (3, 1, 11, 12), (3, 2, 11, 20)} - {(3, 2, 11, 20)} | {(4, 1, 12, 12), (4, 2, 20, 20)}


def test_ball_tree_bounds_of_huge_products():
    """Far centres: bounds are differences of terms much larger than they, and no best row is lost."""
    r = np.random.default_rng(11)
    x = (10**9 + r.integers(-3, 4, (400, 8))).astype(np.int64)
    q = np.where(r.random((30, 8)) < 0.5, -1, 1) * (10**8 + r.integers(0, 9, (30, 8)))
    q[:, 7] = -q[:, :7].sum(1)
    tree = ball_tree.BallTree(x, np.arange(400), leaf=4)
    found = tree.search(q.astype(np.int64), np.full(30, -1), np.full(30, -(2.0**63)), 3)
    for i, (ids, score) in enumerate(found):
        want = sorted(((-int(sum(int(a) * int(b) for a, b in zip(q[i], row, strict=True))), k) for k, row in enumerate(x)))[:3]
        assert [(-int(s), int(k)) for k, s in zip(ids, score, strict=True)] == want


@pytest.mark.parametrize("key", ["shard", "slot", "other key"])
def test_sharding_by_keys_of_any_name(spark, key):
    names = [f"s{i}" for i in range(5)]
    df = spark.createDataFrame([("a", 1, 2), ("b" * 100_000, 1, 2), (None, 1, 2)], f"`{key}` string, shard2 int, slot2 int")
    got = sharding.placed(df, key, names, 101).collect()
    assert len(got) == 3 and all(x.shard in names for x in got)
    assert sharding.placed(df.limit(0), key, names, 101).count() == 0


def test_decontamination(spark):
    r = random.Random(7)
    items = [(i, " ".join(words(r, n, 5000))) for i, n in enumerate((8, 15, 20, 40, 59))] + [(90, "Only five words, in all"), (91, None), (92, "")]
    edit = lambda t, k: " ".join(w if (j + 1) % k else "other" for j, w in enumerate(t.split()))
    noise = lambda: " ".join(words(r, 50, 5000))
    d = [(10 + i, f"{noise()} {t.upper()}, {noise()}") for i, t in items[:5]] + [(20 + i, f"{noise()} {edit(t, 6)} {noise()}") for i, t in items[1:5]] + [(30, edit(items[3][1], 2)), (31, None), (32, ""), (33, noise()), (34, items[0][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items] + [(None, "x " * 9, 1)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs_of(spark, d + d[:1]), bench).collect()}
    assert got == {(10 + i, i) for i in range(5)} | {(20 + i, i) for i in range(1, 5)} | {(34, 0)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, d), bench).collect()) == [30, 31, 32, 33]
    more = [(50, f"{noise()} only FIVE words in all {noise()}"), (51, f"{noise()} only five words of all {noise()}"), (None, d[0][1]), (None, noise()), (52, "the " * 40_000 + d[0][1])]
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs_of(spark, more), bench).collect()} == {(50, 90), (52, 0)}
    assert sorted(repr(x.doc_id) for x in decontaminate.drop_contaminated(docs_of(spark, more), bench).collect()) == ["51", "None"]
    assert decontaminate.overlaps(docs_of(spark, d), bench.limit(0)).count() == 0 and decontaminate.overlaps(docs_of(spark, []), bench).count() == 0


@pytest.mark.parametrize(("n", "least"), [(8, 1.0), (15, 0.99), (20, 0.99)])
def test_spaced_seeds_survive_substitutions(n, least):
    """Of all ways to substitute one word in eight, or a fifth of more, how many leave some mask whole."""
    import itertools

    hit = total = 0
    for gone in itertools.combinations(range(n), 1 if n == 8 else n // 5):
        total += 1
        hit += any(all(m[k] == "0" or p + k not in gone for k in range(8)) for m in decontaminate.MASKS for p in range(n - 7))
    assert hit >= least * total


def test_decontamination_equals_brute_force(spark):
    """Every pair of document and item, all alignments compared."""
    r = random.Random(11)
    items = {i: words(r, r.choice((9, 12, 20, 30)), 60) for i in range(12)}
    docs = {}
    for i in range(60):
        w = words(r, 30, 60)
        part = list(r.choice(list(items.values())))
        for k in r.sample(range(len(part)), r.choice((0, 1, len(part) // 5, len(part) // 3))):
            part[k] = "zz"
        docs[i] = w[:15] + part + w[15:]
    want = set()
    for d, t in docs.items():
        for i, w in items.items():
            size = min(20, len(w))
            for shift in range(-len(w), len(t)):
                same = [0 <= k + shift < len(t) and t[k + shift] == x for k, x in enumerate(w)]
                if any(100 * sum(same[j : j + size]) >= 80 * size for j in range(len(w) - size + 1)):
                    want.add((d, i))
    got = decontaminate.overlaps(docs_of(spark, [(i, " ".join(t)) for i, t in docs.items()]), spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string"))
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert found <= want and len(found) >= 0.9 * len(want) and len(want) > 30


def test_preferences(spark):
    c = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, None, None), (2, 5, "assistant", "a"), (3, 0, "user", "only chosen"), (4, 0, "user", "same"), (None, 0, "user", "x"), (1, None, "user", "x"), (1, 0, "user", "hi")]
    j = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", ""), (4, 0, "user", "same"), (5, 0, "user", "only rejected")]
    schema = "pair_id long, turn long, role string, text string"
    s = preferences.segments(spark.createDataFrame(c, schema), spark.createDataFrame(j, schema))
    got = sorted((r.pair_id, r.part, r.turn, r.train) for r in s.collect())
    assert got == [(1, "chosen", 1, True), (1, "chosen", 2, False), (1, "prompt", 0, False), (1, "rejected", 1, True), (2, "chosen", 5, True), (2, "prompt", 0, False), (4, "prompt", 0, False)]
    one = {r.pair_id: r for r in preferences.assembled(s).collect()}
    assert one[1].prompt == "<|user|>\nhi<|end|>\n" and one[4].chosen == one[4].rejected == ""
    a, b = one[1].chosen_train[0]
    assert one[1].chosen[a:b] == "<|assistant|>\nyes<|end|>\n" and len(one[1].chosen_train) == 1


def test_negatives_pair_every_conversation(spark):
    c = [(2 * i, t, "assistant" if t % 2 else "user", f"{i} says {t}") for i in range(7) for t in range(3 + i)] + [(50, 0, "user", "alone"), (60, 3, None, None), (None, 1, "user", "x"), (0, 0, "user", "zz again")]
    c += [(70, t, "assistant", "long " * 50) for t in range(2000)]
    conversations = spark.createDataFrame([(*x, "y") for x in c], "conv_id long, turn long, role string, text string, pair_id string")
    rows = {r.pair_id: r for r in preferences.assembled(preferences.segments(*preferences.negatives(conversations), key="conv_id")).collect()}
    assert set(rows) == {*range(0, 14, 2), 50, 60, 70}
    ends = set()
    for i in range(0, 14, 2):
        assert all(rows[i].chosen[x["from"] : x["to"]].startswith("<|assistant|>") for x in rows[i].chosen_train) and len(rows[i].rejected_train) == 1 and rows[i].chosen != rows[i].rejected
        ends.add(rows[i].prompt.count("<|end|>"))
    assert len(ends) > 1 and rows[0].prompt.startswith("<|user|>\nzz again")
    assert preferences.segments(*preferences.negatives(conversations.limit(0)), key="conv_id").count() == 0
    assert preferences.segments(*preferences.negatives(conversations.where("conv_id = 50")), key="conv_id").count() == 0


def test_byte_pairs_equal_the_library(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    ref, mine = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path)
    r = random.Random(3)
    pool = ["é", "ñ", "x", "th", "ing", "a", "  ", "\n", "\x1c", "\x85", "\xa0", "Σ", "İ", "1", "½", "!!", "...", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "日本", "한국", "😀", "é", "A", "The", "ation", "ß", "​", "-", "ﬁ", "٣", "\x00"]
    texts = ["", "aaaa" * 50, "supercalifragilistic " * 20, *("".join(r.choices(pool, k=r.randint(0, 12))) for _ in range(2000))]
    d = docs_of(spark, [*enumerate(texts), (None, None), (0, "")])
    got = {}
    for row in bpe.encode_documents(d, path).collect():
        got.setdefault(row.doc_id, row)
    for i, t in enumerate(texts):
        ids = ref.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[None].n_tokens == 0
    for _ in range(3000):
        w = "".join(mine.letters[b] for b in "".join(r.choices("aeiouthnsrlé", k=r.randint(1, 20))).encode())
        assert mine.encode_word(w) == mine.merged(w)


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    t = sharding.lookup_table(names, 251)
    count = np.bincount(t)
    assert count.max() - count.min() <= 1 and (t >= 0).all()
    less = sharding.lookup_table(names[:-1], 251)
    kept = t < 6
    assert (t[kept] != less[kept]).mean() < 0.25
    owner, asked = {}, {n: 0 for n in names}  # turn by turn, as the rule says
    order = {n: [(sharding._number("start " + n) + j * (sharding._number("step " + n) % 250 + 1)) % 251 for j in range(251)] for n in names}
    while len(owner) < 251:
        for n in names:
            free = next((s for s in order[n] if s not in owner), None)
            if free is not None:
                owner[free] = n
    assert [owner[i] for i in range(251)] == [names[i] for i in t]
    d = sharding.placed(docs_of(spark, [(i, "t") for i in range(500)] + [(None, "t"), (3, "u")]), "doc_id", names, 251)
    for r in d.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, owner[slot])
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 250)


def test_warc_round_trip(spark):
    html = ["", None, "<p>a</p>", "<p>a</p>", "é" * 30000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nx\r\n\r\nWARC/1.1\r\n", "0\r\n\r\n" * 9000, "<p>a</p>"]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(None, "u", "h", "z"), (2, None, "<p>a</p>", "z")], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        b = (h or "").encode()
        top = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == top else ("revisit", top))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_incomplete_records(spark, tmp_path):
    parts = list(warc._records(1, "u", b"abc" * 5000, "D", None, 4000, 1000))
    assert len(parts) > 3
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"\r\n\r\n".join([*parts[:1], *parts[2:], b""])))
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"\r\n\r\n".join([*warc._records(2, "u", b"ok", "D", None, 4000, 1000), b""])))
    rows = {r.origin: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert not rows["<urn:page:1>"].complete and rows["<urn:page:1>"].payload is None
    assert rows["<urn:page:2>"].complete and rows["<urn:page:2>"].payload == b"ok"


def test_licenses(spark):
    filler = " ".join(words(random.Random(1), 300))
    gpl = dict(licenses.NOTICES)["gpl-3.0"]
    d = [(1, f"{filler}\n{gpl.upper()}\n{filler}"), (2, gpl.replace("GNU", "Nice")), (3, gpl[:40]), (4, None), (5, ""), (6, f"x {dict(licenses.NOTICES)['mit']} y all rights reserved"), (7, filler), (8, gpl.replace("version 3", "version 2")), (6, "All rights reserved.")]
    got = sorted((r.doc_id, r.license_id, r.matched, r.total) for r in licenses.scan(docs_of(spark, d), licenses.notices(spark)).collect())
    assert got == [(1, "gpl-3.0", 8, 8), (6, "all-rights-reserved", 1, 1), (6, "mit", 1, 1), (8, "gpl-3.0", 7, 8)]
    assert licenses.scan(docs_of(spark, []), licenses.notices(spark)).count() == 0 and licenses.scan(docs_of(spark, d), licenses.notices(spark).limit(0)).count() == 0


def test_licenses_are_a_table_of_whole_texts(spark, monkeypatch):
    """Long notices, repeated ids and texts, clashing columns and very long texts, against windows formed one by one."""
    rng = random.Random(7)
    vocabulary = words(rng, 60)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    known = [(f"l{i}", text(n)) for i, n in enumerate([1, 3, 5, 9, 30, 80, 300])] + [("l4", text(20)), ("none", "  "), (None, text(9))]
    rows = [(i, f"{text(rng.randrange(40))} {known[i % 8][1]} {text(rng.randrange(40))}") for i in range(24)]
    rows += [(3, known[5][1][: len(known[5][1]) // 2]), (3, known[5][1][len(known[5][1]) // 2 :]), (None, known[5][1]), (90, text(40_000) + " " + known[6][1]), (91, None), (0, rows[0][1])]
    for i in range(8):  # a few words replaced
        w = known[6][1].split()
        for j in rng.sample(range(300), 6 * i):
            w[j] = "other"
        rows.append((50 + i, " ".join(w)))

    def cut(t):
        return [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]

    def pieces(w, n):
        return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]

    want = {}
    for doc, t in rows:
        for name, notice in known:
            if name is None or not cut(notice):
                continue
            n = min(5, len(cut(notice)))
            s, half = pieces(cut(notice), n), 1
            while half < len(s):
                half *= 2
            p = pieces(cut(t), n)
            for k in range(0, len(p), half):
                m = len(set(p[k : k + 2 * half]) & set(s))
                if 100 * m >= 80 * len(set(s)):
                    want[doc, name] = max(want.get((doc, name), (0, 0, 0)), (m / len(set(s)), m, len(set(s))))
    docs = docs_of(spark, rows).withColumns({c: F.lit("x") for c in ("license_id", "n", "w", "half", "shingle")})
    templates = spark.createDataFrame(known, "license_id string, text string").withColumn("doc_id", F.lit(1))
    assert len(want) > 40
    for most in (2000, 3):  # with and without a choice of texts by words
        monkeypatch.setattr(licenses, "MOST_WORDS", most)
        got = licenses.scan(docs, templates).collect()
        assert {(r.doc_id, r.license_id): (r.matched, r.total) for r in got} == {k: v[1:] for k, v in want.items()} and len(got) == len(want)
