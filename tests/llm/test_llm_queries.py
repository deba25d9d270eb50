"""Registered queries of the operators: oracles where SQL has them, and the pipeline against plain code on the small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

queries = pytest.importorskip("ragmill.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(name, spark, sf, same):
    same(queries.queries()[name](spark, sf), queries.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, sf):
    """Each stage against a plain version of its decision on what it got."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "repeats", "contamination", "tokens"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()
    assert good.join(clean, "doc_id").count() >= 0.97 * clean.count()
    rows = {r.doc_id: r.text for r in good.collect()}

    shingles = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    top = {i: i for i in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(rows)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            k = len(shingles[i] & shingles[j])
            if k and 100 * k >= 80 * (len(shingles[i]) + len(shingles[j]) - k):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    single = stages["near_copies"](spark, good, sf)
    assert sorted(r.doc_id for r in single.collect()) == sorted({find(i) for i in ids})

    seen, want = set(), {}
    for i in sorted({find(i) for i in ids}):
        b = rows[i].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    cut = stages["repeats"](spark, single, sf)
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == docs.columns

    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, t in want.items() if any(x in plain(t) for x in items)}
    left = stages["contamination"](spark, cut, sf)
    assert {r.doc_id for r in left.collect()} == set(want) - leaked

    out = corpus_pipeline.run(spark, sf)
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    ref = tokenizers.Tokenizer.from_file(public.path(corpus_pipeline.TOKENIZER))
    got = {r.doc_id: r.ids_sha256 for r in out.select("doc_id", "ids_sha256").collect()}
    code = lambda t: b"".join(x.to_bytes(4, "little") for x in ref.encode(t, add_special_tokens=False).ids)
    assert got == {i: hashlib.sha256(code(want[i])).hexdigest() for i in set(want) - leaked}
    assert out.where(F.col("n_tokens") < 0).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, rows without ids, and columns named like those of the stages; then an empty table."""
    r = random.Random(3)
    text = lambda n: " ".join(f"word{r.randint(0, 3000)}" for _ in range(n))
    base = [(i, text(60)) for i in range(30)]
    passage = text(40)
    odd = [(100, None), (101, ""), (102, " \t"), (103, base[0][1]), (103, base[0][1]), (104, base[1][1] + " tail"), (105, text(30) + " " + passage), (106, passage + " " + text(30)), (107, "long " * 80_000), (None, text(50)), (None, None), (108, "Benchmark item of nine plain words stands here today " + text(9))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.0, 2, "x", b"y", 5) for i, t in base + odd], "doc_id long, text string, lang string, source string, n_chars long, log_weight double, component_id int, kept string, words binary, n_tokens int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "benchmark item of nine plain words stands here today"), (2, None), (None, "x")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.coalesce(1).write.parquet(f"{tmp_path}/some/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none/{name}.parquet")
    at = f"{tmp_path}/some"
    stages, seen = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{at}/documents.parquet")
    # nothing in so few labels tells, so the classifier may only drop what its draw drops
    near = stages["near_copies"](spark, seen, at)
    ids = lambda df: sorted((x.doc_id for x in df.collect() if x.doc_id is not None))
    assert near.columns == seen.columns and {103, 104} & set(ids(near)) == set() and {0, 1, 100, 101, 102, 107} <= set(ids(near))
    cut = stages["repeats"](spark, seen, at)
    rows = {x.doc_id: x for x in cut.collect() if x.doc_id is not None}
    assert cut.columns == seen.columns and ids(cut) == sorted(rows) and rows[103].text == "" and rows[105].text.endswith(passage) and passage not in rows[106].text
    assert rows[100].text in (None, "") and len(rows[107].text) < 1000 and rows[106].n_chars == len(rows[106].text) and cut.where("doc_id is null").count() == 2
    clean = stages["contamination"](spark, seen, at)
    assert clean.columns == seen.columns and clean.count() == seen.count() - 1 and 108 not in ids(clean)
    coded = {x.doc_id: x.n_tokens for x in stages["tokens"](spark, seen, at).collect() if x.doc_id is not None}
    assert coded[100] == coded[101] == coded[102] == 0 and coded[107] == 80_000
    assert set(ids(corpus_pipeline.run(spark, at))) <= set(ids(near)) - {108}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
