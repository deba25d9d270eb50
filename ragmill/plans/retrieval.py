"""Queries on retrieval and its evaluation, with their oracles; the flagship is among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions import text as X
from ragmill.operators import evaluate as E
from ragmill.operators import lexical as L
from ragmill.operators import retrieve as R
from ragmill.sources.tables import kept, scratch, small_side, table


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where("id % 50 = 0")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Where the index of a table's files lies: the paths, sizes and times of its files, and the application, make the key.
_INDEXES: dict[str, str] = {}


def lexical(spark: SparkSession, sf: str) -> L.LexicalIndex:
    """The index of all documents: written when it is first asked for, and opened again as long as the files are the same."""
    docs = table(spark, sf, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    key = files.agg(F.concat(F.lit(f"{spark.sparkContext.applicationId} "), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).cast("string"))).first()[0] or "empty"
    if key not in _INDEXES:
        _INDEXES[key] = L.write_index(docs, scratch(spark, "bm25")).path
    return L.open_index(spark, _INDEXES[key])


def f1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.hash_embedding(F.col("text")).alias("e")).select("doc_id", *(F.col("e")[i].alias(f"e{i}") for i in range(4)))


def f2(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector with its label's first vector."""
    e = table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


def f3(spark: SparkSession, sf: str) -> DataFrame:
    return R.exact_topk(vectors(spark, sf), probes(spark, sf), 10)


def f4(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = R.ivf_build(vectors(spark, sf), 16)
    return index.groupBy("list_id").agg(F.count("*").alias("n_vectors"))


def f5(spark: SparkSession, sf: str) -> DataFrame:
    index, centres = R.ivf_build(vectors(spark, sf), 16)
    return R.ivf_topk(index, centres, probes(spark, sf), R.ivf_probes(index, centres, probes(spark, sf), 10), 10)


def f6(spark: SparkSession, sf: str) -> DataFrame:
    index, centres = R.ivf_build(vectors(spark, sf), 16)
    sweep = sorted({1, 2, 4, R.ivf_probes(index, centres, probes(spark, sf), 10)})
    candidates = kept(R.ivf_candidates(index, centres, probes(spark, sf), sweep[-1], 10), "candidates")  # one search serves all numbers of probes
    found = {p: R.best_of_probes(candidates, p, 10) for p in sweep}
    return R.recall_report(f3(spark, sf), found, 16, 10)


def f7(spark: SparkSession, sf: str) -> DataFrame:
    return lexical(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def f8(spark: SparkSession, sf: str) -> DataFrame:
    return L.search(lexical(spark, sf), questions(spark, sf), 10).withColumn("score", F.round("score", 6))


def _by_label(spark: SparkSession, sf: str) -> DataFrame:
    """A second ranking of the same queries: same label first, then by id. Each label's first 11 rows give any query its first 10 others."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    heads = R.ranked(e.where("label is not null"), ["label"], [F.col("vec_id")], 11).select("label", F.col("vec_id").alias("doc_id"))
    return R.ranked(q.join(heads, "label").where("doc_id <> query_id").select("query_id", "doc_id"), ["query_id"], [F.col("doc_id")], 10)


def f9(spark: SparkSession, sf: str) -> DataFrame:
    return R.rrf_fuse([f3(spark, sf), _by_label(spark, sf)], 10).withColumn("score", F.round("score", 6))


def f10(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "documents").withColumn("key", F.lower(F.regexp_extract("text", r"^([A-Za-z]+)", 1))).where("key <> ''").groupBy("key").agg(F.min("doc_id").cast("string").alias("entry"))
    return R.lookup_context(questions(spark, sf), entries, "no entry")


def f11(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge_rankings(f3(spark, sf), _by_label(spark, sf))


def f12(spark: SparkSession, sf: str) -> DataFrame:
    order = F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(99), (F.col("query_id") % 7 + 2).cast("int"))
    top = f3(spark, sf)
    return R.apply_rerank(top, top.select("query_id").distinct().withColumn("order", order), 10)


def f13(spark: SparkSession, sf: str) -> DataFrame:
    context = R.assemble_context(f8(spark, sf), table(spark, sf, "documents"), 5)
    return context.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def f14(spark: SparkSession, sf: str) -> DataFrame:
    return R.combine_history(table(spark, sf, "conversations"))


def f15(spark: SparkSession, sf: str) -> DataFrame:
    phrases = questions(spark, sf).select("query_id", F.substring("text", 1, 15).alias("phrase"))
    return R.rank_probe(L.search(lexical(spark, sf), questions(spark, sf), 100), table(spark, sf, "documents"), phrases, [20, 40, 60, 100])


def f16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", R.snippet(F.col("text"), "License").alias("snippet")).where("snippet is not null")


def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest words of each benchmark item."""
    words = F.transform(F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[.,\n]", " "), " +")), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.transform(F.slice(F.array_sort(words), 1, 3), lambda x: x["w"])).alias("keyword")).where("keyword <> ''")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    found = small_side(L.search(lexical(spark, sf), questions(spark, sf), 10), "found")  # texts stay where they are
    return found.join(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id").select(F.col("query_id").alias("question_id"), "rank", "text", "lang")


def i12_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = E.keyword_scores(_keywords(spark, sf), _results(spark, sf))
    return s.select("question_id", "keyword", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("len"), F.floor(F.length("text") / 100).cast("string")).alias("category"))
    return E.question_scores(q, E.keyword_scores(_keywords(spark, sf), _results(spark, sf)))


def i3(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def i4(spark: SparkSession, sf: str) -> DataFrame:
    return E.summary(_scored(spark, sf), "category", ["mrr", "ndcg", "coverage"])


def i5(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("question_id", *(E.band(F.col(m), m).alias(m) for m in ("mrr", "ndcg", "coverage")))


def i6(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).orderBy("mrr", "ndcg", "coverage", "question_id").limit(20)


def i7(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return E.summary(j.select("lang", F.col("quality").cast("double").alias("accuracy"), (1 - F.col("toxic")).cast("double").alias("relevance")), "lang", ["accuracy", "relevance"])


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    queries = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return E.golden_metrics(queries, table(spark, sf, "qrels"), f3(spark, sf))


def i9(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("type"), (F.col("label") % 4).cast("string")).alias("kind"))
    rows = _golden(spark, sf).where("recall is not null").join(labels, "query_id").withColumn("coverage", F.col("covered").cast("double"))
    return E.summary(rows, "kind", ["recall", "precision", "rr", "coverage"])


def i10(spark: SparkSession, sf: str) -> DataFrame:
    return E.weakest(i9(spark, sf).where("overall = 0"), "kind", ["recall", "rr", "coverage"])


def i11(spark: SparkSession, sf: str) -> DataFrame:
    def totals(found: DataFrame) -> DataFrame:
        queries = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
        m = E.golden_metrics(queries, table(spark, sf, "qrels"), found).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("rr"))
        return m.select(F.expr("stack(3, 'recall', recall, 'precision', precision, 'rr', rr) as (metric, value)"))

    return E.compare(totals(f3(spark, sf)), totals(f9(spark, sf)))


def i12(spark: SparkSession, sf: str) -> DataFrame:
    """By source: documents, how many are judged, and judged ones whose version is superseded."""
    c = table(spark, sf, "corpus").join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("judged")), "doc_id", "left")
    return c.groupBy("doc_type").agg(F.count("*").alias("n_docs"), F.count_if("judged").alias("n_judged"), F.count_if(F.col("judged") & (F.col("status") == "superseded")).alias("n_stale"), F.round(F.avg(F.col("judged").isNull().cast("double")), 6).alias("share_unjudged"))


def i14(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.parse_guess(F.col("text")).alias("guess"))


def _guesses(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "p_partkey", F.col("p_retailprice").alias("truth"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("guess"))


def i15(spark: SparkSession, sf: str) -> DataFrame:
    return E.error_report(_guesses(spark, sf), "truth", "guess")


def i16(spark: SparkSession, sf: str) -> DataFrame:
    g = _guesses(spark, sf).withColumn("error", F.round(F.abs(F.col("guess") - F.col("truth")), 4))
    return E.running_error(g, "p_partkey", ["l_orderkey", "l_linenumber", "error"], "error").groupBy("p_partkey").agg(F.round(F.log1p(F.sum("mean_error")), 6).alias("log_mean"), F.round(F.log1p(F.sum("band")), 6).alias("log_band"))


def i16_long(spark: SparkSession, sf: str) -> DataFrame:
    """One series of all order lines."""
    g = table(spark, sf, "lineitem").select(F.lit("all").alias("series"), "l_orderkey", "l_linenumber", "l_quantity")
    return E.running_error(g, "series", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", F.floor(F.col("mean_error") * 10000).alias("mean_e4"), F.floor(F.col("band") * 10000).alias("band_e4"))


QUERIES = {
    "f1_hash_embedding": f1, "f2_cosine": f2, "f3_exact_topk": f3, "f4_ivf_build": f4, "f5_ivf_topk": f5, "f6_ann_recall_report": f6, "f7_bm25_index": f7, "f8_bm25_topk": f8,
    "f9_rrf_fuse": f9, "f10_lookup_context": f10, "f11_merge_rankings": f11, "f12_apply_rerank": f12, "f13_assemble_context": f13, "f14_combine_history": f14, "f15_gold_rank_probe": f15,
    "f16_keyword_snippets": f16, "i1_i2_keyword_scores": i12_scores, "i3_retrieval_eval": i3, "i4_eval_summary": i4, "i5_metric_bands": i5, "i6_worst_questions": i6, "i7_judge_summary": i7,
    "i8_golden_metrics": _golden, "i9_golden_by_type": i9, "i10_diagnose_slices": i10, "i11_compare_runs": i11, "i12_judgement_gaps": i12, "i14_parse_guess": i14, "i15_price_error_report": i15, "i16_running_error": i16,
    "i16_one_long_series": i16_long,
}

_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"
_COS = "round(" + _DOT.format(a="a", b="b") + " / (sqrt(" + _DOT.format(a="a", b="a") + ") * sqrt(" + _DOT.format(a="b", b="b") + ")), 6)"
_TOP = f"""p as (select q.vec_id query_id, d.vec_id doc_id, q.embedding a, d.embedding b from embeddings q, embeddings d where q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
    f3 as (select query_id, rank, doc_id, score from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) rank from (select query_id, doc_id, {_COS} score from p)) where rank <= 10)"""
_LABEL = """lab as (select * from (select q.vec_id query_id, d.vec_id doc_id, row_number() over (partition by q.vec_id order by d.vec_id) rank from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 50 = 0) where rank <= 10)"""
_FUSED = """f9 as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) rank from (select query_id, doc_id, round(sum(1.0::double / (59 + rank)), 9) score
    from (select query_id, doc_id, rank from f3 union all select query_id, doc_id, rank from lab) group by all)) where rank <= 10)"""
_BM25 = """dt as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') w from documents),
    post as (select doc_id, dl, term, count(*) tf from (select doc_id, len(w) dl, unnest(w) term from dt) group by all),
    tot as (select count(*) n, avg(len(w)) avgdl from dt), dfs as (select term, count(*) df from post group by term),
    raw as (select term, df, ln((n - df + 0.5) / (df + 0.5)) idf, avgdl from dfs, tot),
    terms as (select term, df, case when idf < 0 then 0.25 * (select avg(idf) from raw) else idf end idf, avgdl from raw)"""
_BM25_SCORES = """qt as (select item_id query_id, term, count(*) qtf from (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) term from benchmark) group by all),
    sc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) score from qt join terms using (term) join post using (term) group by all),
    bm as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) rank from sc)"""
_EVAL = f"""with {_BM25}, {_BM25_SCORES},
    kw as (select distinct item_id question_id, w keyword from (select item_id, unnest(list_sort(list_transform(list_distinct(regexp_split_to_array(regexp_replace(lower(text), '[.,\\n]', ' ', 'g'), ' +')), lambda w: struct_pack(l := -length(w), w := w)))[1:3], recursive := true) from benchmark) where w <> ''),
    res as (select query_id question_id, rank, text from bm join documents using (doc_id) where rank <= 10),
    hit as (select question_id, keyword, rank, contains(lower(text), lower(keyword)) h from kw join res using (question_id)),
    ks as (select question_id, keyword, max(case when h then 1.0::double / rank else 0 end) rr, sum(case when h then 1.0 / log2(rank + 1) else 0 end) dcg, count(*) filter (h) n from hit group by all),
    sc2 as (select question_id, keyword, coalesce(rr, 0) rr, coalesce(case when n > 0 then dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / log2(i + 1))) end, 0) ndcg from kw left join ks using (question_id, keyword)),
    qs as (select item_id question_id, 'len' || (length(text) // 100) category, round(coalesce(mrr, 0), 6) mrr, round(coalesce(ndcg, 0), 6) ndcg, coalesce(found, 0) found, round(coalesce(found / n * 100, 0), 6) coverage
      from benchmark left join (select question_id, avg(rr) mrr, avg(ndcg) ndcg, count(*) filter (rr > 0) found, count(*) n from sc2 group by question_id) x on x.question_id = item_id)"""
_BAND = "case when {m} >= {g} then 'green' when {m} >= {a} then 'amber' else 'red' end"
_GOLD = """n as (select query_id, count(*) nr from qrels group by 1), h as (select query_id, count(*) filter (rank <= 3) h, min(rank) first from {r} join qrels using (query_id, doc_id) group by 1),
    gm as (select vec_id query_id, case when nr is not null then round(coalesce(h, 0) / nr, 6) end recall, case when nr is not null then round(coalesce(h, 0) / 3, 6) end "precision",
    case when nr is not null then round(coalesce(1.0::double / first, 0), 6) end rr, case when nr is not null then coalesce(h, 0) > 0 end covered from embeddings e left join n on n.query_id = vec_id left join h on h.query_id = vec_id where vec_id % 50 = 0)"""
_QREL = "qrels as (select q.vec_id query_id, d.vec_id doc_id from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 50 = 0)"
_KIND = f"""with {_QREL}, {_TOP}, {_GOLD.replace('{r}', 'f3')}, k as (select gm.*, 'type' || (label % 4) kind, covered::int::double coverage from gm join embeddings on vec_id = query_id where recall is not null),
    s as (select kind, count(*) n, round(avg(recall), 6) recall, round(avg("precision"), 6) "precision", round(avg(rr), 6) rr, round(avg(coverage), 6) coverage, grouping(kind)::integer overall from k group by grouping sets ((), (kind)))"""
_GUESS = "g as (select l_orderkey, l_linenumber, p_partkey, p_retailprice truth, l_extendedprice / l_quantity guess from lineitem join part on l_partkey = p_partkey)"

ORACLES = {
    "f1_hash_embedding": "select doc_id, " + ", ".join(f"round(('0x' || substr(sha256(text), {2 * i + 1}, 2))::int / 255.0::double, 3) e{i}" for i in range(4)) + " from documents",
    "f2_cosine": f"with f as (select label, min_by(embedding, vec_id) b from embeddings group by label), p as (select vec_id, embedding a, b from embeddings join f using (label)) select vec_id, {_COS} cosine from p",
    "f3_exact_topk": f"with {_TOP} select query_id, rank, doc_id, score from f3",
    "f7_bm25_index": f"with {_BM25} select term, df, round(idf, 6) idf from terms",
    "f8_bm25_topk": f"with {_BM25}, {_BM25_SCORES} select query_id, rank, doc_id, round(score, 6) score from bm where rank <= 10",
    "f9_rrf_fuse": f"with {_TOP}, {_LABEL}, {_FUSED} select query_id, rank, doc_id, round(score, 6) score from f9",
    "f10_lookup_context": """with d as (select lower(regexp_extract(text, '^([A-Za-z]+)', 1)) key, cast(min(doc_id) as varchar) entry from documents group by 1 having key <> ''),
        w as (select distinct item_id query_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +')) key from benchmark)
        select item_id query_id, coalesce(string_agg(entry, chr(10) order by w.key) filter (entry is not null), 'no entry') context from benchmark left join w on w.query_id = item_id left join d on d.key = w.key group by item_id""",
    "f11_merge_rankings": f"""with {_TOP}, {_LABEL}, u as (select query_id, doc_id, min(struct_pack(l := l, r := rank)) x from (select query_id, doc_id, rank, 1 l from f3 union all select query_id, doc_id, rank, 2 from lab) group by all)
        select query_id, cast(row_number() over (partition by query_id order by x) as integer) rank, doc_id from u""",
    "f12_apply_rerank": f"""with {_TOP}, q as (select distinct query_id from f3),
        o as (select query_id, unnest([1, 2, 3]) at_, unnest([3, 1, case when query_id % 7 + 2 = 3 then -1 else query_id % 7 + 2 end]) place from q)
        select f3.query_id, cast(row_number() over (partition by f3.query_id order by at_) as integer) rank, doc_id from o join f3 on f3.query_id = o.query_id and f3.rank = o.place""",
    "f13_assemble_context": f"""with {_BM25}, {_BM25_SCORES}, c as (select query_id, string_agg('Extract from ' || source || ':' || chr(10) || text, chr(10) || chr(10) order by rank) x from bm join documents using (doc_id) where rank <= 5 group by query_id)
        select query_id, cast(length(x) as integer) n_chars, md5(x) digest from c""",
    "f14_combine_history": """select conv_id, turn, coalesce(string_agg(case when role = 'user' then text end, chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), '') || chr(10) || text question
        from conversations qualify role = 'user'""",
    "f15_gold_rank_probe": f"""with {_BM25}, {_BM25_SCORES}, h as (select query_id, rank, contains(d.text, substr(b.text, 1, 15)) hit from bm join documents d using (doc_id) join benchmark b on b.item_id = query_id where rank <= 100)
        select query_id, depth::integer depth, cast(min(case when hit and rank <= depth then rank end) as integer) first_rank from h, (select unnest([20, 40, 60, 100]) depth) group by all""",
    "f16_keyword_snippets": "select doc_id, substr(text, greatest(p - 500, 1), p - greatest(p - 500, 1) + 1000) snippet from (select doc_id, text, strpos(text, 'License') p from documents) where p > 0",
    "i1_i2_keyword_scores": _EVAL + " select question_id, keyword, round(rr, 6) rr, round(ndcg, 6) ndcg from sc2",
    "i3_retrieval_eval": _EVAL + " select * from qs",
    "i4_eval_summary": _EVAL + " select category, count(*) n, round(avg(mrr), 6) mrr, round(avg(ndcg), 6) ndcg, round(avg(coverage), 6) coverage, grouping(category)::integer overall from qs group by grouping sets ((), (category))",
    "i5_metric_bands": _EVAL + " select question_id, " + ", ".join(f"{_BAND.format(m=m, g=E.BANDS[m][0], a=E.BANDS[m][1])} {m}" for m in ("mrr", "ndcg", "coverage")) + " from qs",
    "i6_worst_questions": _EVAL + " select * from qs order by mrr, ndcg, coverage, question_id limit 20",
    "i7_judge_summary": """select lang, count(*) n, round(avg(quality), 6) accuracy, round(avg(1 - toxic), 6) relevance, grouping(lang)::integer overall from labels join documents using (doc_id) group by grouping sets ((), (lang))""",
    "i8_golden_metrics": f"with {_QREL}, {_TOP}, {_GOLD.replace('{r}', 'f3')} select * from gm",
    "i9_golden_by_type": _KIND + " select * from s",
    "i10_diagnose_slices": _KIND + " " + " union all ".join(f"select '{m}' metric, min_by(kind, struct_pack(a := {m}, b := kind)) slice, min({m}) value from s where overall = 0" for m in ("recall", "rr", "coverage")),
    "i11_compare_runs": f"with {_QREL}, {_TOP}, {_LABEL}, {_FUSED}, {_GOLD.replace('{r}', 'f3')}, {_GOLD.replace('{r}', 'f9').replace('n as', 'n2 as', 1).replace('h as (', 'h2 as (', 1).replace('gm as', 'gm2 as').replace('left join n on n.', 'left join n2 on n2.').replace('left join h on h.', 'left join h2 on h2.')}, "
    + "a as (select round(avg(recall), 6) recall, round(avg(\"precision\"), 6) \"precision\", round(avg(rr), 6) rr from gm), b as (select round(avg(recall), 6) recall, round(avg(\"precision\"), 6) \"precision\", round(avg(rr), 6) rr from gm2) "
    + " union all ".join(f"select '{m}' metric, a.\"{m}\" baseline, b.\"{m}\" \"new\", round(case when a.\"{m}\" <> 0 then b.\"{m}\" / a.\"{m}\" - 1 end, 6) change from a, b" for m in ("recall", "precision", "rr")),
    "i12_judgement_gaps": """select doc_type, count(*) n_docs, count(l.doc_id) n_judged, count(*) filter (l.doc_id is not null and status = 'superseded') n_stale, round(avg((l.doc_id is null)::int), 6) share_unjudged
        from {corpus} c left join labels l on l.doc_id = c.doc_id group by doc_type""",
    "i14_parse_guess": """select doc_id, coalesce(try_cast(nullif(regexp_extract(replace(replace(text, '$', ''), ',', ''), '([-+]?\\d*\\.\\d+|\\d+)', 1), '') as double), 0) guess from documents""",
    "i15_price_error_report": f"""with {_GUESS}, e as (select *, abs(guess - truth) e from g)
        select count(*) n, round(avg(e), 4) mean_error, round(avg((truth - guess) * (truth - guess)), 3) mse, round(1 - avg((truth - guess) * (truth - guess)) / var_pop(truth), 6) r2,
        round(avg((e < 40 or e / abs(truth) < 0.2)::int), 6) share_green from e""",
    "i16_one_long_series": """select l_orderkey, l_linenumber, cast(floor(sum(l_quantity) over w / count(*) over w * 10000) as bigint) mean_e4, cast(floor(case when count(*) over w > 1 then 1.96 * stddev_pop(l_quantity) over w / sqrt(count(*) over w) else 0 end * 10000) as bigint) band_e4
        from lineitem window w as (order by l_orderkey, l_linenumber, l_quantity rows between unbounded preceding and current row)""",
    "i16_running_error": f"""with {_GUESS}, e as (select *, round(abs(guess - truth), 4) e from g),
        r as (select p_partkey, avg(e) over w m, case when count(e) over w > 1 then 1.96 * stddev_pop(e) over w / sqrt(count(e) over w) else 0 end b from e
        window w as (partition by p_partkey order by l_orderkey, l_linenumber, e rows between unbounded preceding and current row))
        select p_partkey, round(ln(1 + sum(m)), 6) log_mean, round(ln(1 + sum(b)), 6) log_band from r group by p_partkey""",
}
