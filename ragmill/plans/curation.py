"""Queries on curation, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions import text as X
from ragmill.operators import curate as C
from ragmill.operators.order_stats import quantiles
from ragmill.sources.tables import kept, table


def parse_price(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("raw"))
    return raw.select("p_partkey", X.parse_price(F.col("raw")).alias("price")).where("price is not null")


def item_weight(spark: SparkSession, sf: str) -> DataFrame:
    units = F.array(*map(F.lit, [*X.POUND_DIVISORS, "stone"]))
    raw = table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 11 == 0, "x").otherwise(F.col("p_size").cast("string")), F.lit(" "), F.element_at(units, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("raw"))
    return raw.select("p_partkey", F.round(X.pounds(F.col("raw")), 8).alias("pounds"))


def simplify_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.simplify(F.col("text")).alias("simple"))


def product_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as products: a title, the text as description, features with a part number, and details of which two say nothing."""
    details = F.create_map(F.lit("Color"), F.col("lang"), F.lit("Item model number"), F.concat(F.lit("M"), F.col("doc_id").cast("string")), F.lit("Part Number"), F.lit("X1"))
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("description"), F.concat(F.lit("fits AB12345 and "), F.col("lang")).alias("features"), details.alias("details"))


def scrub_text(spark: SparkSession, sf: str) -> DataFrame:
    d = product_parts(spark, sf).select("doc_id", X.product_text(F.col("title"), F.col("description"), F.col("features"), F.col("details")).alias("scrubbed"))
    return d.where(F.length("scrubbed") >= 600).select("doc_id", F.length("scrubbed").alias("n_chars"), F.md5("scrubbed").alias("digest"))


def full_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("full", X.full_text(F.col("source"), F.col("lang"), F.col("text")))
    return d.select("doc_id", F.length("full").alias("n_chars"), F.md5("full").alias("digest"))


def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return C.funnel(table(spark, sf, "documents"), {"has_text": F.length("text") > 0, "in_range": F.col("n_chars").between(200, 20000), "long_enough": F.length("text") >= 600})


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", X.count_words(F.col("text")).cast("long").alias("t"), F.length("text").cast("long").alias("c"))
    d = kept(d, "token-counts")
    g = d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("t").alias("tokens"), F.round(F.sum("c") / F.sum("t"), 6).alias("chars_per_token"))
    q = quantiles(d, ["lang"], "t", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return g.join(q, "lang", "left").select("lang", "n_docs", "tokens", "chars_per_token", *(F.round(n, 4).alias(n) for n in ("p50", "p90", "p99")))


def token_cap_table(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_caps(table(spark, sf, "documents"), X.count_words(F.col("text")), [200, 355, 462, 683])


def truncate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.first_words(F.col("text"), 355).alias("head"))


def make_prompts(spark: SparkSession, sf: str) -> DataFrame:
    full, test = C.prompts("How much does this cost to the nearest dollar?", F.col("p_name"), F.col("p_retailprice"))
    return table(spark, sf, "part").select("p_partkey", full.alias("prompt"), test.alias("test_prompt"))


_ALIASES = [("en", "English"), ("eng", "English"), ("fr", "French"), ("de", "German"), ("ger", "German")]


def normalize_filter_values(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame(_ALIASES, "alias string, canonical string")
    return C.normalize_values(table(spark, sf, "documents").select("doc_id", F.upper("lang").alias("lang")), "lang", aliases)


def unmapped_filter_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.unmapped_values(table(spark, sf, "documents"), "lang", spark.createDataFrame(_ALIASES, "alias string, canonical string"))


def duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_sizes(table(spark, sf, "documents"), F.col("text"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a score of 1 or 2 by their quality label, which copies of a text may not share; null where there is no label."""
    score = (F.col("quality") + 1).cast("double").alias("score")
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash")).join(table(spark, sf, "labels").select("doc_id", score), "doc_id", "left")


def dedupe_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    """First by source and whole text, then by whole text: every distinct text stays."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("\n", "source", "text"), 256).alias("sourced"), F.sha2("text", 256).alias("text_hash"), C.seeded("doc_id", "s1").alias("o"))
    once = C.keep_first(d, F.col("sourced"), F.col("o"), "doc_id")
    return C.keep_first(once, F.col("text_hash"), F.col("o"), "doc_id").select("doc_id")


def spread_by_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.duplicate_spread(_judged(spark, sf), F.col("text_hash"), F.col("score"))


def conflicts_by_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    return C.conflict_aware(_judged(spark, sf), F.col("text_hash"), F.col("score"), "doc_id")


def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = C.price_weight(table(spark, sf, "part"), "p_retailprice", "p_brand", "Brand#11", "Brand#22")
    return C.weighted_sample(p, F.col("weight"), "p_partkey", 500, "w").select("p_partkey", F.round("weight", 6).alias("weight"))


def split_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id")
    return C.split_by_rank(d, "doc_id", "split", [("train", 0.8), ("validation", 0.1), ("test", 0.1)])


def histogram_length(spark: SparkSession, sf: str) -> DataFrame:
    return C.histogram(table(spark, sf, "documents"), F.length("text"), 500)


def histogram_price(spark: SparkSession, sf: str) -> DataFrame:
    return C.histogram(table(spark, sf, "part"), F.col("p_retailprice"), 50)


def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return C.profile(table(spark, sf, "lineitem"), "l_extendedprice")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.category_counts(table(spark, sf, "documents"), "source", "lang")


def top_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


def shortest_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")).orderBy("n", "doc_id").limit(10)


QUERIES = {
    "b1_parse_price": parse_price, "b2_item_weight_pounds": item_weight, "b3_simplify_text": simplify_text, "b4_scrub_text": scrub_text, "b5_full_text": full_text,
    "b6_filter_funnel": filter_funnel, "b7_token_stats": token_stats, "b8_token_cap_table": token_cap_table, "b9_truncate_tokens": truncate_tokens, "b10_make_prompts": make_prompts,
    "b11_normalize_filter_values": normalize_filter_values, "b11_unmapped_filter_values": unmapped_filter_values, "c1_dedupe_keep_first": dedupe_whole_text,
    "c2_duplicate_audit": duplicate_audit, "c3_duplicate_spread": spread_by_whole_text, "c4_conflict_aware_dedupe": conflicts_by_whole_text, "c5_weighted_sample": weighted_sample,
    "c6_split_by_rank": split_by_rank, "c7_histogram_length": histogram_length, "c7_histogram_price": histogram_price, "c8_profile_numeric": profile_numeric,
    "c9_category_counts": category_counts, "c10_top_n": top_n, "c10_shortest_texts": shortest_texts,
}

_JUDGED = "j as (select d.doc_id, text, (quality + 1)::double score from documents d left join labels l on l.doc_id = d.doc_id)"
_TOKENS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
ORACLES = {
    "b1_parse_price": "select p_partkey, v price from (select p_partkey, try_cast(case when p_partkey % 7 = 0 then 'n/a' else cast(cast(p_retailprice as decimal(12,2)) as varchar) end as double) v from part) where v between 0.5 and 999.49",
    "b2_item_weight_pounds": """select p_partkey, round(case when p_partkey % 11 = 0 then null when k = 0 then s when k = 1 then s / 16 when k = 2 then s / 453.592 when k = 3 then s / 453592
        when k = 4 then s / 0.453592 when k = 5 then s / 100 else 0 end, 8) pounds from (select p_partkey, p_partkey % 7 k, cast(p_size as double) s from part)""",
    "b3_simplify_text": "select doc_id, substr(trim(replace(replace(replace(replace(text, chr(10), ' '), chr(13), ''), chr(9), ''), '  ', ' ')), 1, 3000) simple from documents",
    "b5_full_text": "select doc_id, cast(length(source || ' ' || lang || ' ' || text) as integer) n_chars, md5(source || ' ' || lang || ' ' || text) digest from documents",
    "b6_filter_funnel": """with a as (select count(*) n, count(*) filter (length(text) > 0) a, count(*) filter (length(text) > 0 and n_chars between 200 and 20000) b,
        count(*) filter (length(text) > 0 and n_chars between 200 and 20000 and length(text) >= 600) c from documents)
        select 0 step_no, 'all' step, n n_rows, 1.0::double share from a union all select 1, 'has_text', a, round(a / n, 6) from a
        union all select 2, 'in_range', b, round(b / n, 6) from a union all select 3, 'long_enough', c, round(c / n, 6) from a""",
    "b7_token_stats": f"""with t as (select lang, cast({_TOKENS} as bigint) t, length(text) c from documents)
        select lang, count(*) n_docs, cast(sum(t) as bigint) tokens, round(sum(c) / sum(t), 6) chars_per_token, round(quantile_cont(t, 0.5), 4) p50,
        round(quantile_cont(t, 0.9), 4) p90, round(quantile_cont(t, 0.99), 4) p99 from t group by lang""",
    "b8_token_cap_table": f"""with t as (select {_TOKENS} t from documents), c as (select unnest([200, 355, 462, 683])::integer cap)
        select cap, round(avg(case when t > cap then 1.0 else 0.0 end), 6) share_trimmed, round(sum(least(t, cap)) / sum(t), 6) share_kept, cast(sum(least(t, cap)) as bigint) tokens from t, c group by cap""",
    "b9_truncate_tokens": "select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:355], ' ') head from documents",
    "b10_make_prompts": """with p as (select p_partkey, 'How much does this cost to the nearest dollar?' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || 'Price is $' head, round_even(p_retailprice, 0) v from part)
        select p_partkey, head || cast(cast(v as bigint) as varchar) || '.00' prompt, head test_prompt from p""",
    "b11_normalize_filter_values": "select doc_id, upper(lang) lang, case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else upper(lang) end normalized from documents",
    "b11_unmapped_filter_values": "select lang, count(*) n_rows from documents where lang not in ('en', 'fr', 'de') group by lang",
    "c2_duplicate_audit": "select group_size, count(*) n_groups, count(*) * (group_size - 1) extra_copies from (select count(*) group_size from documents group by text) group by group_size",
    "c1_dedupe_keep_first": """with d as (select doc_id, concat_ws(chr(10), source, text) k, text, md5('s1' || cast(doc_id as varchar)) o from documents),
        a as (select * from d qualify row_number() over (partition by k order by o, doc_id) = 1) select doc_id from a qualify row_number() over (partition by text order by o, doc_id) = 1""",
    "c3_duplicate_spread": f"""with {_JUDGED} select case when hi is null then 'no value' when hi = lo then 'equal' when lo > 0 and hi / lo <= 1.2 then 'within_20' else 'above_20' end spread, count(*) n_groups
        from (select max(score) hi, min(score) lo from j group by text having count(*) > 1) group by all""",
    "c4_conflict_aware_dedupe": f"with {_JUDGED} select min(doc_id) doc_id, round(avg(score), 4) mean_value, count(*) n_rows from j group by text having coalesce(max(score) <= min(score) * 1.2::double, true)",
    "c5_weighted_sample": """with e as (select min(p_retailprice) lo, max(p_retailprice) hi from part),
        w as (select p_partkey, pow((p_retailprice - lo) / (hi - lo + 1e-9::double), 2) * case p_brand when 'Brand#11' then 0.5::double when 'Brand#22' then 0.05::double else 1 end weight,
        (('0x' || substr(md5('w' || cast(p_partkey as varchar)), 1, 12))::bigint::double + 0.5) / 281474976710656 u from part, e)
        select p_partkey, round(weight, 6) weight from (select * from w where weight > 0 order by -ln(u) / weight, p_partkey limit 500)""",
    "c6_split_by_rank": """with r as (select doc_id, row_number() over (order by md5('split' || cast(doc_id as varchar)), doc_id) rank, count(*) over () n from documents)
        select doc_id, rank, case when rank <= floor(n * 0.8::double) then 'train' when rank <= floor(n * (0.8::double + 0.1::double)) then 'validation' else 'test' end split from r""",
    "c7_histogram_length": "select cast(floor(length(text) / 500.0) as bigint) bin, count(*) n_rows from documents group by all",
    "c7_histogram_price": "select cast(floor(p_retailprice / 50) as bigint) bin, count(*) n_rows from part group by all",
    "c8_profile_numeric": """select count(l_extendedprice) n, round(avg(l_extendedprice), 4) mean, round(stddev_samp(l_extendedprice), 4) std, min(l_extendedprice) lowest, max(l_extendedprice) highest,
        round(quantile_cont(l_extendedprice, 0.25), 4) p25, round(quantile_cont(l_extendedprice, 0.5), 4) p50, round(quantile_cont(l_extendedprice, 0.75), 4) p75,
        round(quantile_cont(l_extendedprice, 0.95), 4) p95, round(quantile_cont(l_extendedprice, 0.99), 4) p99 from lineitem""",
    "c9_category_counts": "select source, lang, count(*) n_rows, round(count(*) / sum(count(*)) over (), 6) share from documents group by source, lang",
    "c10_top_n": "select p_partkey, p_name, p_retailprice from part order by p_retailprice desc, p_partkey limit 10",
    "c10_shortest_texts": "select doc_id, cast(length(text) as integer) n from documents order by n, doc_id limit 10",
}
