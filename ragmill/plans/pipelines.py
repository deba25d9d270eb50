"""Queries on sources, sinks, baselines and streams, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.operators import baselines as L
from ragmill.sources import files as A
from ragmill.sources.tables import scratch, spread, table, written
from ragmill.streaming import jobs as S


#: Files of a folder of a tree, about, and files that are listed and read at once.
FOLDER_FILES, TREE_FILES = 1_000, 100_000


def a1(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files, one for each, under their source, and read as a tree: whole texts come back.

    A file's first line is its document's id, so a folder holds many files. A source is any text, so its folder's name has it in hex. As the driver lists what is read, that goes in turns of TREE_FILES files.
    """
    docs = table(spark, sf, "documents")
    n, sources = docs.agg(F.count("*"), F.count_distinct("source")).first()
    folders = max(1, n // (max(1, sources) * FOLDER_FILES))
    d = docs.select(F.concat(F.lit("x"), F.hex("source")).alias("source"), F.pmod(F.xxhash64("doc_id"), F.lit(folders)).alias("folder"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("value"))
    root, path = f"{scratch(spark, 'tree')}/corpus", scratch(spark, "found")
    A.write_tree(spread(d), root)
    turns, left = [[]], TREE_FILES
    for source, folder, n in d.groupBy("source", "folder").count().collect():
        if n > left and turns[-1]:
            turns, left = [*turns, []], TREE_FILES
        turns[-1].append(f"source={A.NO_VALUE if source is None else source}/folder={folder}")
        left -= n
    text = F.regexp_replace(F.expr("substr(text, instr(text, '\n') + 1)"), r"\n\z", "")  # the writer ends a file with a line break
    kind = F.unhex(F.regexp_extract("doc_type", "^source=x(.*)", 1)).cast("string")
    kind = F.when(F.col("doc_type") != f"source={A.NO_VALUE}", kind)
    if not turns[0]:
        return spark.createDataFrame([], "doc_id long, doc_type string, n_chars int, digest string")
    for turn in turns:
        found = A.read_markdown_tree(spark, root, "*.txt", turn)
        with A.small_files(spark, 1 << 14):
            found = found.select(F.substring_index("text", "\n", 1).try_cast("long").alias("doc_id"), kind.alias("doc_type"), F.length(text).alias("n_chars"), F.md5(text).alias("digest"))
            written(found.write.mode("append"), spark, path)
    return spark.read.schema(found.schema).parquet(path)


_META = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("lang", T.StringType(), False), T.StructField("content_sha256", T.StringType(), False)])


def _fronted(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.when(F.col("doc_id") % 13 == 0, F.lit("0")).otherwise(F.sha2("text", 256))
    head = F.concat(F.lit("---\ndoc_id: "), F.col("doc_id").cast("string"), F.lit('\nlang: "'), F.col("lang"), F.lit('"\ncontent_sha256: "'), sha, F.lit('"\n---\n'), F.col("text"))
    return table(spark, sf, "documents").select(F.when(F.col("doc_id") % 17 == 0, F.col("text")).otherwise(head).alias("text"), F.col("doc_id").alias("file_no"))


def a2(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = A.parse_front_matter(_fronted(spark, sf), "text", _META)
    return good.select("file_no", "doc_id", "lang", F.md5("body").alias("digest"))


def a2_rejected(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = A.parse_front_matter(_fronted(spark, sf), "text", _META)
    return bad.select("file_no", "reason")


def a3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "entities")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.json(path)
    df = A.read_entities(spark, path, T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())]))
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("key_sum"))


def a4(spark: SparkSession, sf: str) -> DataFrame:
    root, p = scratch(spark, "products"), table(spark, sf, "part")
    p.select("p_partkey", "p_name", F.col("p_retailprice").cast("string").alias("price"), F.substring_index("p_type", " ", 1).alias("kind")).write.partitionBy("kind").json(root)
    kinds = [r[0] for r in p.select(F.substring_index("p_type", " ", 1)).distinct().collect()]  # categories: a few names
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("price", T.StringType())])
    df = A.read_products(spark, {k: f"{root}/kind={k}" for k in sorted(kinds)}, schema)
    return df.groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum(F.col("price").cast("double")), 2).alias("total"))


def a5(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "vectors")
    A.write_partitioned(table(spark, sf, "embeddings"), path, "label")
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("id_sum"))


def a6(spark: SparkSession, sf: str) -> DataFrame:
    from ragmill.operators.curate import split_by_rank

    path = scratch(spark, "splits")
    A.write_partitioned(split_by_rank(table(spark, sf, "part").select("p_partkey"), "p_partkey", "parts", [("train", 0.8), ("test", 0.2)]), path, "split")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("key_sum"))


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("area"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.col("text").alias("content"))


def a7(spark: SparkSession, sf: str) -> DataFrame:
    return A.manifest(A.hash_tree(_as_files(spark, sf)))


def a7_changed(spark: SparkSession, sf: str) -> DataFrame:
    """What a comparison of two trees finds when some texts have changed, one document in fifty is gone and others are new."""
    old = _as_files(spark, sf)
    k = F.col("path").cast("long") % 50
    new = old.where(k != 7).withColumn("content", F.when(k == 3, F.concat("content", F.lit("."))).otherwise(F.col("content")))
    more = old.where(k == 9).withColumn("path", F.concat("path", F.lit("-2")))
    return A.changed_files(A.hash_tree(old), A.hash_tree(new.unionByName(more)))


def a8(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of a document is the user's message."""
    r = A.batch_requests(table(spark, sf, "documents"), "doc_id", "Summarise.", F.coalesce("text", F.lit("")), "model-1")
    back = F.from_json("value", "custom_id string, body struct<model:string,messages:array<struct<role:string,content:string>>>")
    told = r.withColumn("r", back)
    return told.select("batch_no", F.col("r.custom_id").cast("long").alias("doc_id"), F.col("r.body.model").alias("model"), F.col("r.body.messages")[0]["content"].alias("system"), F.md5(F.col("r.body.messages")[1]["content"]).alias("digest"))


def a9(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that quote the whole text, some of them delivered twice."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    line = lambda text: F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.struct(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    first = d.where("doc_id % 11 <> 0").select(line(F.concat(F.lit("old "), "text")).alias("value"), F.lit(1).alias("delivered"))
    again = d.where("doc_id % 5 = 0 and doc_id % 11 <> 0").select(line(F.concat(F.lit("new "), "text")).alias("value"), F.lit(2).alias("delivered"))
    return A.apply_responses(d, "doc_id", first.unionByName(again)).select("doc_id", "source", F.md5("summary").alias("summary"))


def a9_missing(spark: SparkSession, sf: str) -> DataFrame:
    return a9(spark, sf).where("summary is null").select("doc_id")


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return L.tabular(table(spark, sf, "part"), "p_size", "p_name")


def l1(spark: SparkSession, sf: str) -> DataFrame:
    return _part(spark, sf).select("p_partkey", "weight", "weight_unknown", "text_length")


def l2(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return L.report(L.mean_baseline(p, p, "p_retailprice"), "p_retailprice", "mean")


def _halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to train on, four fifths, and rows held out, by a hash of the key."""
    fold = F.pmod(F.xxhash64(key), F.lit(5))
    return df.where(fold > 0), df.where(fold == 0)


def l3(spark: SparkSession, sf: str) -> DataFrame:
    """Error on held-out rows, and the coefficients."""
    features = ["weight", "weight_unknown", "text_length"]
    train, test = _halves(_part(spark, sf), "p_partkey")
    model = L.linear(train, features, "p_retailprice")
    fitted = model.stages[-1]
    out = L.report(model.transform(test), "p_retailprice", "linear").withColumn("intercept", F.lit(float(fitted.intercept)))
    return out.withColumns({f"of_{f}": F.lit(float(c)) for f, c in zip(features, fitted.coefficients, strict=True)})


def _rated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("quality is not null").withColumn("quality", F.col("quality").cast("double"))
    return _halves(d, "doc_id")


def l4(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rated(spark, sf)
    got = L.bag_of_words(train, "text", "quality").transform(test).withColumn("guess", F.greatest("raw", F.lit(0.0)))
    return L.report(got, "quality", "bag_of_words")


def l5(spark: SparkSession, sf: str) -> DataFrame:
    h = L.hashed(table(spark, sf, "documents"), "text", "n_chars")
    return h.select("doc_id", F.round("scaled", 6).alias("scaled"), F.round(L.unscaled(F.col("scaled")), 3).alias("back"))


def l6(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _rated(spark, sf)
    reports = [L.report(m.transform(test), "quality", n) for n, m in L.trees(train, "text", "quality").items()]
    return reports[0].unionByName(reports[1])


def _stream(spark: SparkSession, sf: str, view: str, *closing: str) -> DataFrame:
    """A stream over a table's rows in event order, as files in the shared folder, with a last row past all watermarks."""
    path = scratch(spark, view)
    df = table(spark, sf, view).withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(path)
    last = df.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 400 days"))
    for c in closing:
        last = last.withColumn(c, F.lit(-1).cast(df.schema[c].dataType))
    last.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def j6(spark: SparkSession, sf: str) -> DataFrame:
    out = S.drain(S.windowed_metrics(_stream(spark, sf, "request_log", "tenant")), scratch(spark, "j6")).where("tenant >= 0")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tenant", "n", F.round("per_minute", 6).alias("per_minute"), F.round("mean_latency", 4).alias("mean_latency"), F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"), F.round("error_rate", 6).alias("error_rate"), F.round("timeout_rate", 6).alias("timeout_rate"), F.round("empty_rate", 6).alias("empty_rate"))


_ROUTES = [(0, "search team", "check the gateway"), (1, "billing team", "check quotas"), (3, "search team", "check the index"), (None, "platform team", "start with the dashboard")]


def j7(spark: SparkSession, sf: str) -> DataFrame:
    routes = spark.createDataFrame(_ROUTES, "tenant int, owner string, runbook string")
    out = S.drain(S.sustained_alerts(_stream(spark, sf, "request_log", "tenant"), 0.1, routes), scratch(spark, "j7")).where("tenant >= 0")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "tenant", F.round("lowest", 6).alias("lowest"), "severity", "owner", "runbook")


def j8(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "j8")
    e = table(spark, sf, "cdc_events").withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("delivery_pos")))
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e.repartitionByRange(n, "delivery_pos").sortWithinPartitions("delivery_pos").write.parquet(f"{path}/in")
    files = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", -(-n // 2)).parquet(f"{path}/in")  # several batches
    S.apply_changes(files, f"{path}/state", "30 days").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return S.state(spark, f"{path}/state")


def j9(spark: SparkSession, sf: str) -> DataFrame:
    path, c = scratch(spark, "j9"), table(spark, sf, "changes")
    end = F.lit("2100-01-01").cast("timestamp")
    changed = c.select("change_id", F.col("changed_at").cast("timestamp").alias("changed_at"))
    seen = c.where("available_at is not null").select(F.col("change_id").alias("seen_id"), F.col("available_at").cast("timestamp").alias("available_at"))
    for df, name, key, at in ((changed, "c", "change_id", "changed_at"), (seen, "a", "seen_id", "available_at")):
        df.write.parquet(f"{path}/{name}")
        df.limit(1).withColumn(key, F.lit(-1).cast("long")).withColumn(at, end).write.mode("append").parquet(f"{path}/{name}")
    plan = S.freshness(spark.readStream.schema(changed.schema).parquet(f"{path}/c"), spark.readStream.schema(seen.schema).parquet(f"{path}/a"))
    return S.drain(plan, f"{path}/run").where("change_id >= 0").select("change_id", "lag_seconds")


def j10(spark: SparkSession, sf: str) -> DataFrame:
    out = S.drain(S.sessions(_stream(spark, sf, "events", "user_id")), scratch(spark, "j10")).where("user_id >= 0")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


QUERIES = {
    "a1_read_markdown_tree": a1, "a2_parse_front_matter": a2, "a2_rejected_front_matter": a2_rejected, "a3_read_entities": a3, "a4_read_product_meta": a4, "a5_write_index": a5, "a6_write_splits": a6, "a7_dataset_manifest": a7, "a7_changed_files": a7_changed,
    "a8_make_batch_requests": a8, "a9_apply_batch_responses": a9, "a9_missing_responses": a9_missing, "l1_tabular_features": l1, "l2_mean_baseline": l2, "l3_linear_baseline": l3, "l4_bag_of_words_regression": l4, "l5_hashed_features": l5,
    "l6_tree_baselines": l6, "j6_windowed_metrics": j6, "j7_sustained_alert": j7, "j8_cdc_stream_apply": j8, "j9_freshness_stream": j9, "j10_session_activity": j10,
}

_BUCKETS = "b as (select time_bucket(interval 5 minutes, ts, timestamp '1970-01-01') w, tenant, avg((status <> 'ok')::int) rate from {request_log} group by all)"
ORACLES = {
    "a1_read_markdown_tree": "select doc_id, source doc_type, cast(length(coalesce(text, '')) as integer) n_chars, md5(coalesce(text, '')) digest from documents",
    "a2_parse_front_matter": "select doc_id file_no, doc_id, lang, md5(text) digest from documents where doc_id % 13 <> 0 and doc_id % 17 <> 0",
    "a2_rejected_front_matter": "select doc_id file_no, case when doc_id % 17 = 0 then 'no front matter' else 'hash differs' end reason from documents where doc_id % 17 = 0 or doc_id % 13 = 0",
    "a3_read_entities": "select o_orderstatus, count(*) n, cast(sum(o_custkey) as bigint) key_sum from orders group by 1",
    "a4_read_product_meta": "select string_split(p_type, ' ')[1] category, count(*) n, round(sum(p_retailprice), 2) total from part group by 1",
    "a5_write_index": "select label, count(*) n, cast(sum(vec_id) as bigint) id_sum from embeddings group by label",
    "a6_write_splits": "with r as (select p_partkey, row_number() over (order by md5('parts' || p_partkey), p_partkey) r, count(*) over () n from part) select case when r <= floor(n * 0.8::double) then 'train' else 'test' end split, count(*) n, cast(sum(p_partkey) as bigint) key_sum from r group by 1",
    "a7_dataset_manifest": """with l as (select source area, lpad(cast(doc_id as varchar), 12, '0') path, sha256(coalesce(text, '')) sha from documents), n2 as (select area, sha256(path)[1:4] node, count(*) n, sha256(string_agg(path || chr(9) || sha, chr(10) order by path || chr(9) || sha)) digest from l group by all),
        n1 as (select area, node[1:2] node, sum(n) n, sha256(string_agg(node || chr(9) || digest, chr(10) order by node)) digest from n2 group by all), a as (select area, cast(sum(n) as bigint) n_files, sha256(string_agg(node || chr(9) || digest, chr(10) order by node)) digest from n1 group by area)
        select * from a union all select 'all', cast(sum(n_files) as bigint), sha256(string_agg(area || chr(9) || digest, chr(10) order by area)) from a""",
    "a7_changed_files": """with d as (select source area, lpad(cast(doc_id as varchar), 12, '0') path, doc_id % 50 k from documents)
        select area, path, 'changed' "change" from d where k = 3 union all select area, path, 'removed' from d where k = 7 union all select area, path || '-2', 'added' from d where k = 9""",
    "a8_make_batch_requests": "select doc_id // 1000 batch_no, doc_id, 'model-1' model, 'Summarise.' system, md5(coalesce(text, '')) digest from documents",
    "a9_apply_batch_responses": "select doc_id, source, case when doc_id % 11 = 0 then null when doc_id % 5 = 0 then md5('new ' || coalesce(text, '')) else md5('old ' || coalesce(text, '')) end summary from documents",
    "a9_missing_responses": "select doc_id from documents where doc_id % 11 = 0",
    "l1_tabular_features": "select p_partkey, p_size::double weight, (p_size = 0)::integer weight_unknown, cast(length(p_name) as integer) text_length from part",
    "l2_mean_baseline": """with e as (select p_retailprice y, (select avg(p_retailprice) from part) g from part), d as (select *, abs(y - g) e from e)
        select count(*) n, round(avg(e), 4) mean_error, round(avg((y - g) * (y - g)), 3) mse, round(1 - avg((y - g) * (y - g)) / var_pop(y), 6) + 0.0 r2, round(avg((e < 40 or e / abs(y) < 0.2)::int), 6) share_green, 'mean' model from d""",
    "l5_hashed_features": "with s as (select avg(ln(1 + n_chars)) m, stddev_pop(ln(1 + n_chars)) d from documents) select doc_id, round((ln(1 + n_chars) - m) / d, 6) scaled, round(n_chars::double, 3) back from documents, s",
    "j6_windowed_metrics": "select time_bucket(interval 5 minutes, ts, timestamp '1970-01-01') window_start, tenant, count(*) n, round(count(*) / 5.0::double, 6) per_minute, round(avg(latency_ms), 4) mean_latency, round(quantile_disc(latency_ms, 0.95), 6) p95, round(quantile_disc(latency_ms, 0.99), 6) p99, round(avg((status <> 'ok')::int), 6) error_rate, round(avg((status = 'timeout')::int), 6) timeout_rate, round(avg((status = 'ok' and num_results = 0)::int), 6) empty_rate from {request_log} group by all",
    "j7_sustained_alert": f"""with {_BUCKETS}, s as (select w - interval 5 minutes * i ws, tenant, rate from b, (select unnest([0, 1, 2]) i)) select ws window_start, tenant, round(min(rate), 6) lowest, 'CRITICAL' severity, case tenant when 0 then 'search team' when 1 then 'billing team' when 3 then 'search team' else 'platform team' end as owner,
        case tenant when 0 then 'check the gateway' when 1 then 'check quotas' when 3 then 'check the index' else 'start with the dashboard' end runbook from s group by all having count(*) = 3 and min(rate) > 0.3""",
    "j8_cdc_stream_apply": "select object_id, max(sequence) sequence, max_by(after_value, sequence) as value from {cdc_events} group by object_id having max_by(operation, sequence) <> 'delete'",
    "j9_freshness_stream": "select change_id, case when available_at <= changed_at + interval 90 days then date_diff('second', changed_at, available_at) end lag_seconds from {changes}",
    "j10_session_activity": """with g as (select user_id, ts, coalesce(ts - lag(ts) over w >= interval 30 minutes, true) n from events window w as (partition by user_id order by ts)), s as (select *, sum(n::int) over (partition by user_id order by ts rows unbounded preceding) k from g)
        select user_id, min(ts) session_start, max(ts) + interval 30 minutes session_end, count(*) n_events from s group by user_id, k""",
}
