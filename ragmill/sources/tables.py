"""The given tables and the views derived from them, the latter as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "corpus": """SELECT doc_id, text, lang, source AS doc_type, concat('T-', CAST(doc_id % 5 AS STRING)) AS tenant_id,
        CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END AS label,
        concat('G-', CAST(doc_id % 6 AS STRING)) AS access_group, concat('D-', CAST(CAST(floor(doc_id / 2.0) AS BIGINT) AS STRING)) AS document_id,
        CAST(doc_id % 2 + 1 AS INT) AS version,
        CASE WHEN doc_id % 17 = 0 THEN 'deleted' WHEN doc_id % 2 = 0 THEN 'superseded' ELSE 'current' END AS status FROM {documents}""",
    "markdown_docs": """SELECT doc_id, concat('# Doc ', CAST(doc_id AS STRING), chr(10),
        replace(text, chr(10), concat(chr(10), chr(10), '## Part', chr(10)))) AS body FROM {documents}""",
    "principals": """SELECT c_custkey AS principal_id,
        CASE WHEN c_custkey % 10 = 0 THEN 'service_account' WHEN c_custkey % 10 < 4 THEN 'customer_user' ELSE 'employee' END AS principal_type,
        concat('T-', CAST(c_custkey % 5 AS STRING)) AS home_tenant_id, CASE WHEN c_custkey % 29 = 0 THEN 'disabled' ELSE 'active' END AS principal_status,
        CASE WHEN c_custkey = 0 THEN NULL ELSE CAST(floor((c_custkey - 1) / 4.0) AS BIGINT) END AS manager_id, c_mktsegment AS department FROM {customer}""",
    "memberships": """SELECT c_custkey AS principal_id, concat('G-', CAST(c_nationkey % 6 AS STRING)) AS group_id, CAST('2024-01-01' AS DATE) AS valid_from,
        CASE WHEN c_custkey % 8 = 0 THEN CAST('2024-06-30' AS DATE) ELSE NULL END AS valid_to FROM {customer}""",
    "people": """SELECT c_custkey AS principal_id, CASE WHEN c_custkey % 10 = 0 THEN 'service_account' WHEN c_custkey % 10 < 4 THEN 'customer_user' ELSE 'employee' END AS principal_type,
        CASE WHEN c_custkey % 29 = 0 THEN 'disabled' ELSE 'active' END AS principal_status,
        CASE WHEN c_custkey % 10 BETWEEN 1 AND 3 THEN concat('T-', CAST(c_custkey % 4 + 1 AS STRING)) ELSE 'T-0' END AS home_tenant_id,
        CASE WHEN c_custkey % 10 > 3 THEN concat('E-', CAST(c_custkey AS STRING)) END AS employee_id,
        CASE WHEN c_custkey % 10 = 0 THEN concat('T-0 T-', CAST(CAST(floor(c_custkey / 10.0) AS BIGINT) % 5 AS STRING)) ELSE '' END AS scopes FROM {customer}""",
    "tenants": """SELECT DISTINCT concat('T-', CAST(doc_id % 5 AS STRING)) AS tenant_id, CASE WHEN doc_id % 5 = 4 THEN 'suspended' ELSE 'active' END AS tenant_status FROM {documents}""",
    "group_memberships": """SELECT concat('M-', CAST(c_custkey AS STRING)) AS membership_id, c_custkey AS principal_id, concat('G-', CAST(c_nationkey % 6 AS STRING)) AS group_id, CAST('2024-01-01' AS DATE) AS valid_from,
        CASE WHEN c_custkey % 8 = 0 THEN CAST('2024-06-30' AS DATE) ELSE NULL END AS valid_to FROM {customer}
        UNION ALL SELECT concat('A-', CAST(c_custkey AS STRING)), c_custkey, concat('G-', CAST(c_custkey % 6 AS STRING)), CAST('2024-03-01' AS DATE),
        CASE WHEN c_custkey % 5 = 0 THEN CAST('2024-05-31' AS DATE) ELSE NULL END FROM {customer} WHERE c_custkey % 3 <> 0""",
    "relation_edges": """SELECT concat('R-', CAST(c_custkey AS STRING)) AS edge_id, 'reports_to' AS relation, concat('E-', CAST(c_custkey AS STRING)) AS from_id,
        concat('E-', CAST(CAST(floor((c_custkey - 1) / 4.0) AS BIGINT) AS STRING)) AS to_id, CAST('2024-01-01' AS DATE) AS valid_from,
        CASE WHEN c_custkey % 11 = 0 THEN CAST('2024-05-31' AS DATE) ELSE NULL END AS valid_to FROM {customer} WHERE c_custkey > 0
        UNION ALL SELECT concat('T-', CAST(c_custkey AS STRING)), 'account_team_member_of', concat('E-', CAST(c_custkey AS STRING)), concat('C-', CAST(c_custkey % (SELECT CAST(floor(count(*) / 10.0) AS BIGINT) + 1 FROM {customer}) AS STRING)),
        CAST('2024-01-01' AS DATE), CASE WHEN c_custkey % 13 = 0 THEN CAST('2024-05-31' AS DATE) ELSE NULL END FROM {customer}""",
    "doc_grants": """SELECT doc_id, 'group' AS kind, 0 AS position, CAST(NULL AS STRING) AS relation, concat('G-', CAST(doc_id % 6 AS STRING)) AS value FROM {documents}
        UNION ALL SELECT doc_id, 'group', 1, NULL, concat('G-', CAST(doc_id * 7 % 5 AS STRING)) FROM {documents} WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'relation', 0, 'self', concat('E-', CAST(doc_id * 7 % (SELECT count(*) FROM {customer}) AS STRING)) FROM {documents}
        UNION ALL SELECT doc_id, 'relation', 1, 'manager_of', concat('E-', CAST(doc_id * 7 % (SELECT count(*) FROM {customer}) AS STRING)) FROM {documents}
        UNION ALL SELECT doc_id, 'relation', 2, 'account_team_of', concat('C-', CAST(doc_id % (SELECT CAST(floor(count(*) / 10.0) AS BIGINT) + 1 FROM {customer}) AS STRING)) FROM {documents}
        UNION ALL SELECT doc_id, 'principal', 0, NULL, CAST(doc_id * 5 % (SELECT count(*) FROM {customer}) AS STRING) FROM {documents}""",
    "cdc_events": """SELECT concat('EVT-', CAST(o_orderkey AS STRING)) AS event_id, o_orderkey AS sequence, o_custkey AS object_id,
        CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'upsert' END AS operation, o_totalprice AS after_value,
        CASE WHEN o_orderkey % 31 = 0 THEN (o_orderkey + 400) * 4 + 1 ELSE o_orderkey * 4 END AS delivery_pos FROM {orders}
        UNION ALL SELECT concat('EVT-', CAST(o_orderkey AS STRING)), o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'upsert' END,
        o_totalprice, (o_orderkey + 450) * 4 + 2 FROM {orders} WHERE o_orderkey % 97 = 0""",
    "source_records": """SELECT doc_id AS source_id, text AS body, CASE WHEN doc_id % 7 = 0 THEN 'v2' ELSE 'v1' END AS content_version,
        CASE WHEN doc_id % 5 = 0 THEN 'internal' ELSE 'public' END AS access_group, doc_id % 17 = 0 AS deleted FROM {documents}""",
    "vector_index": """SELECT doc_id AS source_id, 'v1' AS content_version, CASE WHEN doc_id % 10 = 0 THEN 'internal' ELSE 'public' END AS access_group,
        CASE WHEN doc_id % 34 = 0 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN doc_id % 41 = 0 THEN 'm0' ELSE 'm1' END AS model
        FROM {documents} WHERE doc_id % 13 <> 0
        UNION ALL SELECT doc_id + 1000000, 'v1', 'public', 'active', 'm1' FROM {documents} WHERE doc_id % 19 = 0""",
    "request_log": """SELECT event_id, ts, CAST(user_id % 7 AS INT) AS tenant, value AS latency_ms,
        CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'ok' END AS status, CAST(event_id % 9 AS INT) AS num_results FROM {events}""",
    "qrels": """SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM {embeddings} q JOIN {embeddings} d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0""",
    "changes": """SELECT o.o_orderkey AS change_id, o.o_orderpriority AS change_class, o.o_orderdate AS changed_at, min(l.l_shipdate) AS available_at
        FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate GROUP BY o.o_orderkey, o.o_orderpriority, o.o_orderdate""",
    "fact_text": """SELECT o_orderkey, concat('Order ORD-', CAST(o_orderkey AS STRING), ' for CUST-',
        CAST(CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS STRING), ' totals $', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING),
        ' dated ', CAST(CAST(o_orderdate AS DATE) AS STRING), '.') AS body FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived view."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """Put before an oracle's SQL the views that it names as {view}."""
    used = dict.fromkeys(re.findall(r"\{(\w+)\}", sql))
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    body = plain(sql).strip()
    ctes = ", ".join(f"{v} as ({plain(VIEWS[v])})" for v in used if v in VIEWS)
    if not ctes:
        return body
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") and not body.lower().startswith("with recursive") else f"with {ctes} {body}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Most rows of a side that is broadcast; sides hold a few short columns, so this is some 20 MB.
BROADCAST_ROWS = 200_000


#: Removes a query's shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(writer: DataFrameWriter, spark: SparkSession, path: str) -> None:
    """Parquet at path. What was shuffled for it goes from the disks at once."""
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_FREE, before)


#: Rows and bytes of text in a batch between the JVM and Python: whole texts may be long, so fewer than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session hands rows to Python in batches of BATCH_ROWS rows and about BATCH_BYTES bytes at most."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on beside the next stage's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, however often it is used."""
    path = scratch(df.sparkSession, name)
    written(df.write, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, name: str) -> DataFrame:
    """A side of a join, kept, and broadcast if it has BROADCAST_ROWS rows at most; beyond, the join shuffles."""
    side = kept(df, name)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores, if it comes in fewer partitions than there are cores: a small file is one row group, and all work on it would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
