"""Queries on chunks and web pages, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions import kernels, udtf
from ragmill.functions.text import fixed_chunks
from ragmill.operators import chunk as K
from ragmill.operators import web
from ragmill.sources.tables import small_batches, table


def e1(spark: SparkSession, sf: str) -> DataFrame:
    return K.chunked(table(spark, sf, "documents").select("doc_id", fixed_chunks(F.col("text")).alias("c")), F.col("c")).select("doc_id", "chunk_index", "chunk")


def e2(spark: SparkSession, sf: str) -> DataFrame:
    s = K.sections(table(spark, sf, "markdown_docs"), "body")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("text")).alias("n_chars"), F.min("heading").alias("first_heading"))


def e3(spark: SparkSession, sf: str) -> DataFrame:
    c = K.section_chunks(table(spark, sf, "markdown_docs"), "body")
    return c.groupBy("doc_id", "section_no").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))


def e4(spark: SparkSession, sf: str) -> DataFrame:
    return K.chunked(small_batches(table(spark, sf, "documents")).select("doc_id", kernels.recursive_chunks(1000, 200)("text").alias("c")), F.col("c")).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def e5(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "corpus").withColumn("version_id", F.concat_ws("-v", "document_id", F.col("version").cast("string")))
    c = K.chunked(d.select("version_id", "tenant_id", "label", "access_group", "status", fixed_chunks(F.col("text")).alias("c")), F.col("c"))
    return K.records(c.withColumnRenamed("chunk_index", "at"), "version_id", ["at"], ["tenant_id", "label", "access_group", "status"])


def e6(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    content = K.page_content(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.substring("text", 1, 40), F.col("text"))
    return d.select("doc_id", F.md5(content).alias("digest"), K.chunk_hint(F.col("text")).cast("long").alias("hint"))


def e7(spark: SparkSession, sf: str) -> DataFrame:
    return K.profile(e1(spark, sf), "doc_id")


def e7_change(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    new = K.chunked(d.select("doc_id", fixed_chunks(F.col("text"), 1000, 100).alias("c")), F.col("c"))
    return K.profile_change(e1(spark, sf), new, "doc_id")


def e3_sql(spark: SparkSession, sf: str) -> DataFrame:
    """e3 as SQL: a table function in a lateral join."""
    udtf.register(spark)
    return spark.sql("select doc_id, section_no, count(*) as n_chunks, max(length(chunk)) as longest from {docs}, lateral section_chunks(body, 1200, 200) group by doc_id, section_no", docs=table(spark, sf, "markdown_docs"))


def e4_sql(spark: SparkSession, sf: str) -> DataFrame:
    """e4 as SQL."""
    udtf.register(spark)
    return spark.sql("select doc_id, chunk_index, length(chunk) as n_chars, md5(chunk) as digest from {docs}, lateral recursive_chunks(text, 1000, 200)", docs=table(spark, sf, "documents"))


def d1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", web.text(F.col("html")).alias("text"))


def d2(spark: SparkSession, sf: str) -> DataFrame:
    return web.links(table(spark, sf, "pages"))


def d2_absolute(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.posexplode(kernels.absolute_links("url", "html")).alias("link_no", "link"))


def d3(spark: SparkSession, sf: str) -> DataFrame:
    """Pages link by a word of another page's path: the first page (smallest id) whose address holds it as host label."""
    pages = table(spark, sf, "pages")
    texts = pages.select("page_id", F.regexp_replace("html", r"<[^>]*>", " ").alias("text"))
    label = F.regexp_extract("url", r"^https?://(?:m\.)?([^.]+)\.", 1)
    target = pages.groupBy(F.lower(label).alias("word")).agg(F.min("page_id").alias("target_id"))
    out = web.links(pages).where(~F.col("href").rlike(web.NOT_CONTENT)).withColumn("word", F.lower(F.regexp_replace("href", "^/", "")))
    return web.bundles(texts, out.join(target, "word").select("page_id", "link_no", "target_id")).select("page_id", F.length("bundle").alias("n_chars"), F.md5("bundle").alias("digest"))


QUERIES = {
    "e1_fixed_chunks": e1, "e2_markdown_sections": e2, "e3_section_chunks": e3, "e4_recursive_chunks": e4, "e3_section_chunks_in_sql": e3_sql, "e4_recursive_chunks_in_sql": e4_sql, "e5_chunk_records": e5, "e6_chunk_page_content": e6,
    "e7_chunk_profile": e7, "e7_chunk_change": e7_change, "d1_page_text": d1, "d2_page_links": d2, "d2_absolute_links": d2_absolute, "d3_site_bundle": d3,
}

def _cut(size: int, overlap: int, text: str = "text") -> str:
    step = size - overlap
    return f"unnest(case when length({text}) = 0 then [] else range(0, greatest(1, ceil((length({text}) - {overlap}) / {step}.0))::bigint) end)"


_SECTIONS = r"""with s as (select doc_id, string_split(body, chr(10)) l from {markdown_docs}), x as (select doc_id, unnest(range(0, len(l))) i, l from s),
    y as (select doc_id, i, l[i + 1] line, regexp_matches(l[i + 1], '^#{1,6}[ \t]') h from x),
    z as (select *, sum(h::int) over (partition by doc_id order by i) sec from y),
    g as (select doc_id, sec, max(case when h then trim(regexp_replace(line, '^#{1,6}[ \t]+', '')) end) head, regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (not h), ''), '^\s+|\s+$', '', 'g') text,
      count(*) n, bool_or(h) h from z group by doc_id, sec),
    last as (select doc_id, max(sec) top from g group by doc_id)
    """
_KEPT = "select g.doc_id, g.sec, coalesce(head, 'Document') heading, text from g join last using (doc_id) where (h and (n > 1 or sec < top)) or (not h and text <> '')"
ORACLES = {
    "e1_fixed_chunks": f"select doc_id, cast(i as integer) chunk_index, substr(text, i * 1000 + 1, 1200) chunk from (select doc_id, text, {_cut(1200, 200)} i from documents)",
    "e2_markdown_sections": _SECTIONS + f"select doc_id, count(*) n_sections, cast(sum(length(text)) as bigint) n_chars, min(heading) first_heading from ({_KEPT}) group by doc_id",
    "e3_section_chunks": _SECTIONS + f""", k as (select doc_id, sec, text, row_number() over (partition by doc_id order by sec) from ({_KEPT})),
        c as (select doc_id, sec, case when length(text) <= 1200 then text else substr(text, i * 1000 + 1, 1200) end chunk from (select *, unnest(case when length(text) <= 1200 then [0] else range(0, ceil((length(text) - 200) / 1000.0)::bigint) end) i from k)),
        o as (select doc_id, min(sec) lowest from g group by doc_id)
        select c.doc_id, cast(c.sec - lowest as integer) section_no, count(*) n_chunks, cast(max(length(chunk)) as integer) longest from c join o using (doc_id) group by all""",
    "e5_chunk_records": f"""with c as (select *, concat(document_id, '-v', version) version_id, {_cut(1200, 200)} i from {{corpus}}), k as (select *, substr(text, i * 1000 + 1, 1200) chunk from c)
        select concat(version_id, '-', i) chunk_id, version_id, cast(i as integer) chunk_index, cast(count(*) over (partition by version_id) as integer) chunk_count, sha256(chunk) chunk_hash,
        cast(length(chunk) as integer) n_chars, tenant_id, label, access_group, status from k""",
    "e6_chunk_page_content": "select doc_id, md5('Document ' || doc_id || chr(10) || chr(10) || substr(text, 1, 40) || chr(10) || chr(10) || text) digest, length(text) // 100 + 1 hint from documents",
    "e7_chunk_profile": f"""with c as (select doc_id, substr(text, i * 1000 + 1, 1200) chunk from (select doc_id, text, {_cut(1200, 200)} i from documents)),
        p as (select doc_id, count(*) n, sum(length(chunk)) c from c group by doc_id)
        select count(*) n_docs, cast(sum(n) as bigint) n_chunks, round(avg(n), 6) chunks_per_doc, max(n) most_chunks, round(sum(c) / sum(n), 6) mean_chars from p""",
    "e7_chunk_change": f"""with a as (select doc_id, count(*) n from (select doc_id, {_cut(1200, 200)} from documents) group by doc_id), b as (select doc_id, count(*) n from (select doc_id, {_cut(1000, 100)} from documents) group by doc_id)
        select coalesce(b.n, 0) - coalesce(a.n, 0) change, count(*) n_docs from a full join b using (doc_id) group by all""",
    "d2_page_links": r"""with f as (select page_id, list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]+"|''[^'']+''|[^\s"''>]+)', 1), lambda x: case when x[1] in ('"', chr(39)) then x[2:-2] else x end) l from pages)
        select page_id, cast(i as integer) link_no, l[i + 1] href from (select page_id, l, unnest(range(0, len(l))) i from f)""",
    "d2_absolute_links": r"""with f as (select page_id, regexp_extract(url, '^https?://[^/?#]+') root, list_transform(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*("[^"]+"|''[^'']+''|[^\s"''>]+)', 1), lambda x: case when x[1] in ('"', chr(39)) then x[2:-2] else x end) l from pages),
        g as (select page_id, root, l, unnest(range(0, len(l))) i from f) select page_id, cast(i as integer) link_no, case when l[i + 1][1] = '/' then root || l[i + 1] else l[i + 1] end link from g""",
    "d3_site_bundle": """with t as (select page_id, substr(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1, 5000) text from pages),
        tg as (select lower(regexp_extract(url, '^https?://(?:m\\.)?([^.]+)\\.', 1)) word, min(page_id) target_id from pages group by 1),
        l as (select page_id, i link_no, l[i + 1] href from (select page_id, l, unnest(range(0, len(l))) i from (select page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]+)"', 1) l from pages))),
        m as (select l.page_id, string_agg(t.text, chr(10) order by link_no, t.text) more from l join tg on lower(regexp_replace(href, '^/', '')) = tg.word join t on t.page_id = tg.target_id
          where not regexp_matches(href, '(?i)(mailto:|privacy|terms)') group by l.page_id)
        select page_id, cast(length(b) as integer) n_chars, md5(b) digest from (select t.page_id, substr(case when more is null then text else text || chr(10) || more end, 1, 5000) b from t left join m using (page_id))""",
}
ORACLES["e3_section_chunks_in_sql"] = ORACLES["e3_section_chunks"]
