"""Queries on validation and access, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators import access as A
from ragmill.operators import govern as H
from ragmill.operators.curate import seeded_rank
from ragmill.plans.retrieval import _TOP, probes, vectors
from ragmill.plans.retrieval import f3 as exact_topk
from ragmill.sources.tables import kept, table

DAY = "2024-07-01"
_RULES = [("department", "BUILDING", "G-0"), ("department", "MACHINERY", "G-1"), ("department", "AUTOMOBILE", "G-2"), ("type", "employee", "G-3")]
_DEFAULTS = [(f"src{i}", H.LABELS[i % 4], f"G-{i % 6}") for i in range(20)]
_GROUPS = [(f"G-{i}", H.LABELS[min(3, i)]) for i in range(6)]


def h1(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"lang": F.col("lang").isin("en", "de", "fr"), "length": F.col("n_chars") == F.length("text"), "source": F.col("source").rlike(r"^src\d+$"), "size": F.col("n_chars").between(50, 20000)}
    _, bad = H.validate(table(spark, sf, "documents"), rules)
    return bad.select(F.get_json_object("payload", "$.doc_id").cast("long").alias("doc_id"), F.array_join("errors", ",").alias("errors"))


def h1_unknown(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.explode(H.unknown_fields(F.col("props"), ["known"])).alias("field"))
    return e.groupBy("field").agg(F.count("*").alias("n"))


def h2(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"source": ["doc_id", "text", "doc_type", "document_id"], "evaluation": ["lang", "version"], "governance": ["tenant_id", "label", "access_group", "status"]}
    return H.field_coverage(table(spark, sf, "corpus"), groups, {"governance": 4, "evaluation": 4})


_DICTIONARY = [("doc_id", "filterable", "key"), ("text", "returnable", None), ("lang", "filterable", "equality"), ("source", "secret", None), ("region", "returnable", "equality"), ("k", "internal", "equality")]


def h3(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that rows hold: columns of documents with any value, and keys of the events' payloads."""
    docs = table(spark, sf, "documents")
    held = docs.agg(*(F.count(c).alias(c) for c in docs.columns)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in docs.columns)))).where("n > 0").select("field")
    keys = table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("field")).distinct()
    return H.audit_dictionary(held.unionByName(keys).distinct(), spark.createDataFrame(_DICTIONARY, "field string, classification string, filter_role string"))


def h4(spark: SparkSession, sf: str) -> DataFrame:
    return H.relevance_filter(table(spark, sf, "corpus"), lang="en", doc_type=None).select("doc_id", "lang", "doc_type")


def h5(spark: SparkSession, sf: str) -> DataFrame:
    return H.governance_filter(table(spark, sf, "corpus"), "G-1", ["public", "internal"]).select("doc_id", "access_group", "label")


def _pairs_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that hold every version of every document and every principal: both sides are numbered, and numbers meet modulo the smaller count."""
    versions = table(spark, sf, "corpus").select("doc_id", "document_id")
    documents = seeded_rank(versions.select("document_id").distinct(), "document_id", "pairs")
    people = seeded_rank(table(spark, sf, "principals").select("principal_id"), "principal_id", "pairs")
    classes = F.lit(max(1, min(versions.select("document_id").distinct().count(), people.count())))
    met = documents.select("document_id", F.pmod("rank", classes).alias("k")).join(people.select("principal_id", F.pmod("rank", classes).alias("k")), "k")
    return met.join(versions, "document_id").select("principal_id", "doc_id")


def _people(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "people").withColumn("service_scopes", F.filter(F.split("scopes", " "), lambda x: x != "")).drop("scopes")


def _groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_GROUPS, "group_id string, max_label string").withColumn("group_status", F.when(F.col("group_id") == "G-4", "retired").otherwise("active"))


def _held(spark: SparkSession, sf: str) -> DataFrame:
    day = F.lit(DAY).cast("date")
    return kept(A.holdings(_people(spark, sf), table(spark, sf, "group_memberships"), _groups(spark), A.relation_paths(table(spark, sf, "relation_edges"), day), day), "holdings")


def _decided(spark: SparkSession, sf: str, pairs: DataFrame, held: DataFrame | None = None) -> DataFrame:
    held = _held(spark, sf) if held is None else held
    return A.access(pairs, _people(spark, sf), table(spark, sf, "corpus"), table(spark, sf, "tenants"), table(spark, sf, "doc_grants"), held, "T-0")


def _own_pairs(spark: SparkSession, sf: str, held: DataFrame) -> DataFrame:
    """The pairs of all, and each principal with every version of the documents that name it or somebody to whom it stands in a relation."""
    single = table(spark, sf, "doc_grants").where("kind <> 'group'").withColumn("relation", F.coalesce("relation", F.lit("")))
    named = single.join(held.where("kind <> 'group'").withColumn("relation", F.coalesce("relation", F.lit(""))), ["kind", "relation", "value"]).select("principal_id", "doc_id")
    versions = table(spark, sf, "corpus").select("doc_id", "document_id")
    whole = named.join(versions, "doc_id").select("principal_id", "document_id").distinct().join(versions, "document_id").select("principal_id", "doc_id")
    return _pairs_of_all(spark, sf).unionByName(whole).distinct()


def h6(spark: SparkSession, sf: str) -> DataFrame:
    held = _held(spark, sf)
    return _decided(spark, sf, _own_pairs(spark, sf, held), held)


def h7(spark: SparkSession, sf: str) -> DataFrame:
    """Who stands in which relation to whom on the day, with the edges that show it."""
    held = _held(spark, sf).where("kind = 'relation'")
    return held.select("principal_id", "relation", F.col("value").alias("subject"), F.array_join("via_edge_ids", ",").alias("path"))


def h8(spark: SparkSession, sf: str) -> DataFrame:
    return H.with_history_rule(h6(spark, sf), table(spark, sf, "corpus"))


def h9(spark: SparkSession, sf: str) -> DataFrame:
    return H.wanted_groups(table(spark, sf, "principals"), spark.createDataFrame(_RULES, "kind string, value string, group_id string"), "customer_user")


def h10(spark: SparkSession, sf: str) -> DataFrame:
    return H.sync_memberships(h9(spark, sf), table(spark, sf, "memberships"), F.lit(DAY).cast("date"))


def h11(spark: SparkSession, sf: str) -> DataFrame:
    defaults, groups = spark.createDataFrame(_DEFAULTS, "doc_type string, default_label string, default_group string"), spark.createDataFrame(_GROUPS, "access_group string, max_label string")
    return H.label_conformance(table(spark, sf, "corpus"), defaults.drop("default_group"), groups)


def _asking(c) -> Column:
    """The principal that asks with a query vector: all types take part."""
    return c + F.floor(c / 50).cast("long") % 10


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Results of vector search for the asking principals as if nothing were filtered; the document with the vector's number is found."""
    return exact_topk(spark, sf).select(_asking(F.col("query_id")).alias("principal_id"), "doc_id", "rank", "score")


def h12(spark: SparkSession, sf: str) -> DataFrame:
    """The best three current documents of all that the asking principal may read."""
    people, corpus = _people(spark, sf), table(spark, sf, "corpus")
    queries = probes(spark, sf).withColumn("id", _asking(F.col("id")))
    askers = people.join(queries.select(F.col("id").alias("principal_id")), "principal_id", "left_semi")
    now = corpus.where("status = 'current'")
    entitled = A.entitlements(askers, now, table(spark, sf, "tenants"), table(spark, sf, "doc_grants").join(now.select("doc_id"), "doc_id", "left_semi"), _held(spark, sf), "T-0")
    return A.authorized_topk(vectors(spark, sf), queries, entitled, 3).withColumnRenamed("query_id", "principal_id")


def h13(spark: SparkSession, sf: str) -> DataFrame:
    found = _answers(spark, sf).select("principal_id", "doc_id")
    return H.leaks(found, _decided(spark, sf, found))


def h14(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of each asker before and after what may not be read is taken out."""
    found = kept(_answers(spark, sf).select("principal_id", "doc_id"), "answers")
    ok = _decided(spark, sf, found).where("decision = 'allow'").select("principal_id", "doc_id")
    return H.filter_collapse(found, ok, "principal_id", 0.5)


def h15(spark: SparkSession, sf: str) -> DataFrame:
    return H.audit_rows(h6(spark, sf), table(spark, sf, "corpus"), F.concat(F.lit("query of "), F.col("principal_id").cast("string")))


def h16(spark: SparkSession, sf: str) -> DataFrame:
    """Where decisions with the history rule differ from those without."""
    decided = kept(h6(spark, sf), "decided")
    return H.compare_matrices(decided, H.with_history_rule(decided, table(spark, sf, "corpus")))


def h17(spark: SparkSession, sf: str) -> DataFrame:
    defaults = spark.createDataFrame(_DEFAULTS, "doc_type string, default_label string, default_group string")
    docs = table(spark, sf, "corpus").withColumn("label", F.when(F.col("doc_id") % 3 == 0, F.col("label")))
    return H.derive_grants(docs, defaults).select("doc_id", "label", F.array_join("groups", ",").alias("groups"))


def h18(spark: SparkSession, sf: str) -> DataFrame:
    return H.safe_projection(table(spark, sf, "documents"), {"doc_id": "filterable", "lang": "returnable", "source": "internal", "n_chars": "returnable"})


def i13(spark: SparkSession, sf: str) -> DataFrame:
    """Results by label of the document and decision, relevant (same vector label) or not."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    a = exact_topk(spark, sf).join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("lq")), "query_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("ld")), "doc_id")
    a = a.withColumn("principal_id", _asking(F.col("query_id")))
    j = a.join(_decided(spark, sf, a), ["principal_id", "doc_id"]).join(table(spark, sf, "corpus").select("doc_id", F.col("label").alias("doc_label")), "doc_id")
    same = F.col("lq") == F.col("ld")
    return j.groupBy("doc_label").agg(F.count_if(same & (F.col("decision") == "allow")).alias("relevant_allowed"), F.count_if(same & (F.col("decision") == "deny")).alias("relevant_forbidden"), F.count_if(~same).alias("irrelevant"))


QUERIES = {
    "h1_validate_records": h1, "h1_unknown_fields": h1_unknown, "h2_field_coverage": h2, "h3_dictionary_audit": h3, "h4_relevance_filter": h4, "h5_governance_filter": h5, "h6_access_decisions": h6,
    "h7_relation_grants": h7, "h8_history_rule": h8, "h9_group_membership": h9, "h10_membership_sync": h10, "h11_label_conformance": h11, "h12_authorized_topk": h12, "h13_leak_audit": h13,
    "h14_filter_collapse": h14, "h15_audit_log": h15, "h16_matrix_compare": h16, "h17_derive_grants": h17, "h18_safe_projection": h18, "i13_permission_outcomes": i13,
}


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join("null" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + ")"


_RANK = "list_position(['public', 'internal', 'confidential', 'restricted'], {c})"
#: What is held on the day, by kind.
_HOLD = f"""{_values('gl', 'group_id, ml', [g for g in _GROUPS if g[0] != 'G-4'])},
    edge as (select * from {{relation_edges}} where date '{DAY}' >= valid_from and (valid_to is null or date '{DAY}' <= valid_to)),
    up as (select from_id, to_id, edge_id from edge where relation = 'reports_to'),
    led as (select from_id subject, to_id employee_id, 1 n, edge_id path from up union all select a.from_id, b.to_id, 2, a.edge_id || ',' || b.edge_id from up a join up b on b.from_id = a.to_id),
    paths as (select employee_id, 'manager_of' relation, subject, arg_min(path, struct_pack(n := n, p := path)) path from led where subject <> employee_id group by all
      union all select from_id, 'account_team_of', to_id, min(edge_id) from edge where relation = 'account_team_member_of' group by all),
    held as (select principal_id, 'group' kind, '' relation, group_id val, {_RANK.format(c='min(ml)')} most, min(membership_id) member, '' path from {{group_memberships}} join gl using (group_id) where date '{DAY}' >= valid_from and (valid_to is null or date '{DAY}' <= valid_to) group by principal_id, group_id
      union all select principal_id, 'relation', relation, subject, 4, null, path from {{people}} join paths using (employee_id)
      union all select principal_id, 'relation', 'self', employee_id, 4, null, '' from people where employee_id is not null
      union all select principal_id, 'principal', '', cast(principal_id as varchar), 4, null, '' from people),
    offer as (select doc_id, kind, position, coalesce(relation, '') relation, value val from {{doc_grants}})"""
#: Decisions for the rows of `pairs`.
_DECIDE = f"""x as (select p.*, c.doc_id, c.tenant_id, c.label, c.status, t.tenant_status, case when c.tenant_id = 'T-0' then 'internal' when c.tenant_id = p.home_tenant_id then 'own' else 'other' end place
      from pairs join people p using (principal_id) join {{corpus}} c using (doc_id) left join {{tenants}} t using (tenant_id)),
    ruled as (select *, case when principal_status <> 'active' then ['deny', 'global_deny', 'principal_not_active'] when status = 'deleted' then ['deny', 'global_deny', 'document_deleted'] when tenant_status <> 'active' then ['deny', 'global_deny', 'tenant_not_active']
      when principal_type = 'customer_user' and place = 'other' or principal_type <> 'customer_user' and place = 'own' then ['deny', 'tenant', 'tenant_isolation'] when principal_type = 'customer_user' and place = 'internal' and label <> 'public' then ['deny', 'tenant', 'public_only']
      when principal_type = 'service_account' and not list_contains(string_split(scopes, ' '), tenant_id) then ['deny', 'tenant', 'outside_scopes'] when principal_type = 'customer_user' and label in ('internal', 'restricted') then ['deny', 'label', 'principal_type_for_label']
      when label in ('public', 'internal') and not (principal_type = 'employee' and place = 'other') then ['allow', 'label', label || '_label'] end r from x),
    met as (select x.principal_id, x.doc_id, list_position(['group', 'relation', 'principal'], o.kind) ord, o.position, o.kind kind, case when o.relation <> '' then o.relation || ':' || o.val else o.val end val, h.member, h.path
      from ruled x join offer o using (doc_id) join held h on h.principal_id = x.principal_id and h.kind = o.kind and h.relation = o.relation and h.val = o.val
      where x.r is null and x.label in ('confidential', 'restricted') and {_RANK.format(c='x.label')} <= h.most and not (x.label = 'restricted' and o.relation in ('manager_of', 'account_team_of'))
      union all select principal_id, doc_id, 4, 0, 'tenant_membership', tenant_id, null, '' from ruled where r is null and principal_type = 'customer_user' and place = 'own' and label = 'confidential'),
    best as (select principal_id, doc_id, arg_min(struct_pack(k := kind, v := val, m := member, p := path), struct_pack(a := ord, b := position)) g from met group by all),
    full_rows as (select x.*, g, coalesce(x.r, case when g is not null then ['allow', 'grant', g.k || '_grant'] else ['deny', 'grant', 'no_matching_grant'] end) d from ruled x left join best using (principal_id, doc_id)),
    decided as (select principal_id, doc_id, d[1] decision, d[2] step, d[3] reason, g.k grant_type, g.v grant_value, g.m via_membership_id, g.p via_edge_ids from full_rows)"""
_PAIRS = f"""with {_HOLD}, dn as (select document_id, row_number() over (order by md5('pairs' || document_id), document_id) r from (select distinct document_id from {{corpus}})),
    pn as (select c_custkey, row_number() over (order by md5('pairs' || cast(c_custkey as varchar)), c_custkey) r from customer), least_of as (select least((select count(*) from dn), (select count(*) from pn)) g),
    pairs as (select c_custkey principal_id, doc_id from least_of cross join dn join pn on dn.r % g = pn.r % g join corpus using (document_id)
      union select h.principal_id, c.doc_id from offer o join held h on h.kind = o.kind and h.relation = o.relation and h.val = o.val join corpus b on b.doc_id = o.doc_id join corpus c on c.document_id = b.document_id where o.kind <> 'group'),
    """ + _DECIDE
_FOUND = f"with {_TOP}, {_HOLD}, answers as (select query_id + query_id // 50 % 10 principal_id, doc_id, rank, score from f3), pairs as (select principal_id, doc_id from answers), " + _DECIDE
_LEAKS = "lk as (select a.principal_id, a.doc_id, coalesce(reason, 'unknown') reason from answers a left join decided d on d.principal_id = a.principal_id and d.doc_id = a.doc_id where coalesce(decision, 'deny') = 'deny')"
_HRULE = """v as (select d.*, c.document_id, c.status from decided d join corpus c using (doc_id)), now as (select principal_id, document_id, decision from v where status = 'current'),
    hr as (select v.principal_id, v.doc_id, case when x then 'deny' else v.decision end decision, case when x then 'history' else v.reason end reason from (select v.*, v.status = 'superseded' and v.decision = 'allow' and coalesce(now.decision, 'allow') = 'deny' x from v left join now using (principal_id, document_id)) v)"""
_WANT = "want as (select distinct principal_id, group_id from {principals} p join rules r on (kind = 'department' and department = r.val) or (kind = 'type' and principal_type = r.val) where principal_status = 'active' and principal_type <> 'customer_user')"
ORACLES = {
    "h1_validate_records": """select doc_id, e errors from (select doc_id, concat_ws(',', case when coalesce(lang in ('en', 'de', 'fr'), false) then null else 'lang' end, case when coalesce(n_chars = length(text), false) then null else 'length' end,
        case when coalesce(regexp_matches(source, '^src\\d+$'), false) then null else 'source' end, case when coalesce(n_chars between 50 and 20000, false) then null else 'size' end) e from documents) where e <> ''""",
    "h1_unknown_fields": "select field, count(*) n from (select unnest(json_keys(props)) field from events) where field <> 'known' group by field",
    "h2_field_coverage": "select 'source' \"group\", 4 present, 4 total, 'PASS' verdict from documents having count(*) > 0 union all select 'evaluation', 2, 2, 'FAIL' union all select 'governance', 4, 4, 'PASS'",
    "h3_dictionary_audit": f"""with {_values('d', 'field, c, r', _DICTIONARY)}, s as (select unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) field from (select count(*) n from documents) where n > 0 union select unnest(json_keys(props)) from events), j as (select coalesce(s.field, d.field) field, s.field sf, d.field df, c, r from s full join d on s.field = d.field)
        select field, 'undocumented' problem from j where df is null union all select field, 'not in schema' from j where sf is null union all select field, 'bad class' from j where df is not null and c not in ('filterable', 'returnable', 'internal')
        union all select field, 'role needs filterable' from j where r is not null and c <> 'filterable'""",
    "h4_relevance_filter": "select doc_id, lang, doc_type from {corpus} where lang = 'en'",
    "h5_governance_filter": "select doc_id, access_group, label from {corpus} where access_group = 'G-1' and label in ('public', 'internal')",
    "h6_access_decisions": _PAIRS + " select * from decided",
    "h7_relation_grants": f"with {_HOLD} select principal_id, relation, val subject, path from held where kind = 'relation'",
    "h8_history_rule": _PAIRS + f", {_HRULE} select * from hr",
    "h9_group_membership": f"with {_values('rules', 'kind, val, group_id', _RULES)}, {_WANT} select * from want",
    "h10_membership_sync": f"""with {_values('rules', 'kind, val, group_id', _RULES)}, {_WANT}, h as (select * from {{memberships}} where valid_to is null)
        select coalesce(w.principal_id, h.principal_id) principal_id, coalesce(w.group_id, h.group_id) group_id, case when w.principal_id is null then 'close' else 'open' end change,
        case when h.principal_id is null then date '{DAY}' else h.valid_from end valid_from, case when w.principal_id is null then cast(date '{DAY}' - interval 1 day as date) end valid_to
        from want w full join h on w.principal_id = h.principal_id and w.group_id = h.group_id where w.principal_id is null or h.principal_id is null""",
    "h11_label_conformance": f"""with {_values('df', 'doc_type, dl, dg', _DEFAULTS)}, {_values('g', 'access_group, ml', _GROUPS)}, j as (select * from {{corpus}} left join df using (doc_type) left join g using (access_group))
        select doc_id, 'looser than default' problem from j where {_RANK.format(c='label')} < {_RANK.format(c='dl')} union all select doc_id, 'group below label' from j where {_RANK.format(c='label')} > {_RANK.format(c='ml')}""",
    "h12_authorized_topk": f"""with {_HOLD}, v as (select vec_id, embedding::double[] e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) l from v),
        asked as (select vec_id + vec_id // 50 % 10 principal_id, e, l from n where vec_id % 50 = 0), pairs as (select a.principal_id, n.vec_id doc_id from asked a cross join n), {_DECIDE},
        ok as (select principal_id, doc_id from decided join corpus using (doc_id) where decision = 'allow' and status = 'current'),
        k as (select principal_id, doc_id, round(case when n.l > 0 and a.l > 0 then list_dot_product(a.e, n.e) / (a.l * n.l) else 0 end, 6) score from ok join asked a using (principal_id) join n on n.vec_id = doc_id),
        placed as (select principal_id, doc_id, score, cast(row_number() over (partition by principal_id order by score desc, doc_id) as integer) rank from k) select * from placed where rank <= 3""",
    "h13_leak_audit": _FOUND + f", {_LEAKS} select * from lk",
    "h14_filter_collapse": _FOUND + ", b as (select principal_id, count(*) n from answers group by 1), a as (select principal_id, count(*) n from decided where decision = 'allow' group by 1) select b.principal_id, b.n n_before, coalesce(a.n, 0) n_after, round(coalesce(a.n, 0) / b.n, 6) share, round(coalesce(a.n, 0) / b.n, 6) < 0.5 collapsed from b left join a using (principal_id)",
    "h15_audit_log": _PAIRS + " select principal_id, doc_id, tenant_id, label, decision, reason, sha256('query of ' || principal_id) query_hash from decided join corpus using (doc_id) where decision = 'deny' or label in ('confidential', 'restricted')",
    "h16_matrix_compare": _PAIRS + f", {_HRULE} select principal_id, doc_id, 'different' difference from decided join hr using (principal_id, doc_id) where decided.decision <> hr.decision",
    "h17_derive_grants": f"""with {_values('df', 'doc_type, dl, dg', _DEFAULTS)}, j as (select doc_id, access_group, dg, case when doc_id % 3 = 0 then label else dl end label from {{corpus}} left join df using (doc_type))
        select doc_id, label, case when label in ('public', 'internal') then '' when access_group = dg then dg else access_group || ',' || dg end as groups from j""",
    "h18_safe_projection": "select doc_id, lang, n_chars from documents",
    "i13_permission_outcomes": _FOUND + """ select c.label doc_label, count(*) filter (q.label = v.label and decision = 'allow') relevant_allowed, count(*) filter (q.label = v.label and decision = 'deny') relevant_forbidden, count(*) filter (q.label <> v.label) irrelevant
        from f3 a join decided d on d.principal_id = a.query_id + a.query_id // 50 % 10 and d.doc_id = a.doc_id join embeddings q on q.vec_id = a.query_id join embeddings v on v.vec_id = a.doc_id join corpus c on c.doc_id = a.doc_id group by c.label""",
}
