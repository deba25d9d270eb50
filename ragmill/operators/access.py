"""Who may read which document on a day: rules by tenant and label, grants with their evidence, and search within what may be read.

Decisions are relational. What a principal holds (groups, relations, its own name) is one table with the evidence for each holding, what documents grant is
another, and one equi-join of the two serves every kind of grant; only pairs that the rules leave open take part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.functions.text import cosine
from ragmill.operators.changes import valid_on
from ragmill.operators.govern import LABELS, label_rank
from ragmill.operators.retrieve import exact_topk, ranked
from ragmill.sources.tables import kept, small_side

#: What a type of principal may do in the internal tenant, in its own customer tenant and in any other (fixed values).
TENANT_RULES = {
    "employee": {"internal": "allowed", "own": "never", "other": "grant_required"},
    "customer_user": {"internal": "public_only", "own": "allowed", "other": "never"},
    "service_account": {"internal": "scope_required", "own": "never", "other": "scope_required"},
}
#: By label: who may read it at all, whether that takes a grant, by which kinds of grant and by which relations (fixed values).
LABEL_RULES = {
    "public": (("employee", "customer_user", "service_account"), False, (), ()),
    "internal": (("employee", "service_account"), False, (), ()),
    "confidential": (("employee", "customer_user", "service_account"), True, ("group", "relation", "principal", "tenant_membership"), ("self", "manager_of", "account_team_of")),
    "restricted": (("employee", "service_account"), True, ("group", "relation", "principal"), ("self",)),
}
#: Kinds of grant in the order in which they are told (fixed values).
GRANT_KINDS = ["group", "relation", "principal", "tenant_membership"]


def relation_paths(edges: DataFrame, day: Column, depth: int = 2) -> DataFrame:
    """(employee_id, relation, subject, path): to whom somebody stands in a relation on a day, and the ids of the edges that show it.

    edges: edge_id, relation, from_id, to_id, valid_from, valid_to. manager_of follows reports_to from the subject up to depth steps, each by an equi-join; account_team_of
    is one edge from the employee to the subject. Of several paths the shortest stands, then the first by its ids. What anybody is to itself needs no edge.
    """
    now = edges.where(valid_on(day, F.col("valid_from"), F.col("valid_to")))
    up = now.where("relation = 'reports_to'").select(F.col("from_id").alias("below"), F.col("to_id").alias("above"), "edge_id")
    at = up.select(F.col("below").alias("subject"), F.col("above").alias("employee_id"), F.array("edge_id").alias("path"))
    found = at
    for _ in range(depth - 1):
        at = at.join(up, F.col("employee_id") == F.col("below")).select("subject", F.col("above").alias("employee_id"), F.concat("path", F.array("edge_id")).alias("path"))
        found = found.unionByName(at)
    led = found.where("subject <> employee_id").groupBy("employee_id", "subject").agg(F.min(F.struct(F.size("path").alias("n"), "path"))["path"].alias("path"))
    team = now.where("relation = 'account_team_member_of'").groupBy(F.col("from_id").alias("employee_id"), F.col("to_id").alias("subject")).agg(F.array(F.min("edge_id")).alias("path"))
    both = led.withColumn("relation", F.lit("manager_of")).unionByName(team.withColumn("relation", F.lit("account_team_of")))
    return both.select("employee_id", "relation", "subject", "path")


def holdings(principals: DataFrame, memberships: DataFrame, groups: DataFrame, paths: DataFrame, day: Column) -> DataFrame:
    """(principal_id, kind, relation, value, most, via_membership_id, via_edge_ids): all that may open a document to a principal.

    Groups count while they are active and by a membership that is open on the day, up to their highest label (most); of several memberships the first id stands.
    """
    none = F.lit(None).cast("string")
    no_edges = F.array().cast("array<string>")
    all_labels = F.lit(len(LABELS) - 1)
    open_ = memberships.where(valid_on(day, F.col("valid_from"), F.col("valid_to"))).groupBy("principal_id", "group_id").agg(F.min("membership_id").alias("via_membership_id"))
    known = groups.where("group_status = 'active'").select("group_id", label_rank(F.col("max_label")).alias("most"))
    by_group = open_.join(known, "group_id").select("principal_id", F.lit("group").alias("kind"), none.alias("relation"), F.col("group_id").alias("value"), F.col("most").cast("int").alias("most"), "via_membership_id", no_edges.alias("via_edge_ids"))
    staff = principals.where("employee_id is not null").select("principal_id", "employee_id")
    row = lambda kind, relation, value, edges: (F.lit(kind).alias("kind"), relation.alias("relation"), value.alias("value"), all_labels.alias("most"), none.alias("via_membership_id"), edges.alias("via_edge_ids"))
    by_path = staff.join(paths, "employee_id").select("principal_id", *row("relation", F.col("relation"), F.col("subject"), F.col("path")))
    oneself = staff.select("principal_id", *row("relation", F.lit("self"), F.col("employee_id"), no_edges))
    by_name = principals.select("principal_id", *row("principal", none, F.col("principal_id").cast("string"), no_edges))
    return by_group.unionByName(by_path).unionByName(oneself).unionByName(by_name)


def _by_label(part: int, value: Column) -> Column:
    """Whether the label's rule holds a value in that part."""
    return F.coalesce(*(F.when(F.col("label") == n, value.isin(*r[part]) if r[part] else F.lit(False)) for n, r in LABEL_RULES.items()), F.lit(False))


def _tenant_access(internal: str) -> Column:
    """The tenant rule that holds between a principal and a document."""
    where = F.when(F.col("tenant_id") == internal, "internal").when(F.col("tenant_id") == F.col("home_tenant_id"), "own").otherwise("other")
    return F.coalesce(*(F.when((F.col("principal_type") == t) & (where == w), F.lit(a)) for t, rules in TENANT_RULES.items() for w, a in rules.items()), F.lit("never"))


def ruled(rows: DataFrame, internal: str) -> DataFrame:
    """rows of principals and documents with a column rule: decision, step and reason; null where a grant has to decide.

    Needs principal_type, principal_status, home_tenant_id, service_scopes; tenant_id, tenant_status, label, status. The first step that applies stands.
    """
    say = lambda decision, step, reason: F.struct(F.lit(decision).alias("decision"), F.lit(step).alias("step"), reason.alias("reason"))
    deny = lambda step, reason: say("deny", step, F.lit(reason))
    label, access = F.col("label"), F.col("_access")
    needs = F.coalesce(*(F.when(label == n, F.lit(r[1])) for n, r in LABEL_RULES.items()), F.lit(True))
    rule = (
        F.when(~F.coalesce(F.col("principal_status") == "active", F.lit(False)), deny("global_deny", "principal_not_active"))
        .when(F.coalesce(F.col("status"), F.lit("")) == "deleted", deny("global_deny", "document_deleted"))
        .when(~F.coalesce(F.col("tenant_status") == "active", F.lit(False)), deny("global_deny", "tenant_not_active"))
        .when(access == "never", deny("tenant", "tenant_isolation"))
        .when((access == "public_only") & (label != "public"), deny("tenant", "public_only"))
        .when((access == "scope_required") & ~F.coalesce(F.array_contains("service_scopes", F.col("tenant_id")), F.lit(False)), deny("tenant", "outside_scopes"))
        .when(~_by_label(0, F.col("principal_type")), deny("label", "principal_type_for_label"))
        .when(~needs & (access != "grant_required"), say("allow", "label", F.concat(label, F.lit("_label"))))
    )
    return rows.withColumn("_access", _tenant_access(internal)).withColumn("rule", rule).drop("_access")


def matched(open_: DataFrame, grants: DataFrame, held: DataFrame) -> DataFrame:
    """(principal_id, doc_id, g): the first grant that opens a document to a principal: by kind, then by its position on the document.

    open_ are pairs with label, principal_type, home_tenant_id and tenant_id. grants: doc_id, kind, position, relation, value.
    """
    kind = lambda c: F.array_position(F.array(*map(F.lit, GRANT_KINDS)), c)
    told = lambda k, at, value, membership, edges: F.struct(kind(k).alias("order"), at.alias("at"), k.alias("grant_type"), value.alias("grant_value"), membership.alias("via_membership_id"), edges.alias("via_edge_ids")).alias("g")
    offered = open_.select("principal_id", "doc_id", "label").join(grants, "doc_id").where(_by_label(2, F.col("kind")) & (F.col("relation").isNull() | _by_label(3, F.col("relation"))))
    met = offered.withColumn("relation", F.coalesce("relation", F.lit(""))).join(held.withColumn("relation", F.coalesce("relation", F.lit(""))), ["principal_id", "kind", "relation", "value"]).where(label_rank(F.col("label")) <= F.col("most"))
    named = F.when(F.col("relation") != "", F.concat_ws(":", "relation", "value")).otherwise(F.col("value"))
    by_grant = met.select("principal_id", "doc_id", told(F.col("kind"), F.col("position"), named, F.col("via_membership_id"), F.col("via_edge_ids")))
    home = open_.where((F.col("principal_type") == "customer_user") & (F.col("tenant_id") == F.col("home_tenant_id")) & _by_label(2, F.lit("tenant_membership")))
    by_tenant = home.select("principal_id", "doc_id", told(F.lit("tenant_membership"), F.lit(0), F.col("tenant_id"), F.lit(None).cast("string"), F.array().cast("array<string>")))
    return by_grant.unionByName(by_tenant).groupBy("principal_id", "doc_id").agg(F.min("g").alias("g"))


def access(pairs: DataFrame, principals: DataFrame, docs: DataFrame, tenants: DataFrame, grants: DataFrame, held: DataFrame, internal: str) -> DataFrame:
    """Decision, step and reason of each pair (principal_id, doc_id), with the grant that opened it and what shows that it is held.

    Denials of the whole, of tenants and of labels are final; a label that needs no grant allows, if the tenant rule asks for none; else a grant must match.
    """
    rows = pairs.select("principal_id", "doc_id").join(principals.select("principal_id", "principal_type", "principal_status", "home_tenant_id", "service_scopes"), "principal_id")
    rows = rows.join(docs.select("doc_id", "tenant_id", "label", "status"), "doc_id").join(F.broadcast(tenants), "tenant_id", "left")  # a row for each tenant
    known = kept(ruled(rows, internal), "ruled")
    g = matched(known.where("rule is null"), grants, held)
    j = known.select("principal_id", "doc_id", "rule").join(g, ["principal_id", "doc_id"], "left")
    by_grant = F.when(F.col("g").isNotNull(), F.struct(F.lit("allow").alias("decision"), F.lit("grant").alias("step"), F.concat(F.col("g.grant_type"), F.lit("_grant")).alias("reason"))).otherwise(F.struct(F.lit("deny").alias("decision"), F.lit("grant").alias("step"), F.lit("no_matching_grant").alias("reason")))
    r = F.coalesce("rule", by_grant)
    return j.select("principal_id", "doc_id", r.alias("r"), "g").select("principal_id", "doc_id", "r.*", "g.grant_type", "g.grant_value", "g.via_membership_id", F.array_join("g.via_edge_ids", ",").alias("via_edge_ids"))


def _numbered(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """df with a number for each distinct value of columns, and those values by number; written once, so the numbers stay."""
    keyed = df.withColumn("_key", F.sha2(F.to_json(F.struct(*columns)), 256))
    kinds = kept(keyed.groupBy("_key").agg(*(F.first(c).alias(c) for c in columns)).withColumn(name, F.monotonically_increasing_id()), name)
    return keyed.join(small_side(kinds.select("_key", name), name), "_key").drop("_key"), kinds.drop("_key")


def entitlements(askers: DataFrame, docs: DataFrame, tenants: DataFrame, grants: DataFrame, held: DataFrame, internal: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What may be read, as classes: documents (doc_id, class), askers (principal_id, classes), and single pairs (principal_id, doc_id) beside them.

    Documents of one tenant, label, status and set of granting groups are one class for everybody, and principals of one type, status, home, scopes and set of groups are one
    class of readers. The two meet by the tenants that a reader can reach and by groups, in equi-joins, so there are as many rows as pairs of classes that share one. Grants to single
    principals and by relations open single pairs; these are as many as the grants' holders.
    """
    by_group = grants.where("kind = 'group'").groupBy("doc_id").agg(F.sort_array(F.collect_set("value")).alias("granting"))  # the groups that one document names
    facts = docs.select("doc_id", "tenant_id", "label", "status").join(F.broadcast(tenants), "tenant_id", "left").join(by_group, "doc_id", "left")
    facts = facts.withColumn("granting", F.coalesce("granting", F.array().cast("array<string>")))
    kinds = ["tenant_id", "tenant_status", "label", "status", "granting"]
    classed, doc_kinds = _numbered(facts, kinds, "class")

    own = held.where("kind = 'group'").join(askers.select("principal_id"), "principal_id", "left_semi")
    groups = own.groupBy("principal_id").agg(F.sort_array(F.collect_set(F.struct("value", "most"))).alias("groups"))  # the groups that one principal is in
    people = askers.select("principal_id", "principal_type", "principal_status", "home_tenant_id", "service_scopes").join(groups, "principal_id", "left")
    people = people.withColumn("groups", F.coalesce("groups", F.array().cast("array<struct<value:string,most:int>>")))
    reads = ["principal_type", "principal_status", "home_tenant_id", "service_scopes", "groups"]
    readers, reader_kinds = _numbered(people, reads, "reader")

    reached = reader_kinds.select("reader", F.explode(F.array_distinct(F.concat(F.array(F.lit(internal), F.col("home_tenant_id")), F.coalesce("service_scopes", F.array().cast("array<string>"))))).alias("tenant_id"))
    by_tenant = reached.join(doc_kinds.select("tenant_id", "class"), "tenant_id").select("reader", "class")
    held_groups = reader_kinds.select("reader", F.explode("groups").alias("g")).select("reader", F.col("g.value").alias("group_id"))
    met = held_groups.join(doc_kinds.select(F.explode("granting").alias("group_id"), "class"), "group_id").select("reader", "class")
    pairs = by_tenant.unionByName(met).distinct().join(reader_kinds, "reader").join(doc_kinds, "class")
    in_group = F.exists("groups", lambda g: F.array_contains("granting", g["value"]) & (label_rank(F.col("label")) <= g["most"])) & _by_label(2, F.lit("group"))
    at_home = (F.col("principal_type") == "customer_user") & (F.col("tenant_id") == F.col("home_tenant_id")) & _by_label(2, F.lit("tenant_membership"))
    open_ = ruled(pairs, internal).where((F.col("rule.decision") == "allow") | (F.col("rule").isNull() & (in_group | at_home)))
    classes = open_.groupBy("reader").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    allowed = readers.select("principal_id", "reader").join(classes, "reader").select("principal_id", "classes")

    single = grants.where("kind <> 'group'").withColumn("relation", F.coalesce("relation", F.lit("")))
    names = held.where("kind <> 'group'").join(askers.select("principal_id"), "principal_id", "left_semi").withColumn("relation", F.coalesce("relation", F.lit("")))
    offered = single.join(names, ["kind", "relation", "value"]).select("principal_id", "doc_id").distinct()
    beside = access(offered, askers, docs, tenants, grants, held, internal).where("decision = 'allow'").select("principal_id", "doc_id")
    return classed.select("doc_id", "class"), allowed, beside


def authorized_topk(vectors: DataFrame, queries: DataFrame, entitled: tuple[DataFrame, DataFrame, DataFrame], k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the best k among what the asker may read, which is tested before any cut, so k come wherever as many exist.

    vectors are (id, vector) by document, queries (id, vector) by principal. Classes are tested within each shard; single pairs are scored by joins.
    """
    classed, allowed, beside = entitled
    rows = vectors.join(classed.withColumnRenamed("doc_id", "id"), "id")
    asked = queries.join(allowed.withColumnRenamed("principal_id", "id"), "id")
    by_class = exact_topk(rows, asked, k, skip_self=False, classes=True).select("query_id", "doc_id", "score")
    pair = beside.join(queries.select(F.col("id").alias("principal_id"), F.col("vector").alias("asked")), "principal_id").join(vectors.select(F.col("id").alias("doc_id"), "vector"), "doc_id")
    by_pair = pair.select(F.col("principal_id").alias("query_id"), "doc_id", (F.round(cosine(F.col("asked"), F.col("vector")), 6) + 0.0).alias("score"))
    both = by_class.unionByName(by_pair).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return ranked(both, ["query_id"], [F.desc("score"), F.col("doc_id")], k).select("query_id", "rank", "doc_id", "score")
