"""Validation and access: record checks, decisions on who may read what, membership, leaks, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.operators.changes import day_before

#: Labels from the loosest on (fixed values).
LABELS = ["public", "internal", "confidential", "restricted"]


def label_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LABELS)), c) - 1


def errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and a quarantine of bad ones with payload and reasons."""
    checked = df.withColumn("errors", errors(rules))
    bad = checked.where(F.size("errors") > 0).select("errors", F.to_json(F.struct(*df.columns)).alias("payload"))
    return checked.where(F.size("errors") == 0).drop("errors"), bad


def unknown_fields(payload: Column, known: list[str]) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*map(F.lit, known)))


def field_coverage(df: DataFrame, groups: dict[str, list[str]], least: dict[str, int]) -> DataFrame:
    """Fields with any value for each group, and PASS where a group has as many as it needs."""
    one = df.agg(*(F.count(c).alias(c) for c in sorted({c for g in groups.values() for c in g})))
    have = lambda g: sum((F.col(c) > 0).cast("int") for c in groups[g])
    rows = F.array(*(F.struct(F.lit(g).alias("group"), have(g).alias("present"), F.lit(len(groups[g])).alias("total"), F.when(have(g) >= least.get(g, 0), "PASS").otherwise("FAIL").alias("verdict")) for g in groups))
    return one.select(F.inline(rows))


def audit_dictionary(fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Problems between the fields of a schema (field) and a dictionary (field, classification, filter_role)."""
    j = fields.select("field", F.lit(True).alias("s")).join(dictionary.withColumn("d", F.lit(True)), "field", "full_outer")
    classes = ["filterable", "returnable", "internal"]
    found = F.array_compact(F.array(F.when(F.col("d").isNull(), F.lit("undocumented")), F.when(F.col("s").isNull(), F.lit("not in schema")), F.when(F.col("d") & ~F.col("classification").isin(classes), F.lit("bad class")), F.when(F.col("filter_role").isNotNull() & (F.col("classification") != "filterable"), F.lit("role needs filterable"))))
    return j.select("field", F.explode(found).alias("problem"))


def relevance_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    for c, v in wanted.items():
        df = df if v is None else df.where(F.col(c) == v)
    return df


def governance_filter(df: DataFrame, access_group: str, allowed: list[str]) -> DataFrame:
    return df.where((F.col("access_group") == access_group) & F.col("label").isin(allowed))


def with_history_rule(decided: DataFrame, versions: DataFrame) -> DataFrame:
    """A superseded or archived version is allowed only if the current one of its document is too, if there is one. versions: doc_id, document_id, status."""
    v = decided.join(versions.select("doc_id", "document_id", "status"), "doc_id")
    now = v.where("status = 'current'").select("principal_id", "document_id", F.col("decision").alias("current_decision"))
    j = v.join(now, ["principal_id", "document_id"], "left")
    closed = F.col("status").isin("superseded", "archived") & (F.col("decision") == "allow") & (F.coalesce("current_decision", F.lit("allow")) == "deny")
    return j.select("principal_id", "doc_id", F.when(closed, "deny").otherwise(F.col("decision")).alias("decision"), F.when(closed, "history").otherwise(F.col("reason")).alias("reason"))


def wanted_groups(principals: DataFrame, rules: DataFrame, excluded: str) -> DataFrame:
    """(principal_id, group_id) from rules by department or by type (kind, value, group_id), without an excluded type."""
    active = principals.where((F.col("principal_status") == "active") & (F.col("principal_type") != excluded))
    r = F.broadcast(rules)
    by = lambda kind, c: active.join(r.where(F.col("kind") == kind).select(F.col("value").alias(c), "group_id"), c).select("principal_id", "group_id")
    return by("department", "department").unionByName(by("type", "principal_type")).distinct()


def sync_memberships(wanted: DataFrame, held: DataFrame, day: Column) -> DataFrame:
    """(principal_id, group_id, change, valid_from, valid_to): what to open on a day and what to close the day before."""
    h = held.where("valid_to is null").select("principal_id", "group_id", F.col("valid_from").alias("since"))
    j = wanted.withColumn("w", F.lit(True)).join(h, ["principal_id", "group_id"], "full_outer")
    change = F.when(F.col("w").isNull(), "close").when(F.col("since").isNull(), "open")
    return j.withColumn("change", change).where("change is not null").select("principal_id", "group_id", "change", F.when(F.col("change") == "open", day).otherwise(F.col("since")).alias("valid_from"), F.when(F.col("change") == "close", day_before(day)).alias("valid_to"))


def label_conformance(docs: DataFrame, defaults: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, problem): documents looser than their type's default, or with a group whose highest label is below theirs."""
    j = docs.join(F.broadcast(defaults), "doc_type", "left").join(F.broadcast(groups), "access_group", "left")
    found = F.array_compact(F.array(F.when(label_rank(F.col("label")) < label_rank(F.col("default_label")), F.lit("looser than default")), F.when(label_rank(F.col("label")) > label_rank(F.col("max_label")), F.lit("group below label"))))
    return j.select("doc_id", F.explode(found).alias("problem"))


def derive_grants(docs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Each document with its label (its own or its type's default) and the groups granted: none for public and internal."""
    j = docs.join(F.broadcast(defaults), "doc_type", "left").withColumn("label", F.coalesce("label", "default_label"))
    own = F.filter(F.array(F.col("access_group"), F.col("default_group")), lambda g: g.isNotNull())
    return j.select("doc_id", "label", F.when(F.col("label").isin("public", "internal"), F.array().cast("array<string>")).otherwise(F.array_distinct(own)).alias("groups"))


def leaks(results: DataFrame, decided: DataFrame) -> DataFrame:
    """Results (principal_id, doc_id) that the decisions deny or don't know."""
    j = results.join(decided.select("principal_id", "doc_id", "decision", "reason"), ["principal_id", "doc_id"], "left")
    return j.where(F.coalesce("decision", F.lit("deny")) == "deny").select(*results.columns, F.coalesce("reason", F.lit("unknown")).alias("reason"))


def filter_collapse(before: DataFrame, after: DataFrame, by: str, least: float) -> DataFrame:
    """Candidates before and after the policy filter, and whether the share left fell below a floor."""
    a, b = (x.groupBy(by).agg(F.count("*").alias(n)) for x, n in ((before, "n_before"), (after, "n_after")))
    j = a.join(b, by, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    return j.withColumn("share", F.round(F.col("n_after") / F.col("n_before"), 6)).withColumn("collapsed", F.col("share") < least)


def audit_rows(decided: DataFrame, docs: DataFrame, query: Column) -> DataFrame:
    """One row to keep for each decision: all denials, and what was allowed of confidential or restricted documents; the query is hashed."""
    j = decided.join(docs.select("doc_id", "label", "tenant_id"), "doc_id")
    return j.where((F.col("decision") == "deny") | F.col("label").isin("confidential", "restricted")).select("principal_id", "doc_id", "tenant_id", "label", "decision", "reason", F.sha2(query, 256).alias("query_hash"))


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """(principal_id, doc_id, difference) between two decision tables."""
    j = a.select("principal_id", "doc_id", F.col("decision").alias("da")).join(b.select("principal_id", "doc_id", F.col("decision").alias("db")), ["principal_id", "doc_id"], "full_outer")
    diff = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "unexpected").when(F.col("da") != F.col("db"), "different")
    return j.select("principal_id", "doc_id", diff.alias("difference")).where("difference is not null")


def safe_projection(df: DataFrame, dictionary: dict[str, str], leaving: tuple[str, ...] = ("filterable", "returnable")) -> DataFrame:
    """The columns whose class may leave the service."""
    return df.select(*(c for c in df.columns if dictionary.get(c) in leaving))
