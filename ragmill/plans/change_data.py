"""Queries on change data and consistency, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators import changes as G
from ragmill.operators.retrieve import ivf_build, ivf_probes, ivf_topk
from ragmill.operators.retrieve import recall_report as ann_report
from ragmill.plans.retrieval import f3 as exact_topk
from ragmill.plans.retrieval import probes, vectors
from ragmill.sources.tables import scratch, table

CHECKS = ["missing_vectors", "orphaned_vectors", "metadata_mismatch", "model_mismatch", "undeleted", "duplicate_vectors"]
_THRESHOLDS = [("missing_vectors", 10.0, "PAGE", "search"), ("orphaned_vectors", 100000.0, "WARN", "search"), ("metadata_mismatch", 0.0, "WARN", "ingest"), ("undeleted", 0.0, "PAGE", "privacy"), ("_note", 0.0, "WARN", "none")]


def g1(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "cdc_events")
    half = e.agg(F.max("delivery_pos")).first()[0] // 2  # a checkpoint: one number
    a = G.replay(e, F.col("delivery_pos") <= half).withColumn("checkpoint", F.lit("half"))
    return a.unionByName(G.replay(e).withColumn("checkpoint", F.lit("end")))


def g2(spark: SparkSession, sf: str) -> DataFrame:
    return G.anomalies(table(spark, sf, "cdc_events"))


def g3(spark: SparkSession, sf: str) -> DataFrame:
    return G.refresh_actions(table(spark, sf, "source_records"), table(spark, sf, "vector_index")).select("source_id", "action")


def g3_state(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "vector_index")
    return G.refreshed(G.refresh_actions(table(spark, sf, "source_records"), index), index)


def g4(spark: SparkSession, sf: str) -> DataFrame:
    return G.rebuild_decision(table(spark, sf, "vector_index"), {"model_changed": F.col("model") != "m1", "schema_changed": F.col("access_group").isNull(), "corrupt": ~F.col("status").isin("active", "deleted")})


def _violations(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "vector_index")
    return G.consistency(table(spark, sf, "source_records"), index.unionByName(index.where("source_id % 23 = 0")), "m1")


def g6(spark: SparkSession, sf: str) -> DataFrame:
    metrics = G.counts(_violations(spark, sf), CHECKS).withColumn("value", F.col("value").cast("double"))
    return G.alerts(metrics, spark.createDataFrame(_THRESHOLDS, "metric string, most double, severity string, owner string"))


def g7(spark: SparkSession, sf: str) -> DataFrame:
    return G.operational(table(spark, sf, "vector_index"), table(spark, sf, "source_records"))


def g8(spark: SparkSession, sf: str) -> DataFrame:
    return G.resolve(table(spark, sf, "vector_index"), table(spark, sf, "source_records"))


def g9(spark: SparkSession, sf: str) -> DataFrame:
    """Write a snapshot and a damaged version, find the damage, go back to the snapshot, compact and validate it."""
    source, good = table(spark, sf, "source_records"), G.refreshed(G.refresh_actions(table(spark, sf, "source_records"), table(spark, sf, "vector_index")), table(spark, sf, "vector_index"))
    root = scratch(spark, "index")
    good.write.parquet(f"{root}/v=1")
    good.withColumn("model", F.lit("m9")).write.parquet(f"{root}/v=2")
    old, new = spark.read.parquet(f"{root}/v=1"), spark.read.parquet(f"{root}/v=2")
    report = lambda name, df: G.counts(G.consistency(source, df, "m1"), CHECKS).withColumn("version", F.lit(name))
    return report("damaged", new).unionByName(report("restored", G.compacted(old)))


def g9_incident(spark: SparkSession, sf: str) -> DataFrame:
    """A damaged version goes live; validation finds it, the pointer goes back to the last good version, that is compacted, and the incident put on record."""
    source, index = table(spark, sf, "source_records"), table(spark, sf, "vector_index")
    good, root = G.refreshed(G.refresh_actions(source, index), index), scratch(spark, "index")
    versions = {1: good, 2: good.withColumn("model", F.when(F.col("source_id") % 3 == 0, "m9").otherwise(F.col("model")))}
    for v, df in versions.items():
        df.write.parquet(f"{root}/v={v}")
        G.point(spark, f"{root}/pointer", v)
    live = G.live(spark, root)
    found = G.counts(G.consistency(source, live, "m1"), CHECKS)
    if found.agg(F.sum("value")).first()[0]:
        G.point(spark, f"{root}/pointer", G.pointed(spark, f"{root}/pointer") - 1)
    restored = G.live(spark, root)
    return G.incident(found, G.counts(G.consistency(source, G.compacted(restored), "m1"), CHECKS), restored, G.pointed(spark, f"{root}/pointer"))


def g10(spark: SparkSession, sf: str) -> DataFrame:
    """Two shadow indexes at the number of probes that serves: the index as it stands, and refreshed with one model. Only one without violations and with enough recall goes live."""
    index, centres = ivf_build(vectors(spark, sf), 16)
    served = ivf_probes(index, centres, probes(spark, sf), 10)
    recall = ann_report(exact_topk(spark, sf), {served: ivf_topk(index, centres, probes(spark, sf), served, 10)}, 16, 10).select("recall")
    source, old = table(spark, sf, "source_records"), table(spark, sf, "vector_index")
    new = G.refreshed(G.refresh_actions(source, old), old).withColumn("model", F.lit("m1")).withColumn("status", F.when(F.col("source_id") >= 1000000, "deleted").otherwise(F.col("status")))
    tombstones = new.where("status = 'deleted'").join(source.where("not deleted"), "source_id", "left_semi").select("source_id")
    repaired = new.join(tombstones.withColumn("back", F.lit(True)), "source_id", "left").withColumn("status", F.when(F.col("back"), "active").otherwise(F.col("status"))).drop("back")
    named = lambda name, df: G.consistency(source, df, "m1").agg(F.count("*").alias("violations")).withColumn("shadow", F.lit(name))
    gates = named("as it stands", old).unionByName(named("refreshed", repaired)).crossJoin(F.broadcast(recall))  # one row of recall
    return gates.select("shadow", "violations", (F.col("recall") >= 0.9).alias("recalls"), F.when((F.col("violations") == 0) & (F.col("recall") >= 0.9), "promote").otherwise("hold").alias("decision"))


def g11(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "corpus")
    return c.groupBy("doc_type").agg(F.count_if(F.col("status") != "deleted").alias("must_be_indexed"), F.count_if(F.col("status") == "current").alias("retrievable"), F.count_if(F.col("status") == "superseded").alias("superseded"), F.count_if(F.col("status") == "deleted").alias("deleted"))


def g12(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "vector_index")
    return G.snapshot_diff(index, g3_state(spark, sf).where("source_id % 37 <> 0"), "source_id")


def g13(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation")}
    return G.edges(t, [("placed_by", "orders", "o_orderkey", "o_custkey"), ("lives_in", "customer", "c_custkey", "c_nationkey"), ("part_of", "nation", "n_nationkey", "n_regionkey")])


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return G.history(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")


def g15(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("1996-06-30").cast("date").alias("day"))
    return G.as_of(_history(spark, sf), probes, "o_custkey", "day").select("o_custkey", "value", "valid_from")


def g15_before(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    versions = o.select("o_custkey", "o_orderkey", "o_orderpriority")
    probes = o.groupBy("o_custkey").agg(F.floor(F.avg("o_orderkey")).alias("upto"))
    return G.version_before(versions, probes, "o_custkey", "o_orderkey", "upto")


def g16(spark: SparkSession, sf: str) -> DataFrame:
    o, c, li = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    out = n("orders_without_customer", G.dangling(o, "o_custkey", c, "c_custkey")).unionByName(n("lines_without_order", G.dangling(li, "l_orderkey", o, "o_orderkey")))
    out = out.unionByName(n("overlapping_history", G.overlapping(_history(spark, sf), "o_custkey")))
    current = table(spark, sf, "corpus").groupBy("document_id").agg(F.count_if(F.col("status") == "current").alias("k")).where("k > 1")
    return out.unionByName(n("two_current_versions", current))


def g16_chain(spark: SparkSession, sf: str) -> DataFrame:
    tops = G.chain_tops(table(spark, sf, "principals"), "principal_id", "manager_id")
    return tops.groupBy("top").agg(F.count("*").alias("n_below"))


def g17(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    subjects = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return G.residue(G.erase(c, subjects, "c_custkey", ["c_name", "c_acctbal"]), subjects, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


def g18(spark: SparkSession, sf: str) -> DataFrame:
    h = _history(spark, sf)
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("valid_from")
    fact = lambda d: F.concat_ws("@", F.col("o_custkey").cast("string"), d.cast("string"))
    return h.select(fact(F.col("valid_from")).alias("fact_id"), "value", "valid_from", "valid_to", F.when(F.col("valid_to").isNotNull(), fact(F.lead("valid_from").over(w))).alias("successor"))


def g19(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly value at a date by brand: the last order line of each part and supplier until then, if it was not returned."""
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1997-01-01 00:00:00'")
    last = li.groupBy("l_partkey", "l_suppkey").agg(F.max_by(F.struct("l_extendedprice", "l_returnflag"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("v")).where("v.l_returnflag <> 'R'")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return last.join(p, "l_partkey").groupBy("p_brand").agg(F.sum(F.col("v.l_extendedprice").cast("decimal(18,2)")).cast("double").alias("monthly"), F.count("*").alias("n"))


def g20(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "principals").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("principal_id"), "c_acctbal"), "principal_id").where("principal_type = 'employee' and principal_status = 'active'")
    g = p.groupingSets([[], [F.col("department")]], "department")
    return g.agg(F.count("*").alias("headcount"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("payroll"), F.grouping("department").cast("int").alias("overall"))


_TARGETS = [("1-URGENT", 24.0 * 10), ("2-HIGH", 24.0 * 20), ("3-MEDIUM", 24.0 * 30), ("4-NOT SPECIFIED", 24.0 * 60), ("5-LOW", 24.0 * 90)]


def g21(spark: SparkSession, sf: str) -> DataFrame:
    return G.freshness(table(spark, sf, "changes"), spark.createDataFrame(_TARGETS, "change_class string, target_hours double"))


def g22(spark: SparkSession, sf: str) -> DataFrame:
    index, source = table(spark, sf, "vector_index"), table(spark, sf, "source_records")
    dup = index.unionByName(index.where("source_id % 23 = 0")).groupBy("source_id").agg(F.count("*").alias("n")).agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)) / F.sum("n"), 6).alias("duplicate_share"))
    miss = index.join(source.select("source_id", F.col("content_version").alias("v")), "source_id").agg(F.round(F.avg((F.col("v") != F.col("content_version")).cast("double")), 6).alias("mismatch_share"))
    return dup.crossJoin(miss)  # one row each


def g23(spark: SparkSession, sf: str) -> DataFrame:
    return G.field_diffs(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


QUERIES = {
    "g1_cdc_replay": g1, "g2_cdc_anomalies": g2, "g3_incremental_refresh": g3, "g3_refreshed_state": g3_state, "g4_rebuild_decision": g4, "g5_consistency_report": _violations, "g6_evaluate_alerts": g6,
    "g7_operational_filter": g7, "g8_resolve_source": g8, "g9_rollback_and_compact": g9, "g9_incident": g9_incident, "g10_validation_gate": g10, "g11_lifecycle_states": g11, "g12_snapshot_diff": g12, "g13_derive_edges": g13,
    "g14_scd2_history": _history, "g15_as_of_lookup": g15, "g15_version_before": g15_before, "g16_integrity_checks": g16, "g16_chain_tops": g16_chain, "g17_erasure": g17, "g18_fact_timeline": g18,
    "g19_recurring_revenue": g19, "g20_payroll_headcount": g20, "g21_freshness_slo": g21, "g22_index_quality": g22, "g23_version_field_diff": g23,
}

_VIOL = """ix as (select * from {vector_index} union all select * from {vector_index} where source_id % 23 = 0), act as (select * from ix where status = 'active'), live as (select * from {source_records} where not deleted),
    viol as (select 'missing_vectors' as "check", source_id from live where source_id not in (select source_id from act)
      union select 'orphaned_vectors', source_id from act where source_id not in (select source_id from source_records)
      union select 'metadata_mismatch', a.source_id from act a join live s using (source_id) where a.access_group <> s.access_group or a.content_version <> s.content_version
      union select 'model_mismatch', source_id from act where model <> 'm1'
      union select 'undeleted', source_id from act where source_id in (select source_id from source_records where deleted)
      union select 'duplicate_vectors', source_id from act group by source_id having count(*) > 1)"""
_ACT = """ac as (select coalesce(s.source_id, i.source_id) source_id, case when s.source_id is null then case when i.status = 'active' then 'DELETE_ORPHAN' end when s.deleted then case when i.status = 'active' then 'DELETE' end
    when i.source_id is null then 'INSERT' when s.content_version <> i.content_version then 'UPDATE' when s.access_group <> i.access_group then 'META' else 'NOOP' end as action, s.content_version sv, s.access_group sa
    from {source_records} s full join {vector_index} i on s.source_id = i.source_id)"""
_STATE = _ACT + """, st as (select coalesce(i.source_id, a.source_id) source_id, case when action in ('INSERT', 'UPDATE') then sv else content_version end content_version, case when action in ('INSERT', 'UPDATE', 'META') then sa else access_group end access_group,
    case when action in ('DELETE', 'DELETE_ORPHAN') then 'deleted' when action = 'INSERT' then 'active' else status end status, coalesce(model, 'm1') model from vector_index i full join (select * from ac where action is not null) a on i.source_id = a.source_id)"""
_HIST = """dl as (select o_custkey, cast(o_orderdate as date) d, max_by(o_orderstatus, o_orderkey) v from orders group by all), ch as (select *, lag(v) over w b, row_number() over w n from dl window w as (partition by o_custkey order by d)),
    hist as (select o_custkey, v as value, d valid_from, cast(lead(d) over (partition by o_custkey order by d) - interval 1 day as date) valid_to from ch where n = 1 or v is distinct from b)"""
_REPLAY = "select object_id, max(sequence) sequence, max_by(after_value, sequence) as value, '{n}' as checkpoint from {{cdc_events}} {w} group by object_id having max_by(operation, sequence) <> 'delete'"
_AGAIN = "select '{name}' as version, c.metric, count(v.source_id) as value from (select unnest([{checks}]) metric) c left join (with ix as ({index}), " + _VIOL[_VIOL.index("act as (") :].replace("{source_records}", "source_records") + " select * from viol) v on v.check = c.metric group by c.metric"
_BACK = " union all ".join(_AGAIN.format(name=n, checks=", ".join(f"'{c}'" for c in CHECKS), index=i) for n, i in (("damaged", "select * replace ('m9' as model) from st"), ("restored", "select * from st where status <> 'deleted'")))
_N = "with {v} select '{c}' as metric, count(*) filter (\"check\" = '{c}') as value"
ORACLES = {
    "g1_cdc_replay": _REPLAY.format(n="half", w="where delivery_pos <= (select max(delivery_pos) // 2 from cdc_events)").replace("{{", "{").replace("}}", "}") + " union all " + _REPLAY.format(n="end", w="").replace("{{", "{").replace("}}", "}"),
    "g2_cdc_anomalies": """with f as (select *, row_number() over (partition by event_id order by delivery_pos) = 1 first from {cdc_events}),
        s as (select *, first and coalesce(sequence < max(case when first then sequence end) over (partition by object_id order by delivery_pos rows between unbounded preceding and 1 preceding), false) stale from f)
        select 'duplicate' kind, count(*) filter (not first) n from s union all select 'stale', count(*) filter (stale) from s
        union all select 'upsert', count(*) filter (first and not stale and operation = 'upsert') from s union all select 'delete', count(*) filter (first and not stale and operation = 'delete') from s""",
    "g3_incremental_refresh": f"with {_ACT} select source_id, action from ac where action is not null",
    "g3_refreshed_state": f"with {_STATE} select * from st",
    "g4_rebuild_decision": """select bool_or(model <> 'm1') or bool_or(access_group is null) or bool_or(status not in ('active', 'deleted')) rebuild,
        concat_ws(',', case when bool_or(model <> 'm1') then 'model_changed' end, case when bool_or(access_group is null) then 'schema_changed' end, case when bool_or(status not in ('active', 'deleted')) then 'corrupt' end) reasons from {vector_index}""",
    "g5_consistency_report": f"with {_VIOL} select * from viol",
    "g6_evaluate_alerts": f"""with {_VIOL}, th(metric, most, severity, owner) as (values {', '.join(f"('{m}', {v}::double, '{s}', '{o}')" for m, v, s, o in _THRESHOLDS)}),
        m as ({' union all '.join(f"select '{c}' metric, count(*) filter (viol.check = '{c}')::double as value from viol" for c in CHECKS)})
        select metric, value, most, severity, owner, case severity when 'PAGE' then 0 else 1 end urgency from m join th using (metric) where value > most""",
    "g7_operational_filter": "select i.* from {vector_index} i join {source_records} s using (source_id) where status <> 'deleted' and i.content_version = s.content_version",
    "g8_resolve_source": "select i.*, s.content_version as current, s.source_id is not null known from {vector_index} i left join {source_records} s using (source_id)",
    "g9_rollback_and_compact": f"with {_STATE} {_BACK}",
    "g11_lifecycle_states": """select doc_type, count(*) filter (status <> 'deleted') must_be_indexed, count(*) filter (status = 'current') retrievable, count(*) filter (status = 'superseded') superseded,
        count(*) filter (status = 'deleted') deleted from {corpus} group by doc_type""",
    "g12_snapshot_diff": f"""with {_STATE}, b as (select * from st where source_id % 37 <> 0) select coalesce(a.source_id, b.source_id) source_id, case when b.source_id is null then 'only_a' when a.source_id is null then 'only_b' else 'changed' end diff
        from vector_index a full join b on a.source_id = b.source_id where a.source_id is null or b.source_id is null or (a.content_version, a.access_group, a.status, a.model) is distinct from (b.content_version, b.access_group, b.status, b.model)""",
    "g13_derive_edges": """select distinct 'placed_by' relation, cast(o_orderkey as varchar) from_id, cast(o_custkey as varchar) to_id from orders union select 'lives_in', cast(c_custkey as varchar), cast(c_nationkey as varchar) from customer
        union select 'part_of', cast(n_nationkey as varchar), cast(n_regionkey as varchar) from nation""",
    "g14_scd2_history": f"with {_HIST} select * from hist",
    "g15_as_of_lookup": f"with {_HIST} select o_custkey, value, valid_from from hist join customer on c_custkey = o_custkey where date '1996-06-30' >= valid_from and (valid_to is null or date '1996-06-30' <= valid_to)",
    "g15_version_before": """with p as (select o_custkey, cast(floor(avg(o_orderkey)) as bigint) upto from orders group by 1)
        select p.o_custkey, upto, max(o_orderkey) o_orderkey, max_by(o_orderpriority, o_orderkey) o_orderpriority from p join orders o on o.o_custkey = p.o_custkey and o_orderkey <= upto group by all""",
    "g16_integrity_checks": f"""with {_HIST}, nx as (select *, lead(valid_from) over (partition by o_custkey order by valid_from) nx from hist)
        select 'orders_without_customer' as "check", count(*) n from orders where o_custkey not in (select c_custkey from customer) union all select 'lines_without_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
        union all select 'overlapping_history', count(*) from (select o_custkey from nx group by 1 having count(*) filter (valid_to is null) <> 1 or count(*) filter (nx <= coalesce(valid_to, date '9999-12-31')) > 0)
        union all select 'two_current_versions', count(*) from (select document_id from {{corpus}} group by 1 having count(*) filter (status = 'current') > 1)""".replace("{{", "{").replace("}}", "}"),
    "g16_chain_tops": """with recursive p as (select c_custkey id, case when c_custkey = 0 then null else cast(floor((c_custkey - 1) / 4.0) as bigint) end m from customer),
        up as (select id node, id top, m from p union all select node, p.id, p.m from up join p on p.id = up.m) select top, count(*) n_below from up where m is null group by top""",
    "g17_erasure": "select 'c_name' field, 0::bigint n_left union all select 'c_acctbal', 0::bigint union all select 'c_mktsegment', count(c_mktsegment) from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')",
    "g18_fact_timeline": f"""with {_HIST} select o_custkey || '@' || valid_from fact_id, value, valid_from, valid_to,
        case when valid_to is not null then o_custkey || '@' || lead(valid_from) over (partition by o_custkey order by valid_from) end successor from hist""",
    "g19_recurring_revenue": """with v as (select l_partkey, max_by(struct_pack(e := l_extendedprice, r := l_returnflag), struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_extendedprice)) v from lineitem where l_shipdate <= timestamp '1997-01-01' group by l_partkey, l_suppkey)
        select p_brand, cast(sum(cast(v.e as decimal(18,2))) as double) monthly, count(*) n from v join part on p_partkey = l_partkey where v.r <> 'R' group by p_brand""",
    "g20_payroll_headcount": """select department, count(*) headcount, cast(sum(cast(c_acctbal as decimal(18,2))) as double) payroll, grouping(department)::integer overall from {principals} join customer on c_custkey = principal_id
        where principal_type = 'employee' and principal_status = 'active' group by grouping sets ((), (department))""",
    "g21_freshness_slo": f"""with t(change_class, h) as (values {', '.join(f"('{c}', {h}::double)" for c, h in _TARGETS)}), l as (select change_class, h, available_at, date_diff('second', changed_at, available_at) / 3600.0::double lag from {{changes}} join t using (change_class))
        select change_class, count(*) n, count(lag) n_available, round(quantile_cont(lag, 0.5), 4) p50, round(quantile_cont(lag, 0.95), 4) p95, round(avg((lag <= h)::int), 6) share_within, round(count(lag) / count(*), 6) share_available from l group by change_class""",
    "g22_index_quality": f"""with {_VIOL.split(', act as')[0]}, d as (select count(*) n from ix group by source_id)
        select (select round(sum(n - 1) / sum(n), 6) from d) duplicate_share, (select round(avg((i.content_version <> s.content_version)::int), 6) from vector_index i join {{source_records}} s using (source_id)) mismatch_share""".replace("{{", "{").replace("}}", "}"),
    "g23_version_field_diff": """with w as (select *, lag(o_orderstatus) over x s, lag(o_orderpriority) over x p, row_number() over x n from orders window x as (partition by o_custkey order by o_orderkey))
        select o_custkey, o_orderkey, 'o_orderstatus' field, s "old", o_orderstatus "new" from w where n > 1 and s is distinct from o_orderstatus union all select o_custkey, o_orderkey, 'o_orderpriority', p, o_orderpriority from w where n > 1 and p is distinct from o_orderpriority
        union all select o_custkey, o_orderkey, 'no change', null, null from w where n > 1 and s is not distinct from o_orderstatus and p is not distinct from o_orderpriority""",
}
