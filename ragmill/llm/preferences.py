"""Preference pairs from conversations: the common prompt once, and two masked completions.

Method, all in DataFrame functions: the turns of a pair's chosen and rejected conversation meet by (pair, turn); the first
turn at which they differ (in role or text, or by one being over) ends the longest common prefix. Turns before it are
rendered once as prompt, the rest as completion of either side. Tokens of assistant turns of a completion are
trained on, all else is masked. Aggregates are keyed by (pair, turn) or are partial minima, so a very long conversation
isn't gathered before `assembled` makes one row for each pair: the prompt once, both completions, and the character ranges of each that are trained on.
A row holds its conversation, as a document's row holds its text.

Defined cases: null role is user, null text is empty; null pair or turn takes no part. Of repeated rows of a turn the one whose
(role, text) sorts last stands. A pair that lacks one side is left out. Equal conversations are all prompt. Turn numbers give
the order; gaps don't matter. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.operators.curate import seeded_rank


def _turns(df: DataFrame, key: str, side: int) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col("turn").isNotNull()).select(
        F.col(key).cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.lit(side).alias("side"),
        F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )


def segments(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, role, segment (rendered text) and train (whether it is trained on)."""
    both = _turns(chosen, key, 0).unionByName(_turns(rejected, key, 1))
    met = both.groupBy("pair_id", "turn").agg(F.max(F.when(F.col("side") == 0, F.col("said"))).alias("c"), F.max(F.when(F.col("side") == 1, F.col("said"))).alias("r"))
    met = met.withColumn("differs", ~F.col("c").eqNullSafe(F.col("r")))
    prefix = met.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("first"), F.count("c").alias("nc"), F.count("r").alias("nr")).where("nc > 0 and nr > 0")
    joined = met.join(prefix.select("pair_id", "first"), "pair_id")
    shared = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    part = lambda name, said: F.struct(F.lit(name).alias("part"), F.col(said).alias("said"))
    rows = joined.select("pair_id", "turn", F.explode(F.when(shared, F.array(part("prompt", "c"))).otherwise(F.array(part("chosen", "c"), part("rejected", "r")))).alias("x")).where("x.said is not null")
    role = F.col("x.said.role")
    text = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("x.said.text"), F.lit("<|end|>\n"))
    return rows.select("pair_id", F.col("x.part").alias("part"), "turn", role.alias("role"), text.alias("segment"), ((F.col("x.part") != "prompt") & (role == "assistant")).alias("train"))


def assembled(rows: DataFrame) -> DataFrame:
    """One row for each pair: prompt, chosen, rejected and the trained character ranges (from, to) of either completion."""

    def part(name: str) -> list:
        items = F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "segment", "train"))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))
        walk = F.aggregate(items, start, lambda a, x: F.struct((a["at"] + F.length(x["segment"])).alias("at"), F.when(x["train"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("from"), (a["at"] + F.length(x["segment"])).alias("to"))))).otherwise(a["spans"]).alias("spans")))
        return [F.array_join(F.transform(items, lambda x: x["segment"]), "").alias(name), walk["spans"].alias(f"{name}_train")]

    prompt = part("prompt")[0]
    return rows.groupBy("pair_id").agg(prompt, *part("chosen"), *part("rejected"))


def ranges(spans: Column) -> Column:
    """Character ranges as text, from-to and from-to."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws("-", x["from"], x["to"])), ",")


def negatives(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations (key conv_id).

    A rejected one ends with one of the conversation's assistant turns, of which its id decides which (its last turn, if it has none). There the
    last assistant text (or last text) of another conversation stands, the next one in a seeded order of ids, the first behind the last. So every conversation
    has a pair, unless it is the only one.
    """
    whole = conversations.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("s"),
    ).groupBy("conv_id", "turn").agg(F.max("s").alias("s")).select("conv_id", "turn", "s.role", "s.text")
    spoken = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    last = whole.groupBy("conv_id").agg(F.max("turn").alias("end"), F.coalesce(F.max(spoken), F.max(F.struct("turn", "text"))).getField("text").alias("own"), F.count(spoken).alias("n"))
    order = seeded_rank(last.select("conv_id", "own"), "conv_id", "negatives")
    other = order.select(F.when(F.col("rank") == 1, F.col("_all")).otherwise(F.col("rank") - 1).alias("rank"), F.col("own").alias("other"))
    paired = order.where("_all > 1").select("conv_id", "rank").join(other, "rank").select("conv_id", "other")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    asked = last.select("conv_id", (F.pmod("conv_id", F.greatest("n", F.lit(1))) + 1).alias("k"))
    place = whole.where("role = 'assistant'").select("conv_id", "turn", nth.alias("k")).join(asked, ["conv_id", "k"]).select("conv_id", F.col("turn").alias("place"))
    ends = last.join(place, "conv_id", "left").select("conv_id", F.coalesce("place", "end").alias("place")).join(paired, "conv_id")
    rows = whole.join(ends, "conv_id")
    swapped = rows.where("turn <= place").withColumn("text", F.when(F.col("turn") == F.col("place"), F.col("other")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", "role", "text"), swapped.select("conv_id", "turn", "role", "text")


ORACLE = """
with w as (select conv_id, turn, max(struct_pack(role := coalesce(role, 'user'), text := coalesce(text, ''))) s from conversations where conv_id is not null and turn is not null group by all),
a as (select conv_id, turn, s.text t, row_number() over (partition by conv_id order by turn) k, count(*) over (partition by conv_id) n from w where s.role = 'assistant'),
l as (select conv_id, max(turn) e, arg_max(s.text, turn) t from w group by conv_id),
la as (select conv_id, arg_max(t, turn) t from a group by conv_id),
c as (select l.conv_id, coalesce(p.turn, l.e) e, coalesce(la.t, l.t) own from l left join la on la.conv_id = l.conv_id left join a p on p.conv_id = l.conv_id and p.k = 1 + l.conv_id % p.n),
o as (select *, row_number() over (order by md5('negatives' || conv_id), conv_id) r, count(*) over () n from c),
x as (select o.conv_id, o.e, z.own other from o join o z on z.r = o.r % o.n + 1 where o.n > 1),
b as (select conv_id, turn, s.role as role, s.text t, 'chosen' side from w join x using (conv_id)
      union all select conv_id, turn, s.role, case when turn = e then other else s.text end, 'rejected' from w join x using (conv_id) where turn <= e),
d as (select conv_id, turn, count(*) m, count(distinct role || chr(1) || t) v from b group by all),
f as (select conv_id, min(turn) filter (m < 2 or v > 1) first from d group by conv_id),
g as (select conv_id, turn, case when first is null or turn < first then 'prompt' else side end part, '<|' || role || '|>' || chr(10) || t || '<|end|>' || chr(10) seg, role = 'assistant' spoken
      from b join f using (conv_id) where side = 'chosen' or turn >= first),
p as (select *, sum(length(seg)) over (partition by conv_id, part order by turn) hi from g)
select conv_id pair_id, coalesce(string_agg(seg, '' order by turn) filter (part = 'prompt'), '') prompt, coalesce(string_agg(seg, '' order by turn) filter (part = 'chosen'), '') chosen,
  coalesce(string_agg(seg, '' order by turn) filter (part = 'rejected'), '') rejected,
  coalesce(string_agg((hi - length(seg))::bigint || '-' || hi::bigint, ',' order by turn) filter (part = 'chosen' and spoken), '') chosen_train,
  coalesce(string_agg((hi - length(seg))::bigint || '-' || hi::bigint, ',' order by turn) filter (part = 'rejected' and spoken), '') rejected_train
from p group by conv_id
"""
