"""Preference formatting of chat conversations (DataFrame functions only).

Chosen and rejected conversations of a pair are compared turn by turn; the
longest common prefix of turns is rendered once as the prompt, the rest of
either as its completion, in which only assistant text is trained on.

Defined cases: turns with a null conv_id belong to no pair and are left out;
a null turn number sorts first, a null role or text counts as the empty string;
repeated turn numbers are ordered by role, then text; a pair without one side
keeps its row, with an empty prompt, null for that side and paired = false;
equal conversations have an empty completion each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BREAK), t["text"], F.lit(CLOSE))), "")


def _mask(turns: Column, trained_role: str) -> Column:
    """start:end (code points, end exclusive) of what is trained on, comma-joined: the text and the closing mark of trained turns."""
    fixed = len(OPEN) + len(BREAK)
    head = lambda t: F.char_length(t["role"]) + fixed
    whole = lambda t: head(t) + F.char_length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, t: F.struct(
        (acc["at"] + whole(t)).alias("at"),
        F.when(t["role"] == trained_role, F.array_append(acc["out"], F.concat_ws(":", acc["at"] + head(t), acc["at"] + whole(t)))).otherwise(acc["out"]).alias("out"),
    )
    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["out"]), ",")


def format_preferences(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """turns: pair_id, side ('chosen' or 'rejected'), turn, role, text. One row per pair.

    The turns of a pair meet in one row, as its output does; one aggregation by
    pair_id is the only shuffle.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    got = turns.where("pair_id is not null").groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, one))).alias(s) for s in ("chosen", "rejected")))
    same = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: F.coalesce((z["chosen"]["role"] == z["rejected"]["role"]) & (z["chosen"]["text"] == z["rejected"]["text"]), F.lit(False)))
    got = got.withColumn("paired", (F.size("chosen") > 0) & (F.size("rejected") > 0))
    got = got.withColumn("_differ", F.array_position(same, False).cast("int"))
    got = got.withColumn("prefix_turns", F.when(~F.col("paired"), 0).when(F.col("_differ") > 0, F.col("_differ") - 1).otherwise(F.size("chosen")))
    rest = lambda s: F.when(F.size(s) > 0, F.slice(s, F.col("prefix_turns") + 1, F.size(s)))
    return got.withColumns({"_c": rest("chosen"), "_r": rest("rejected")}).select(
        "pair_id",
        "paired",
        F.col("prefix_turns").cast("long").alias("prefix_turns"),
        _render(F.slice("chosen", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        _render(F.col("_c")).alias("chosen"),
        _render(F.col("_r")).alias("rejected"),
        _mask(F.col("_c"), trained_role).alias("chosen_mask"),
        _mask(F.col("_r"), trained_role).alias("rejected_mask"),
    )


def op1_chat_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table: of ids 2k and 2k + 1 the even one counts as chosen, the odd one as rejected."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pair = F.expr("(conv_id - pmod(conv_id, 2)) div 2")
    return format_preferences(c.select(pair.alias("pair_id"), F.when(F.expr("pmod(conv_id, 2) = 0"), "chosen").otherwise("rejected").alias("side"), "turn", "role", "text"))


OP1_SQL = """
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
both_sides as (
  select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.k, r.k) as k,
         c.k is not null and r.k is not null and c.role = r.role and c.text = r.text as same
  from (select * from t where side = 0) c full join (select * from t where side = 1) r on c.pair_id = r.pair_id and c.k = r.k),
pairs as (
  select pair_id, count(distinct side) = 2 as paired, max(k) as longest from t group by 1),
prefix as (
  select p.pair_id, p.paired,
         case when p.paired then coalesce(min(case when not b.same then b.k end) - 1, max(p.longest)) else 0 end as n
  from pairs p join both_sides b on p.pair_id = b.pair_id group by p.pair_id, p.paired),
turns as (
  select t.*, p.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as shown,
         case when k > p.n then 1 else 0 end as late,
         length(role) + 13 as head
  from t join prefix p on t.pair_id = p.pair_id),
placed as (
  select *, sum(length(shown)) over (partition by pair_id, side, late order by k) - length(shown) as pos from turns),
sides as (
  select pair_id, side, string_agg(case when late = 0 then shown end, '' order by k) as prompt,
         coalesce(string_agg(case when late = 1 then shown end, '' order by k), '') as body,
         coalesce(string_agg(case when late = 1 and role = 'assistant' then (pos + head) || ':' || (pos + length(shown)) end, ',' order by k), '') as mask
  from placed group by 1, 2)
select p.pair_id, p.paired, cast(p.n as bigint) as prefix_turns, coalesce(c.prompt, '') as prompt,
       c.body as chosen, r.body as rejected, c.mask as chosen_mask, r.mask as rejected_mask
from prefix p left join (select * from sides where side = 0) c on p.pair_id = c.pair_id
left join (select * from sides where side = 1) r on p.pair_id = r.pair_id
"""
