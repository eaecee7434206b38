"""Preference formatting: one prompt and two masked completions of each pair.

The prompt of a pair is the longest common prefix of turns of its chosen and rejected
conversation, rendered once. What follows in each is its completion, with a mask of one
digit per character: 1 where a model learns (what an assistant says, with the end mark),
0 elsewhere. Turns are equal when role and text are.

Turns are ordered by turn number, then role, then text; nulls come first, repeated rows
count once, and null roles and texts are empty. Turns without a conversation id are left
out. A completion is empty when its conversation is a prefix of the other one. A
conversation is one value of one row, as its rendered text has to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentspark.llm.catalog import query, table
from sentspark.operators.order import with_ordinals
from sentspark.session import ship_package
from sentspark.storage import materialise

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
LEARNT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (role, text) in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(row)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda x: _turn(x["role"], x["text"])))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def replaced_replies(talks: DataFrame) -> DataFrame:
    """Pairs: a conversation up to its last reply, and the same with the next one's last reply.

    ``conv_id`` names the pair. A conversation without a reply, or whose successor (by id)
    has none, makes no pair.
    """
    ended = _ended(talks)
    reply = F.get("turns", F.col("last"))["text"]
    next_reply = ended.select((F.col("conv_id") - 1).alias("conv_id"), reply.alias("other"))
    return _pairs(ended, next_reply)


def next_replies(talks: DataFrame) -> DataFrame:
    """``replaced_replies`` with the next conversation that has a reply, in the order of ids.

    The first one follows the last, so every conversation with a reply makes a pair, unless
    it is the only one. Replies are numbered in range partitions, without a window over all.
    """
    ended = _ended(talks)
    replies = with_ordinals(ended.select("conv_id", F.get("turns", F.col("last"))["text"].alias("other")), ["conv_id"])
    replies = materialise(replies, "preference-replies")
    n = replies.count()
    if n < 2:
        return _pairs(ended.limit(0), replies.select("conv_id", "other"))
    before = replies.select(F.pmod(F.col("pos") - 1, F.lit(n)).alias("pos"), "other")
    return _pairs(ended, replies.select("conv_id", "pos").join(before, "pos").select("conv_id", "other"))


def replaced_turns(talks: DataFrame) -> DataFrame:
    """Pairs: a whole conversation, and the same with one reply replaced by the last reply of the
    next conversation that has one (the first one's after the last).

    The replaced reply is the one at the remainder of ``conv_id`` by the number of replies, so pairs
    part early and late; the turns after it are kept on both sides. Every conversation with
    a reply makes a pair, unless it is the only one. Conversations are numbered in range
    partitions, without a window over all.
    """
    places = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == LEARNT, i)), lambda i: i.isNotNull())
    ended = talks.withColumn("places", places).filter(F.size("places") > 0)
    last = F.get("turns", F.element_at("places", -1))["text"]
    replies = materialise(with_ordinals(ended.select("conv_id", last.alias("other")), ["conv_id"]), "preference-replies")
    n = replies.count()
    if n < 2:
        return _pairs(_ended(talks).limit(0), replies.select("conv_id", "other"))
    before = replies.select(F.pmod(F.col("pos") - 1, F.lit(n)).alias("pos"), "other")
    following = replies.select("conv_id", "pos").join(before, "pos").select("conv_id", "other")
    at = F.get("places", F.pmod("conv_id", F.size("places")).cast("int"))
    joined = ended.withColumn("at", at).join(following, "conv_id")
    rejected = F.transform(
        "turns", lambda x, i: F.when(i == F.col("at"), _turn(F.lit(LEARNT), F.col("other"))).otherwise(x)
    )
    return joined.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def _ended(talks: DataFrame) -> DataFrame:
    """Conversations with a reply, and the place of the last one."""
    at = F.array_max(F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == LEARNT, i)), lambda i: i.isNotNull()))
    return talks.withColumn("last", at).filter("last is not null")


def _pairs(ended: DataFrame, replies: DataFrame) -> DataFrame:
    other = F.array(_turn(F.lit(LEARNT), F.col("other")))
    return ended.join(replies, "conv_id").select(
        "conv_id",
        F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last")), other).alias("rejected"),
    )


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _rendered(turns: Column) -> Column:
    return _joined(
        F.transform(turns, lambda x: F.concat(F.lit(START), x["role"], F.lit(MIDDLE), x["text"], F.lit(END)))
    )


def _mask(turns: Column) -> Column:
    def one(x: Column) -> Column:
        head = F.char_length(x["role"]) + len(START) + len(MIDDLE)
        body = F.char_length(x["text"]) + len(END)
        return F.concat(
            F.repeat(F.lit("0"), head), F.when(x["role"] == LEARNT, F.repeat(F.lit("1"), body)).otherwise(F.repeat(F.lit("0"), body))
        )

    return _joined(F.transform(turns, one))


def preference_examples(pairs: DataFrame, id: str = "conv_id") -> DataFrame:
    """Examples of pairs of ``chosen`` and ``rejected`` arrays of (role, text)."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.filter(
        F.transform("chosen", lambda x, i: F.when(~x.eqNullSafe(F.get("rejected", i)), i)), lambda i: i.isNotNull()
    )
    common = pairs.withColumn("n", F.coalesce(F.array_min(differ), shorter))
    common = common.withColumn("n", F.least("n", shorter))
    rest = {x: F.slice(x, F.col("n") + 1, F.size(x)) for x in ("chosen", "rejected")}
    return common.select(
        id,
        F.col("n").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        *(_rendered(rest[x]).alias(x) for x in rest),
        *(_mask(rest[x]).alias(f"{x}_mask") for x in rest),
    )


def _oracle() -> str:
    def render(x: str) -> str:
        return f"coalesce(array_to_string(list_transform({x}, lambda t: '{START}' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"

    def mask(x: str) -> str:
        head, body = len(START) + len(MIDDLE), len(END)
        one = f"repeat('0', length(t.role) + {head}) || repeat(case when t.role = '{LEARNT}' then '1' else '0' end, length(t.text) + {body})"
        return f"coalesce(array_to_string(list_transform({x}, lambda t: {one}), ''), '')"

    return f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from t),
l as (select conv_id, list(i order by i) as places from o where role = '{LEARNT}' group by conv_id),
r as (select o.conv_id, text as reply from o join l on o.conv_id = l.conv_id and i = places[-1]),
x as (select conv_id, coalesce(lead(reply) over w, first_value(reply) over w) as other, count(*) over () as n
  from r window w as (order by conv_id)),
p as (select o.conv_id,
    list({{'role': role, 'text': text}} order by i) as chosen,
    list({{'role': role, 'text': case when i = places[(o.conv_id % len(places) + len(places)) % len(places) + 1] then other else text end}}
      order by i) as rejected
  from o join l on o.conv_id = l.conv_id join x on x.conv_id = o.conv_id where x.n > 1 group by o.conv_id),
c as (select *, coalesce(list_filter(range(1, len(chosen) + 1), lambda i: chosen[i] <> rejected[i])[1] - 1, len(chosen)) as n from p)
select conv_id, cast(n as bigint) as n_prompt_turns, {render('chosen[1:n]')} as prompt,
  {render('chosen[n + 1:]')} as chosen, {render('rejected[n + 1:]')} as rejected,
  {mask('chosen[n + 1:]')} as chosen_mask, {mask('rejected[n + 1:]')} as rejected_mask
from c"""


@query("op2_preference_format", _oracle())
def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return preference_examples(replaced_turns(conversations(table(spark, sf_dir, "conversations"))))
