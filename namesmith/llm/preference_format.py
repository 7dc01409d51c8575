"""Preference formatting: the shared turns once as prompt, then two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: the rendered form of a turn
OPEN, AFTER_ROLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def conversation_turns(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` in order of turn, ties by role and text."""
    return turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )


def repeated_reply_pairs(conversations: DataFrame) -> DataFrame:
    """A ``chosen`` and a ``rejected`` form of each conversation.

    Chosen are the turns up to the last assistant turn; rejected the same turns with that
    reply replaced by the conversation's first reply, or by nothing where it is the only
    one: an answer that does not go into the last question. Without an assistant turn both
    forms are the whole conversation.
    """
    by_role = F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")))
    first = F.array_position(by_role, TRAINED_ROLE)
    last = F.size("turns") + 1 - F.array_position(F.reverse(by_role), TRAINED_ROLE)
    replaced = F.when(first < last, F.element_at("turns", F.greatest(first, F.lit(1)).cast("int"))
                      ["text"]).otherwise(F.lit(""))
    reply = F.element_at("turns", last.cast("int"))
    some = first > 0
    return conversations.select(
        F.col("conv_id").alias("pair_id"),
        F.when(some, F.slice("turns", F.lit(1), last.cast("int")))
        .otherwise(F.col("turns")).alias("chosen"),
        F.when(some, F.concat(
            F.slice("turns", F.lit(1), (last - 1).cast("int")),
            F.array(F.struct(reply["turn"].alias("turn"), reply["role"].alias("role"),
                             replaced.alias("text"))),
        )).otherwise(F.col("turns")).alias("rejected"),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"])
                      & x["text"].eqNullSafe(y["text"]))
    upto = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.slice(same, F.lit(1), upto), False)
    return F.when(differs > 0, differs - 1).otherwise(upto).cast("int")


def _plain(text: Column) -> Column:
    """A turn's own text can hold no marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(turn["role"]), F.lit(AFTER_ROLE))


def rendered(turns: Column) -> Column:
    """The turns as one string; nulls are empty."""
    return F.array_join(F.transform(
        turns, lambda t: F.concat(_head(t), _plain(t["text"]), F.lit(CLOSE))), "")


def trained_spans(turns: Column) -> Column:
    """Start and end, in characters of ``rendered(turns)``, of what a loss may see.

    That is each assistant turn's text and closing marker; heads and other roles are masked.
    """
    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t))
        end = start + F.length(_plain(t["text"])) + len(CLOSE)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], own))
        return F.struct(end.alias("at"), F.coalesce(spans, state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(turns, empty, step)["spans"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, rejected`` and both completions' spans.

    ``pairs`` has ``pair_id`` and the turn lists ``chosen`` and ``rejected`` of
    ``turn, role, text``. The longest common prefix of turns (role and text) is rendered
    once as ``prompt``; the completions hold what follows. Null lists are empty, equal
    lists leave empty completions, null roles and texts are rendered empty, repeated pairs
    give a row each, and other columns are not read.
    """
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    lists = pairs.select("pair_id", F.coalesce("chosen", none).alias("_a"),
                         F.coalesce("rejected", none).alias("_b"))
    cut = lists.withColumn("n_prompt_turns", common_prefix(F.col("_a"), F.col("_b")))
    n = F.col("n_prompt_turns")
    parts = cut.select(
        "pair_id", "n_prompt_turns", F.slice("_a", F.lit(1), n).alias("_p"),
        F.slice("_a", n + 1, F.greatest(F.size("_a") - n, F.lit(0))).alias("_c"),
        F.slice("_b", n + 1, F.greatest(F.size("_b") - n, F.lit(0))).alias("_r"),
    )
    return parts.select(
        "pair_id", "n_prompt_turns", rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_c")).alias("chosen"), rendered(F.col("_r")).alias("rejected"),
        trained_spans(F.col("_c")).alias("chosen_spans"),
        trained_spans(F.col("_r")).alias("rejected_spans"),
    )


def span_text(spans: Column) -> Column:
    """Spans as ``start:end`` texts, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(
        s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def preferences_of(conversations: DataFrame) -> DataFrame:
    """The operator over a turn table, spans as texts."""
    pairs = repeated_reply_pairs(conversation_turns(conversations))
    return (
        format_preferences(pairs).withColumnRenamed("pair_id", "conv_id")
        .withColumn("chosen_spans", span_text(F.col("chosen_spans")))
        .withColumn("rejected_spans", span_text(F.col("rejected_spans")))
    )


def oracle() -> str:
    """The same result in DuckDB's SQL, turn by turn."""
    plain = "replace(coalesce({}, ''), '<|', '< |')"
    head = f"'{OPEN}' || {plain.format('role')} || chr(10)"
    whole = f"{head} || {plain.format('said')} || '<|im_end|>' || chr(10)"
    return f"""
with t as (
 select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as i
 from conversations),
c as (select conv_id, count(*) as n, max(case when role = '{TRAINED_ROLE}' then i end) as last,
 min(case when role = '{TRAINED_ROLE}' then i end) as first from t group by conv_id),
x as (
 select t.conv_id, i, role, text as a, case when i = last then
   case when first < last then (select f.text from t f where f.conv_id = t.conv_id and f.i = first)
   else '' end else text end as b
 from t join c on c.conv_id is not distinct from t.conv_id where last is null or i <= last),
p as (select conv_id, coalesce(min(case when a is distinct from b then i end) - 1, count(*)) as n
 from x group by conv_id),
both_sides as (
 select x.conv_id, i, role, case when i <= n then 'p' else 'c' end as part, a as said
 from x join p on p.conv_id is not distinct from x.conv_id
 union all select x.conv_id, i, role, 'r', b
 from x join p on p.conv_id is not distinct from x.conv_id where i > n),
made as (select *, {whole} as piece, length({head}) as lead from both_sides),
placed as (select *, coalesce(sum(length(piece)) over (partition by conv_id, part order by i
 rows between unbounded preceding and 1 preceding), 0) as pos from made),
joined as (
 select conv_id, part, string_agg(piece, '' order by i) as s,
  coalesce(string_agg(case when role = '{TRAINED_ROLE}' then
   (pos + lead)::bigint || ':' || (pos + length(piece))::bigint end, ',' order by i), '') as spans
 from placed group by conv_id, part)
select p.conv_id, p.n::int as n_prompt_turns, coalesce(q.s, '') as prompt,
 coalesce(a.s, '') as chosen, coalesce(b.s, '') as rejected,
 coalesce(a.spans, '') as chosen_spans, coalesce(b.spans, '') as rejected_spans
from p
left join joined q on q.conv_id is not distinct from p.conv_id and q.part = 'p'
left join joined a on a.conv_id is not distinct from p.conv_id and a.part = 'c'
left join joined b on b.conv_id is not distinct from p.conv_id and b.part = 'r'
"""
