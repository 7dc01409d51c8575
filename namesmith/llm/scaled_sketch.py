"""Document fingerprints: every shingle hash below a fixed share of the hash space.

The share is fixed and the hashes are kept whatever the text's length, so sketches of any two
texts can be compared, merged by union, and a short text found within a long one. A text none
of whose hashes is low enough keeps its least one: two such texts share it as often as their
least hashes agree.

Defined results: a null text is empty, and an empty text has no shingles; two fingerprints
without shingles have likeness 1, one with and one without 0. Rows with equal ids and texts
are copies of one another and stand next to each other in the order; texts that share an id
come in order of their digests, null ids last. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import number_rows
from ..storage import stage

#: words of a shingle, and one in how many hashes is kept
SHINGLE, SCALE = 5, 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"
#: hexadecimal digits of a hash, which a long holds
_DIGITS = 15


def limit(scale: int) -> str:
    """The hash that is the first not to be kept, in hexadecimal."""
    return f"{-(-(1 << 4 * _DIGITS) // scale):0{_DIGITS}x}" if scale > 1 else "g"


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """A hash for each run of ``n`` words; of fewer words, of all of them together."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))

    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - (n - 1), F.lit(1))
        return F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, n), " ")), 1, _DIGITS))

    # the words are made once and read by every step of the inner function
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(
        F.array().cast("array<string>"))), F.lit(0))


def sketch(text: Column, n: int = SHINGLE, scale: int = SCALE) -> Column:
    """Distinct shingle hashes below the limit, in order; else the least one."""
    low = F.lit(limit(scale))

    def kept(hashes: Column) -> Column:
        below = F.array_distinct(F.filter(hashes, lambda h: h < low))
        some = F.when(F.exists(hashes, lambda h: h < low), below).otherwise(
            F.filter(F.array(F.array_min(hashes)), lambda h: h.isNotNull()))
        return F.array_sort(F.transform(some, _number))

    return F.get(F.transform(F.array(shingle_hashes(text, n)), kept), F.lit(0))


def merge_sketches(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: h < F.lit(-(-(1 << 4 * _DIGITS) // scale)))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller text's shingles that the other has too."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / least
    return F.when(F.greatest(F.size(a), F.size(b)) == 0, F.lit(1.0)).when(
        least == 0, F.lit(0.0)).otherwise(shared)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of all shingles of both texts that both have."""
    either = F.size(F.array_union(a, b))
    shared = F.size(F.array_intersect(a, b)) / either
    return F.when(either == 0, F.lit(1.0)).otherwise(shared)


def fingerprint(hashes: Column) -> Column:
    """A sketch as text: the hashes in order, in hexadecimal."""
    digits = F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), _DIGITS, F.lit("0")))
    return F.array_join(digits, "")


def sketches(docs: DataFrame, n: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``doc_id, n_chars, sketch`` of every document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"),
                       sketch(text, n, scale).alias("sketch"))


def _node(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and ``node``, which equal rows share."""
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                        F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "node", F.unhex(F.sha2(named, 256)))


def edited_fingerprints(docs: DataFrame, n: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every document, of it with half of the next one, and their likeness.

    The order is found on a narrow table; only the characters that an edited text takes
    over move to it.
    """
    rows = _node(docs)
    nodes = stage(
        rows.select("node", "doc_id", F.length("text").cast("long").alias("n_chars"),
                    sketch(F.col("text"), n, scale).alias("sketch"))
        .groupBy("node").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"),
            F.first("sketch").alias("sketch"), F.count("*").alias("copies")),
        "sketches")
    order = nodes.select("node", "n_chars", F.col("doc_id").isNull().alias("_last"),
                         F.bitwise_not("doc_id").alias("_less"))
    placed = number_rows(order, ["_last", "_less", "node"], "at")
    # the last one takes from the first
    count = placed.agg(F.max("at") + 1).scalar()
    ahead = placed.select(F.pmod(F.col("at") - 1, count).alias("at"), F.col("node").alias("next"))
    taken = F.expr("cast(n_chars div 2 as int)")
    pairs = stage(placed.join(ahead, "at").select("node", "next", taken.alias("taken")), "followed")

    # every join is on the node alone: texts cross the network once, and what they give once
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))
    wanted = pairs.select(F.col("next").alias("node"), F.col("node").alias("to"), "taken")
    tails = texts.join(wanted, "node").select(
        F.col("to").alias("node"), F.substring("text", F.lit(1), F.col("taken")).alias("tail"))
    followers = nodes.select("node", F.col("sketch").alias("next_sketch")).join(
        wanted.select("node", "to"), "node").select(F.col("to").alias("node"), "next_sketch")
    known = nodes.join(followers, "node").select(
        "node", "doc_id", "n_chars", "copies", "sketch",
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("resembles_next"))
    joined = texts.join(tails, "node").join(known, "node").withColumn(
        "start", F.substring("text", F.lit(1), (F.col("n_chars") - taken).cast("int")))
    # of several copies all but the last one are followed by a copy
    by_next = F.struct(
        F.concat("start", "tail").alias("edited"), "near_next", "resembles_next",
        F.lit(1).cast("long").alias("times"))
    by_copy = F.struct(
        F.concat("start", F.substring("text", F.lit(1), taken)).alias("edited"),
        F.lit(1.0).alias("near_next"), F.lit(1.0).alias("resembles_next"),
        (F.col("copies") - 1).alias("times"))
    made = joined.select("doc_id", "n_chars", "sketch", F.explode(
        F.when(F.col("copies") > 1, F.array(by_next, by_copy)).otherwise(F.array(by_next))).alias("e"))
    marked = made.select("doc_id", "n_chars", "sketch", "e.*").withColumn(
        "edited_sketch", sketch(F.col("edited"), n, scale))
    result = marked.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), "near_next",
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("resembles_edited"),
        "resembles_next", "times")
    return _repeated(result, "times")


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row as often as ``times`` says, in arrays of bounded length."""
    step = 1_000_000
    blocks = df.withColumn("_block", F.explode(F.expr(f"sequence(0, ({times} - 1) div {step})")))
    here = F.expr(f"sequence(1, least({step}, {times} - _block * {step}))")
    return blocks.withColumn("_copy", F.explode(here)).drop(times, "_block", "_copy")


def oracle() -> str:
    """The same with a window over all documents; it needs no two rows of one id."""

    def sketched(column: str) -> str:
        words = (rf"regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'),"
                 r" '[^\x20\x09-\x0D]+')")
        hashes = (
            f"list_transform([{words}], lambda w: list_transform(generate_series(1,"
            f" case when len(w) = 0 then 0 else greatest(len(w) - {SHINGLE - 1}, 1) end),"
            f" lambda i: left(md5(array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')),"
            f" {_DIGITS})))[1]")
        kept = f"list_sort(list_distinct(list_filter(h, lambda x: x < '{limit(SCALE)}')))"
        return (f"list_transform([{hashes}], lambda h: case when len({kept}) > 0 then {kept}"
                " when len(h) > 0 then [list_min(h)] else []::varchar[] end)[1]")

    def shared(a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def contained(a: str, b: str) -> str:
        return (f"case when len({a}) + len({b}) = 0 then 1.0::double when least(len({a}), len({b})) = 0"
                f" then 0.0::double else {shared(a, b)}::double / least(len({a}), len({b})) end")

    def alike(a: str, b: str) -> str:
        return (f"case when len({a}) + len({b}) = 0 then 1.0::double else"
                f" {shared(a, b)}::double / (len({a}) + len({b}) - {shared(a, b)}) end")

    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
ordered as (
 select *, coalesce(lead(text) over (order by doc_id desc),
  first_value(text) over (order by doc_id desc)) as next from docs),
edits as (
 select doc_id, cast(length(text) as bigint) as n_chars, text, next,
  substring(text, 1, length(text) - length(text) // 2)
  || substring(next, 1, length(text) // 2) as edited from ordered),
marked as (
 select doc_id, n_chars, sha256(edited) as edited_sha256, {sketched("text")} as a,
  {sketched("edited")} as e, {sketched("next")} as x from edits)
select doc_id, n_chars, edited_sha256, coalesce(array_to_string(a, ''), '') as fingerprint,
 coalesce(array_to_string(e, ''), '') as edited_fingerprint,
 {contained("a", "e")} as near_edited, {contained("a", "x")} as near_next,
 {alike("a", "e")} as resembles_edited, {alike("a", "x")} as resembles_next
from marked
"""
