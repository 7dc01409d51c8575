"""Sharding by histogram sort.

Rows are ordered by ``(crc32 of the text, doc_id)``, so equal texts stand together, and
cut where the bytes before a row reach a multiple of the total's eighth. The cuts are
found by counting: every round counts the exact bytes of a few hundred key ranges, keeps
the range in which a cut falls and divides it again, until one row (or a range within
the tolerance) is left. Only those counts reach the driver. Rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import stage

SHARDS = 8
#: key ranges counted for each cut and round, at most
PROBES = 256
#: ranges counted in one round, over all cuts
COUNTED = 1 << 16
#: rows of a piece of a shard, about; a task sorts one piece
PIECE = 4_000_000
#: share of a piece's bytes by which a cut between pieces may be off
SLACK = 0.1
KEY = ["_crc", "_doc", "_row"]
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class _Cut:
    """A cut not yet found: it lies among the rows with ``prefix`` and then lo..hi."""

    target: int
    tolerance: int
    below: int
    lo: int
    hi: int
    prefix: tuple[int, ...] = ()
    last: tuple[int, ...] | None = field(default=None)

    def interval(self) -> tuple:
        return self.prefix, self.lo, self.hi


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size, text_crc32`` and the sort key of every row, written once.

    A null text is empty; a null doc_id sorts first. ``_row`` tells repeated rows apart.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
    })
    return rows.withColumns({
        "_crc": F.col("text_crc32"),
        "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)),
        "_row": F.monotonically_increasing_id(),
    })


def size_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32`` and the sort key of every row, written once."""
    rows = with_keys(docs.select("doc_id", "text"))
    return stage(rows.drop("text"), "sizes")


@dataclass
class Splitters:
    """All cuts in key order, and the shard of each piece between them."""

    cuts: list[tuple[int, ...]]
    shard_of: list[int]

    def piece(self) -> Column:
        """The number of cuts that a row's key is beyond, by halving."""
        def among(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(after(self.cuts[mid]), among(mid + 1, hi)).otherwise(among(lo, mid))

        return among(0, len(self.cuts)).cast("int")

    def shard(self, piece: Column) -> Column:
        shards = F.array(*[F.lit(x) for x in self.shard_of])
        return F.element_at(shards, piece + 1).cast("int")


def find_splitters(
    rows: DataFrame, shards: int = SHARDS, tolerance: int = 0, probes: int = PROBES,
    piece_rows: int = PIECE,
) -> Splitters:
    """The cuts between shards, and within shards of more than ``piece_rows`` rows on average.

    A cut holds the last key (or key prefix) left of it. It is the first row with at least
    ``total * i / shards`` bytes before it. With a ``tolerance`` in bytes a cut between shards
    may also fall on the border of a counted range that is no further away; cuts within a
    shard need only be near.
    """
    least, most, total, n = rows.agg(
        F.min("_crc"), F.max("_crc"), F.coalesce(F.sum("size"), F.lit(0)), F.count("*")
    ).first()
    if not total:
        return Splitters([], [0])
    pieces = max(1, -(-n // (shards * piece_rows)))
    parts = shards * pieces
    inner = max(tolerance, int(SLACK * total / parts))
    cuts = [
        _Cut(-(-total * i // parts), inner if i % pieces else tolerance, 0, least, most)
        for i in range(1, parts)
    ]
    while open_cuts := [c for c in cuts if c.last is None]:
        intervals = list({c.interval() for c in open_cuts})
        counted = _count(rows, intervals, max(2, min(probes, COUNTED // len(intervals))))
        for cut in open_cuts:
            _narrow(cut, counted[cut.interval()])
        _descend(rows, [c for c in cuts if c.last is None and c.lo == c.hi])
    # a prefix stands for the last key that begins with it
    ordered = sorted(
        ((*c.last, *[_MOST] * (len(KEY) - len(c.last))), i % pieces == 0, c.last)
        for i, c in enumerate(cuts, 1))
    shard_of = [0]
    for _, between_shards, _ in ordered:
        shard_of.append(shard_of[-1] + between_shards)
    return Splitters([last for *_, last in ordered], shard_of)


def _step(interval: tuple, probes: int) -> int:
    return -(-(interval[2] - interval[1] + 1) // probes)


def _inside(interval: tuple) -> Column:
    prefix, lo, hi = interval
    inside = F.col(KEY[len(prefix)]).between(lo, hi)
    for name, value in zip(KEY, prefix):
        inside = inside & (F.col(name) == value)
    return inside


def _reached(start: tuple[int, ...]) -> Column:
    """Whether a row's key is at or after the first key that begins like this."""
    reached = F.lit(True)
    for name, value in reversed(list(zip(KEY, start))):
        column = F.col(name)
        reached = (column > value) | ((column == value) & reached)
    return reached


def _bucket(interval: tuple, probes: int) -> Column:
    at = F.floor((F.col(KEY[len(interval[0])]) - interval[1]) / _step(interval, probes))
    if interval[2] - interval[1] >= 1 << 52:
        # doubles would round: divide as decimals
        gap = F.col(KEY[len(interval[0])]).cast("decimal(20,0)") - F.lit(str(interval[1])).cast(
            "decimal(20,0)"
        )
        at = F.floor(gap / F.lit(str(_step(interval, probes))).cast("decimal(20,0)"))
    return at.cast("long")


def _count(rows: DataFrame, intervals: list[tuple], probes: int) -> dict[tuple, list]:
    """Bytes, rows and smallest key of each range of each interval.

    Intervals are equal or apart, so a row counts for one of them, found by halving.
    """
    intervals = sorted(intervals, key=lambda x: (*x[0], x[1]))

    def among(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            found = F.struct(F.lit(lo).alias("which"), _bucket(intervals[lo], probes).alias("bucket"))
            return F.when(_inside(intervals[lo]), found)
        mid = (lo + hi) // 2
        return F.when(_reached((*intervals[mid][0], intervals[mid][1])), among(mid, hi)).otherwise(
            among(lo, mid))

    counts = (
        rows.select(among(0, len(intervals)).alias("_in"), "size", *KEY)
        .where(F.col("_in").isNotNull())
        .groupBy(F.col("_in.which").alias("_which"), F.col("_in.bucket").alias("_bucket"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"),
             F.min(F.struct(*KEY)).alias("key"))
    )
    found: dict[tuple, list] = {interval: [] for interval in intervals}
    for r in counts.collect():  # at most ``probes`` for each interval
        interval = intervals[r["_which"]]
        lo = interval[1] + r["_bucket"] * _step(interval, probes)
        hi = min(interval[2], lo + _step(interval, probes) - 1)
        found[interval].append((lo, hi, r["bytes"], r["n"], tuple(r["key"])))
    return {interval: sorted(ranges) for interval, ranges in found.items()}


def _narrow(cut: _Cut, ranges: list) -> None:
    """Go on to the range whose rows reach the target; a single row there is the cut's."""
    for lo, hi, size, n, key in ranges:
        if cut.below + size >= cut.target:
            break
        cut.below += size
    cut.lo, cut.hi = lo, hi
    if n == 1:
        cut.last = key
    elif cut.below + size - cut.target <= cut.tolerance:
        cut.last = (*cut.prefix, hi)


def _descend(rows: DataFrame, cuts: list[_Cut]) -> None:
    """Rows that agree in this key column are told apart by the next."""
    for prefix in {(*c.prefix, c.lo) for c in cuts}:
        column = KEY[len(prefix)]
        own = F.lit(True)
        for name, value in zip(KEY, prefix):
            own = own & (F.col(name) == value)
        lo, hi = rows.where(own).agg(F.min(column), F.max(column)).first()
        for c in cuts:
            if c.last is None and (*c.prefix, c.lo) == prefix and len(c.prefix) < len(prefix):
                c.prefix, c.lo, c.hi = prefix, lo, hi


def after(cut: tuple[int, ...]) -> Column:
    """Whether a row's key is greater than the cut's last key."""
    beyond = F.lit(False)
    for name, value in reversed(list(zip(KEY, cut))):
        column = F.col(name)
        beyond = (column > value) | ((column == value) & beyond)
    return beyond


def histogram_shards(
    docs: DataFrame, shards: int = SHARDS, tolerance: int = 0, probes: int = PROBES,
    piece_rows: int = PIECE,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the UTF-8 length plus 1, shards are near equal in bytes, and ``slot``
    numbers the rows of a shard without gaps in key order. Null texts are empty, repeated
    rows are placed one by one, an empty table gives an empty result, and other columns
    of ``docs`` are not read.
    """
    rows = size_rows(docs)
    splitters = find_splitters(rows, shards, tolerance, probes, piece_rows)
    dealt = rows.withColumn("_piece", splitters.piece())
    # one row a piece, of which there are about n / piece_rows
    counts = dealt.groupBy("_piece").agg(F.count("*").alias("_rows")).withColumn(
        "shard", splitters.shard(F.col("_piece")))
    ahead = Window.partitionBy("shard").orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = counts.select("_piece", "shard",
                           F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(*KEY))
    return dealt.withColumn("_at", within.cast("long")).join(
        F.broadcast(starts), "_piece"
    ).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_at") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, piece_rows: int = PIECE
) -> None:
    """Write whole documents as Parquet in folders by shard, the rows of a file in key order.

    Rows with null and repeated ids are written too, each once. Columns ``shard``, ``size``
    and ``text_crc32`` of ``docs`` are replaced.
    """
    rows = stage(with_keys(docs), "sized_documents")
    splitters = find_splitters(rows, shards, piece_rows=piece_rows)
    dealt = rows.withColumn("_piece", splitters.piece())
    (dealt.withColumn("shard", splitters.shard(F.col("_piece")))
     .repartition(len(splitters.shard_of), "_piece").sortWithinPartitions("shard", *KEY)
     .drop("_piece", *KEY).write.partitionBy("shard").parquet(path))
