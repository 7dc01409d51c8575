"""Records of CSV files whose cells hold line breaks, read by as many tasks as there are splits.

Whether a line starts a record depends on all lines ahead of it in its file: it may stand
within a quoted cell. A first scan finds, for each split and for both answers, whether the
split ends within a quoted cell; putting these together in order gives every split's true
start. In a second scan splits cut their lines into records, and only the few lines of records
that cross a split meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage

_QUOTE, _COMMA = '"', ","
_ENDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("plain", pa.bool_()),
                   ("quoted", pa.bool_()), ("begins", pa.bool_())])
_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("first", pa.bool_()),
                     ("whole", pa.bool_()), ("lead", pa.bool_()), ("text", pa.string())])


def ends_quoted(line: str, quoted: bool) -> bool:
    """Whether a line that starts within a quoted cell, or not, ends within one.

    A cell is quoted if it starts with a quote; elsewhere quotes are plain characters. Two
    quotes within a quoted cell are one, and after the closing quote a cell goes on plainly.
    """
    at = 0
    while True:
        if quoted:
            at = line.find(_QUOTE, at)
            if at < 0:
                return True
            if line.startswith(_QUOTE, at + 1):
                at += 2
                continue
            quoted, at = False, at + 1
        elif line.startswith(_QUOTE, at):
            quoted, at = True, at + 1
            continue
        at = line.find(_COMMA, at) + 1
        if not at:
            return False


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, str]]:
    """``(file, start, quoted, line)`` in order; a task may read several splits."""
    for batch in batches:
        names = batch.schema.names
        entered = batch.column("entered") if "entered" in names else None
        for i, (line, file, start) in enumerate(zip(*(batch.column(c) for c in ("line", "file", "start")))):
            yield (file.as_py(), start.as_py(), entered is not None and entered[i].as_py(),
                   line.as_py())


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: does it end quoted, entered plainly or quoted, and does a record begin."""
    now, states, begins = None, None, False
    out = []
    for file, start, _, line in _splits(batches):
        if (file, start) != now:
            if now is not None:
                out.append((*now, *states, begins))
            now, states, begins = (file, start), (False, True), False
        # entered quoted, a record begins where the cell has ended on a line before
        begins = begins or not states[1]
        states = ends_quoted(line, states[0]), ends_quoted(line, states[1])
    if now is not None:
        out.append((*now, *states, begins))
    columns = zip(*out) if out else [[]] * len(_ENDS)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENDS)], schema=_ENDS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to records; those that a split does not hold whole are marked."""
    out: list[dict] = []
    held = 0
    now, lines, quoted, lead, first = None, [], False, False, False

    def piece(whole: bool) -> dict:
        return {"file": now[0], "start": now[1], "first": first, "whole": whole and not lead,
                "lead": lead, "text": "\n".join(lines)}

    for file, start, entered, line in _splits(batches):
        if (file, start) != now:
            if lines:
                out.append(piece(False))
            now, lines, quoted, lead = (file, start), [], entered, entered
            first = start == 0
        lines.append(line)
        held += len(line)
        quoted = ends_quoted(line, quoted)
        if not quoted:
            out.append(piece(True))
            lines, lead, first = [], False, False
        if held > 1 << 22 or len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist(out, _PIECES)
            out, held = [], 0
    if lines:
        out.append(piece(False))
    yield pa.RecordBatch.from_pylist(out, _PIECES)


def _entries(ends: DataFrame) -> DataFrame:
    """``file, start`` of splits that start within a quoted cell, and the split that ``owns`` it.

    A split leaves the state as it was, turns it, or sets it. The state at a start is the last
    one set ahead of it, turned as often as splits since then say.
    """
    order = Window.partitionBy("file").orderBy("start")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.col("plain") & ~F.col("quoted")
    sets = F.col("plain") == F.col("quoted")
    counted = ends.withColumn("turned", F.sum(turns.cast("int")).over(order))
    last = F.max(F.when(sets, F.struct("start", "plain", "turned"))).over(ahead)
    before = F.coalesce(F.lag("turned").over(order), F.lit(0))
    known = counted.withColumns({"last": last, "before": before})
    odd = (F.col("before") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    entered = F.coalesce(F.col("last.plain"), F.lit(False)) != odd
    marked = known.withColumn("entered", entered)
    begins = ~F.col("entered") | F.col("begins")
    owns = F.max(F.when(begins, F.col("start"))).over(ahead)
    return marked.withColumn("owns", owns).where("entered").select("file", "start", "owns", "entered")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of every record below the header of one file or of all files of a folder.

    Records end in a line end of either kind; those within cells stay as they are.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    ends = stage(lines.mapInArrow(
        _split_ends, "file string, start long, plain boolean, quoted boolean, begins boolean"), "split-ends")
    # a row for a split that starts within a cell, as the plan of a scan has one for every split
    entries = stage(_entries(ends), "split-entries")
    entered = lines.join(F.broadcast(entries.drop("owns")), ["file", "start"], "left").withColumn(
        "entered", F.coalesce("entered", F.lit(False)))
    pieces = entered.select("line", "file", "start", "entered").mapInArrow(
        _cut, "file string, start long, first boolean, whole boolean, lead boolean, text string")
    pieces = stage(pieces, "records")
    whole = pieces.where("whole and not first").select("text")
    parts = pieces.where("not whole").join(
        F.broadcast(entries.drop("entered")), ["file", "start"], "left"
    ).withColumn("owner", F.when(F.col("lead"), F.col("owns")).otherwise(F.col("start")))
    joined = parts.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"),
        F.max("first").alias("first"))
    crossing = joined.where(~F.col("first")).select(
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(crossing).select(
        F.regexp_replace("text", r"\r\z", "").alias("text")).where("text <> ''")
