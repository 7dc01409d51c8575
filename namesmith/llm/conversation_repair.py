"""Conversations brought back to ``system? (user assistant)+`` by the cheapest edits.

A conversation's rows and the four states of that pattern span a lattice; its edges are the
edits. Two searches with a heap each, from the first node and from the last, meet in it; all
crossings of the least cost are finished, and the least audit of them is taken. A conversation
is searched in segments of bounded length. A segment's result is the cheapest audit from each
state to each state, and such tables are put together in rounds, so no task holds a whole
long conversation; only its digest, which is one sequence, is taken in one streaming pass.

Defined results: a null role or text reads as one space, and so does a null in the key of the
damage; rows without a ``conv_id`` are the conversation of the null id; an
empty role has no initial, so keeping it changes no state; rows of one turn come
in order of the digest of role and text; rows that are equal in all are counted, not spread
out. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import number_rows
from ..storage import stage

#: records of a segment, and tables put together in a round
SEGMENT, FAN = 512, 64
#: costs of the edits, and what an undeleted truncated row adds
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: states: nothing yet, after the system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: the state that a role's initial leads to
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER,
         (USER, "a"): ASSISTANT}
#: the role that a rerole or an insertion gives in each state, and the state after it
_GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER),
          USER: ("assistant", ASSISTANT)}
_LEGAL = {"su", "ua", "au"}

Node = tuple[int, int]
#: (cost, letters, state after) by state before
Moves = dict[int, list[tuple[int, str, int]]]
Table = dict[tuple[int, int], tuple[int, str]]

_INSERTS: Moves = {q: [(INSERT, "I", after)] for q, (_, after) in _GIVEN.items()}


def kept(state: int, initial: str) -> int | None:
    """The state after a role that stays; one without an initial changes nothing."""
    return _NEXT.get((state, initial)) if initial else state


def row_moves(initial: str, truncated: bool) -> Moves:
    """Edges of a row that may stay."""
    more = TRUNCATED if truncated else 0
    moves: Moves = {}
    for q, (_, after) in _GIVEN.items():
        moves[q] = [(DELETE, "D", q), (REROLE + more, "R", after)]
        if kept(q, initial) is not None:
            moves[q].append((more, "K", kept(q, initial)))
    return moves


def run_moves(copies: int) -> Moves:
    """Edges of rows that must go. Insertions among them are never least, as D is below I."""
    return {q: [(DELETE * copies, "D" * copies, q)] for q in _GIVEN}


def _backwards(moves: Moves) -> Moves:
    back: Moves = {}
    for q, edges in moves.items():
        for cost, letters, after in edges:
            back.setdefault(after, []).append((cost, letters, q))
    return back


def cheapest(rows: list[Moves], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the paths through all rows, from ``entry`` to one of ``exits``.

    Audits of equal cost between two nodes are never prefixes of one another, so the least
    one is made of least parts. Edges without cost pass a row: nodes of equal cost are taken
    in the order of rows, and a node's audit is final when it leaves the heap.
    """
    n = len(rows)
    sides = [(rows, _INSERTS), ([_backwards(m) for m in rows], _backwards(_INSERTS))]
    labels: list[dict[Node, tuple[int, str]]] = [{(0, entry): (0, "")}, {(n, q): (0, "") for q in exits}]
    heaps: list[list[tuple[int, int, Node]]] = [[(0, 0, (0, entry))], [(0, 0, (n, q)) for q in exits]]
    done: list[set[Node]] = [set(), set()]
    best: int | None = None

    def expand(side: int) -> None:
        nonlocal best
        cost, passed, node = heapq.heappop(heaps[side])
        if node in done[side]:
            return
        done[side].add(node)
        at, q = node
        audit = labels[side][node][1]
        moves, inserts = sides[side]
        steps = [(w, x, (at, p), passed) for w, x, p in inserts.get(q, ())]
        row = at if side == 0 else at - 1
        if 0 <= row < n:
            to = at + 1 if side == 0 else at - 1
            steps += [(w, x, (to, p), passed + 1) for w, x, p in moves[row].get(q, ())]
        for w, x, target, rank in steps:
            label = cost + w, audit + x if side == 0 else x + audit
            if target not in labels[side] or label < labels[side][target]:
                labels[side][target] = label
                heapq.heappush(heaps[side], (label[0], rank, target))
            if target in labels[1 - side]:
                total = labels[side][target][0] + labels[1 - side][target][0]
                best = total if best is None else min(best, total)

    if n == 0 and entry in exits:
        best = 0
    while heaps[0] and heaps[1]:
        ahead, behind = heaps[0][0][0], heaps[1][0][0]
        if best is not None and ahead + behind > best:
            break
        expand(0 if ahead <= behind else 1)
    crossings = [
        (a[0] + b[0], a[1] + b[1])
        for node, a in labels[0].items() if (b := labels[1].get(node)) is not None]
    return min(crossings, default=None)


def segment_table(rows: list[Moves], entries: tuple[int, ...]) -> Table:
    found = {(e, x): cheapest(rows, e, (x,)) for e in entries for x in _GIVEN}
    return {pair: label for pair, label in found.items() if label is not None}


def chained(a: Table, b: Table) -> Table:
    """Cheapest audits through two parts that follow one another."""
    out: Table = {}
    for (e, q), (cost, audit) in a.items():
        for (p, x), (more, rest) in b.items():
            if p == q and ((e, x) not in out or (cost + more, audit + rest) < out[e, x]):
                out[e, x] = cost + more, audit + rest
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given the wrong role.

    ``conv_id, turn, role, text, copies, key``: the key is that of role and text.
    """

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select(
        "conv_id", "turn",
        F.when(fault == 4, F.lit("user")).otherwise(plain("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(
            fault == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text")).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"), fault.alias("fault"))
    return rows.where("fault <> 0").drop("fault").withColumn("key", F.sha2(
        F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def records(rows: DataFrame) -> DataFrame:
    """A narrow row for equal rows of a turn, with ``initial``, ``fault`` and ``fresh``.

    ``fresh``: the first of the copies is the first row of its role and text.
    """
    text = F.col("text")
    initial = F.substring("role", 1, 1)
    marked = rows.select(
        "conv_id", "turn", "key", "copies",
        F.when(initial.isin("s", "u", "a", ""), initial).otherwise("o").alias("initial"),
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(
            text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "").otherwise("truncated").alias("fault"))
    counted = stage(marked.groupBy("conv_id", "turn", "key").agg(
        F.sum("copies").alias("copies"), F.first("initial").alias("initial"),
        F.first("fault").alias("fault")), "turn-records")
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(
        F.min(when)["turn"].alias("_turn"))
    return counted.join(
        firsts, counted["conv_id"].eqNullSafe(firsts["_conv"]) & (counted["key"] == firsts["_key"])
    ).select(*counted.columns, F.col("turn").eqNullSafe(F.col("_turn")).alias("fresh"))


def facts(placed: DataFrame) -> DataFrame:
    """Per conversation: its first and last place, gaps and numbers of faults."""
    blank, fresh = F.col("fault") == "blank", F.col("fresh")
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")

    def total(value: Column) -> Column:
        return F.sum(value).cast("long")

    return placed.groupBy("conv_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        total(F.when(blank, F.col("copies")).otherwise(0)).alias("blank"),
        total(F.when(blank, 0).otherwise(F.col("copies") - fresh.cast("int"))).alias("duplicate"),
        total((fresh & (F.col("fault") == "truncated")).cast("int")).alias("truncated"))


_TABLE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()),
                             ("audit", pa.string())]))
_SEARCHED = pa.schema([("place", pa.int64()), ("seg", pa.int64()), ("first", pa.string()),
                       ("last", pa.string()), ("illegal", pa.int64()), ("moves", _TABLE)])
SEARCHED = ("place long, seg long, first string, last string, illegal long,"
            " moves array<struct<entry: int, exit: int, cost: bigint, audit: string>>")


def _as_rows(table: Table) -> list[dict]:
    return [{"entry": e, "exit": x, "cost": c, "audit": a} for (e, x), (c, a) in table.items()]


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: each holds a whole list."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _search_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in _each(batch):
            before, rows, illegal = None, [], 0
            for item in row["items"]:
                copies, initial = item["copies"], item["initial"]
                # of equal neighbours none is legal
                illegal += copies - 1 + (before is not None and before + initial not in _LEGAL)
                before = initial
                if item["fresh"] and item["fault"] != "blank":
                    rows.append(row_moves(initial, item["fault"] == "truncated"))
                    copies -= 1
                if copies:
                    rows.append(run_moves(copies))
            entries = (START,) if row["seg"] == 0 else tuple(_GIVEN)
            out.append({"place": row["place"], "seg": row["seg"], "first": row["items"][0]["initial"],
                        "last": before, "illegal": illegal,
                        "moves": _as_rows(segment_table(rows, entries))})
        yield pa.RecordBatch.from_pylist(out, schema=_SEARCHED)


def _chain_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in _each(batch):
            head, *rest = row["parts"]
            table = {(m["entry"], m["exit"]): (m["cost"], m["audit"]) for m in head["moves"]}
            last, illegal = head["last"], head["illegal"]
            for part in rest:
                table = chained(table, {(m["entry"], m["exit"]): (m["cost"], m["audit"])
                                        for m in part["moves"]})
                illegal += part["illegal"] + (last + part["first"] not in _LEGAL)
                last = part["last"]
            out.append({"place": row["place"], "seg": row["seg"], "first": head["first"],
                        "last": last, "illegal": illegal, "moves": _as_rows(table)})
        yield pa.RecordBatch.from_pylist(out, schema=_SEARCHED)


def audits(placed: DataFrame, of: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of each conversation of placed records.

    ``place`` names a conversation by its first record's place.
    """
    firsts = of.select(F.col("conv_id").alias("_conv"), F.col("first_at").alias("place"))
    items = placed.join(firsts, placed["conv_id"].eqNullSafe(firsts["_conv"])).groupBy(
        "place", F.expr(f"(at - place) div {segment}").alias("seg")
    ).agg(F.array_sort(F.collect_list(F.struct("at", "initial", "fault", "copies", "fresh"))).alias("items"))
    parts = stage(items.mapInArrow(_search_segments, SEARCHED), "segments")
    most = of.agg(F.max(F.expr(f"(last_at - first_at) div {segment}"))).first()[0] or 0
    while most > 0:
        grouped = parts.groupBy("place", F.expr(f"seg div {fan}").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("seg", "first", "last", "illegal", "moves"))).alias("parts"))
        grouped = grouped.select("place", F.col("up").alias("seg"), "parts")
        parts = stage(grouped.mapInArrow(_chain_parts, SEARCHED), "chained")
        most //= fan
    whole = F.array_min(F.transform(
        F.filter("moves", lambda m: (m["entry"] == START) & m["exit"].isin(*ENDS)),
        lambda m: F.struct(m["cost"].alias("cost"), m["audit"].alias("audit"))))
    found = parts.select("place", "illegal", whole.alias("best"))
    return found.join(of.withColumnRenamed("first_at", "place"), "place").select(
        "conv_id", "illegal", "best.cost", "best.audit")


_REPAIRED = pa.schema([("place", pa.int64()), ("repaired_sha256", pa.string())])


class _Repair:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START
        self.sha, self.some = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("\n" if self.some else "").encode() + f"{role}:{text}".encode())
        self.some = True

    def inserts(self) -> None:
        while self.audit.startswith("I", self.at):
            role, self.state = _GIVEN[self.state]
            self._put(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept(self.state, role[:1])
            self._put(role, text)
        elif edit == "R":
            given, self.state = _GIVEN[self.state]
            self._put(given, text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each conversation's audit ahead of them, to digests."""
    place, repair = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if repair is not None:
                    out.append({"place": place, "repaired_sha256": repair.digest()})
                place, repair = row["place"], _Repair(row["audit"])
                continue
            for _ in range(row["copies"]):
                repair.row(row["role"], row["text"])
        yield pa.RecordBatch.from_pylist(out, schema=_REPAIRED)
    if repair is not None:
        yield pa.RecordBatch.from_pylist(
            [{"place": place, "repaired_sha256": repair.digest()}], schema=_REPAIRED)


def digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: rows and audits of a conversation meet in one stream."""
    # a null id has a number of its own beside it
    known = F.col("conv_id").isNotNull()
    audit = edits.select("conv_id", known.alias("known"), "place", "audit")
    both = audit.unionByName(rows.select(
        "conv_id", known.alias("known"), "turn", "key", "role", "text", "copies"),
        allowMissingColumns=True)
    ordered = both.repartition("conv_id", "known").sortWithinPartitions(
        "known", "conv_id", F.col("audit").isNull(), "turn", "key")
    return ordered.mapInArrow(_repair_rows, "place long, repaired_sha256 string")


def repair(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Faults, cheapest audit and digest of the repaired form of every damaged conversation."""
    rows = damage(conversations)
    placed = number_rows(records(rows), ["conv_id", "turn", "key"], "at")
    of = stage(facts(placed), "conversation-facts")
    found = stage(audits(placed, of, segment, fan), "audits")
    places = of.select(F.col("conv_id").alias("_conv"), F.col("first_at").alias("place"))
    edits = found.join(places, found["conv_id"].eqNullSafe(places["_conv"]))
    hashed = digests(rows, edits).join(places, "place").select(
        F.col("_conv").alias("conv_id"), "repaired_sha256")
    # no join, as an id may be null
    parts = conversations.select("conv_id").distinct()
    for part in (of.drop("first_at", "last_at"), found, hashed):
        parts = parts.unionByName(part, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """The same by one forward pass: the best audit of each state after every row."""

    def step(label: str, cost: str, letter: str) -> str:
        return (f"case when {label} is null then null else lpad(cast(cast(left({label}, 10) as bigint)"
                f" + {cost} as varchar), 10, '0') || substr({label}, 11) || '{letter}' end")

    def insert(label: str) -> str:
        return step(label, str(INSERT), "I")

    more = f"(case when r[2] = 'truncated' then {TRUNCATED} else 0 end)"

    def stays_as(label: str, initial: str) -> str:
        return f"case when r[1] = '{initial}' then {step(label, more, 'K')} end"

    def free(state: int, keep: list[str], rerole: list[str]) -> str:
        deleted = step(f"s[{state + 1}]", str(DELETE), "D")
        stays = [stays_as(f"s[{state + 1}]", ""), *keep, *(step(x, f"{REROLE} + {more}", "R") for x in rerole)]
        stays = [f"case when r[2] not in ('blank', 'duplicate') then {x} end" for x in stays]
        return f"least({', '.join([deleted, *stays])})"

    before_user = [f"s[{q + 1}]" for q in (START, SYSTEM, ASSISTANT)]
    raw = ", ".join([
        free(START, [], []),
        free(SYSTEM, [stays_as("s[1]", "s")], []),
        free(USER, [stays_as(x, "u") for x in before_user], before_user),
        free(ASSISTANT, [stays_as("s[3]", "a")], ["s[3]"]),
    ])
    user = f"least(n[3], {insert('n[1]')}, {insert('n[2]')}, {insert('n[4]')})"
    closed = (f"list_transform([[n[1], n[2], {user}, n[4]]], lambda m:"
              f" [m[1], m[2], m[3], least(m[4], {insert('m[3]')})])[1]")
    none = "0000000000"
    fold = (f"list_reduce(marks, lambda s, r: list_transform([[{raw}]], lambda n: {closed})[1],"
            f" ['{none}', null, '{3:010d}I', '{6:010d}II'])")
    crc = ("xor(list_reduce(list_transform(string_split(key, ''), lambda c: cast(ascii(c) as bigint)),"
           " lambda c, b: list_reduce([0::bigint, 1, 2, 3, 4, 5, 6, 7], lambda x, i:"
           " xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::bigint), 4294967295::bigint)")
    # an insertion takes no row, a deletion gives none
    edit = "e[1]"
    given = "case when left(s[1], 1) = 'u' then 'assistant' else 'user' end"
    role = f"case when {edit} = 'K' then roles[cast(s[2] as int)] else {given} end"
    text = f"case when {edit} = 'I' then '' else texts[cast(s[2] as int)] end"
    line = f"s[3] || case when s[4] = '' then '' else chr(10) end || {role} || ':' || {text}"
    applied = (
        "list_reduce(list_transform(string_split(audit, ''), lambda c: [c]), lambda s, e:"
        f" [case when {edit} = 'D' or {role} = '' then s[1] else {role} end,"
        f" cast(cast(s[2] as int) + case when {edit} = 'I' then 0 else 1 end as varchar),"
        f" case when {edit} = 'D' then s[3] else {line} end,"
        f" case when {edit} = 'D' then s[4] else '1' end], ['', '1', '', ''])[3]")
    return rf"""
with keyed as (
 select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key
 from conversations),
faulty as (select *, {crc} % 20 as fault from keyed),
damaged as (
 select conv_id, turn, case when fault = 4 then 'user' else role end as role,
  case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when fault = 3 then [1, 2] else [1] end) as copy
 from faulty where fault <> 0),
ordered as (
 select *, sha256(cast(length(role) as varchar) || ':' || role || text) as digest,
  row_number() over (partition by conv_id order by turn nulls first, digest, copy) as pos
 from damaged),
marked as (
 select *, case when left(role, 1) in ('s', 'u', 'a', '') then left(role, 1) else 'o' end as initial,
  case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
   when row_number() over (partition by conv_id, digest order by pos) > 1 then 'duplicate'
   when regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then '' else 'truncated' end as fault
 from ordered),
paired as (
 select *, coalesce(lag(initial) over (partition by conv_id order by pos) || initial, 'su')
  not in ('su', 'ua', 'au') as illegal from marked),
gathered as (
 select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
  count(*) filter (where fault = 'blank') as blank,
  count(*) filter (where fault = 'duplicate') as duplicate,
  count(*) filter (where fault = 'truncated') as truncated,
  count(*) filter (where illegal) as illegal,
  list([initial, fault] order by pos) as marks, list(role order by pos) as roles,
  list(text order by pos) as texts
 from paired group by conv_id),
searched as (
 select *, least(states[1], states[4]) as best from (select *, {fold} as states from gathered)),
audited as (
 select *, cast(left(best, 10) as bigint) as cost, substr(best, 11) as audit from searched),
repaired as (select *, sha256({applied}) as repaired_sha256 from audited)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank,
 coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
 coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
 coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join repaired r on c.conv_id is not distinct from r.conv_id
"""
