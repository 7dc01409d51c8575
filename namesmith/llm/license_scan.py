"""License scan: exact phrases, and a set-similarity join of text blocks with notices.

Blocks are windows of 64 words, every 32 words, so a passage of up to 32 words lies whole
in one block. For longer notices both numbers are doubled until the notice lies whole in one;
short notices keep short blocks. A block matches a notice if it holds at least ``THRESHOLD`` of the notice's
distinct words, its marks (words that tell it from its like) among them, and no notice that has
all its words and more matches there too. The join is exact: words are ordered from rare to frequent over all
blocks, a match must then share one of the notice's first words (prefix filter), have
enough words (length filter), and have enough of both left after the shared word
(positional filter); what passes is verified on the whole word sets.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STRIDE = 64, 32
THRESHOLD = 0.8

#: phrases and their labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: usual notices, their labels and the words without which a block is no such notice.
#: Sentences by which the licences are declared, and the wording of some.
NOTICES = [
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this "
     "software", "mit", "charge"),
    ("licensed under the apache license version 2 0", "apache-2", "apache 2"),
    ("licensed under cc by 4 0", "cc-by", "cc by"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc by nd"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "cc by nc sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd", "cc by nc nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license",
     "cc-by", "attribution"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 "
     "international license", "cc-by-sa", "attribution sharealike"),
    ("this work is licensed under a creative commons attribution noderivatives 4 0 "
     "international license", "cc-by-nd", "attribution noderivatives"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 "
     "international license", "cc-by-nc", "attribution noncommercial"),
    ("this work is licensed under a creative commons attribution noncommercial sharealike 4 0 "
     "international license", "cc-by-nc-sa", "attribution noncommercial sharealike"),
    ("this work is licensed under a creative commons attribution noncommercial noderivatives "
     "4 0 international license", "cc-by-nc-nd", "attribution noncommercial noderivatives"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3",
     "gnu general 3"),
    ("this work is licensed under the gnu lesser general public license version 3", "lgpl-3",
     "gnu lesser 3"),
    ("this work is licensed under the gnu affero general public license version 3", "agpl-3",
     "gnu affero 3"),
    ("this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license", "gpl", "gnu general"),
    ("this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu lesser general public license", "lgpl", "gnu lesser"),
    ("this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu affero general public license", "agpl", "gnu affero"),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted", "bsd", "redistribution binary"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0",
     "mpl-2", "mozilla 2"),
    ("permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted", "isc", "fee"),
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this
     software and associated documentation files (the "Software"), to deal in the Software
     without restriction, including without limitation the rights to use, copy, modify, merge,
     publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
     to whom the Software is furnished to do so, subject to the following conditions: The above
     copyright notice and this permission notice shall be included in all copies or substantial
     portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
     EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
     FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
     HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
     CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
     USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit", "sublicense noninfringement"),
    ("""Redistribution and use in source and binary forms, with or without modification, are
     permitted provided that the following conditions are met: 1. Redistributions of source code
     must retain the above copyright notice, this list of conditions and the following
     disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimer in the documentation and/or other
     materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
     AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
     TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
     DISCLAIMED.""", "bsd", "redistributions disclaimer"),
    ("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
     except in compliance with the License. You may obtain a copy of the License at
     http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
     writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
     specific language governing permissions and limitations under the License.""",
     "apache-2", "apache 2"),
]


def words_of(text: str) -> list[str]:
    """The words of a notice, by the rule of the texts'."""
    spaced = re.sub(NOT_WORD, " ", text.translate(str.maketrans(UPPER, LOWER)))
    return [w for w in spaced.split(" ") if w]


def notice_table(notices: list[tuple[str, ...]], threshold: float) -> list[dict]:
    """Distinct words of each notice, how many of them a block must hold, and its blocks' words.

    ``marks`` are the words that it must hold in any case, and ``over`` the notices with blocks of
    the same length that have all its words and more.
    """
    table = []
    for i, (text, label, *marks) in enumerate(notices):
        every = words_of(text)
        words, span = sorted(set(every)), BLOCK
        while span * STRIDE // BLOCK < len(every):
            span *= 2
        # guards against products such as 0.8 * 5 above 4
        need = ceil(threshold * len(words) - 1e-9)
        table.append({"notice": i, "label": label, "words": words, "need": need,
                      "marks": sorted(set(words_of(" ".join(marks)))), "span": span})
        if not set(table[-1]["marks"]) <= set(words):
            raise ValueError(f"marks that are no words of the notice: {marks}")
    for n in table:
        n["over"] = [o["notice"] for o in table
                     if o["span"] == n["span"] and set(o["words"]) > set(n["words"])]
    return table


def by_span(notices: list[dict]) -> list[tuple[int, list[dict]]]:
    """The notices by the length of their blocks."""
    spans = sorted({n["span"] for n in notices})
    return [(span, [n for n in notices if n["span"] == span]) for span in spans]


def spaced_words(text: Column) -> Column:
    """The words of a text, lower case, with two spaces between them."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lowered, NOT_WORD, "  "))


def count_words(spaced: Column) -> Column:
    gaps = (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2
    return F.when(spaced == "", 0).otherwise(gaps + 1).cast("long")


def phrase_places(spaced: Column, n_words: Column, phrase: str) -> Column:
    """``n, first, last`` of a phrase; nulls where it does not occur."""
    words = phrase.split()
    inner = "  ".join(words)
    padded = F.concat(F.lit(" "), spaced, F.lit(" "))
    # cut before every place, so that places may overlap; the mark keeps a first part before the first
    parts = F.split(F.concat(F.lit("^"), padded), rf"(?=\Q {inner} \E)", -1)

    def held(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2

    return F.when(
        F.contains(padded, F.lit(f" {inner} ")),
        F.struct(
            (F.size(parts) - 1).cast("long").alias("n"),
            held(F.element_at(parts, 1)).cast("long").alias("first"),
            (n_words - held(F.element_at(parts, -1))).cast("long").alias("last"),
        ),
    )


def scan_rows(
    docs: DataFrame, phrases: dict[str, str], notices: list[dict]
) -> DataFrame:
    """One narrow row a document: places of the phrases, and its blocks' notice words.

    Written once, so that words are taken apart once and ``_row`` stays the same. There is a
    column of blocks for each length of blocks; a block is kept if it has enough words for the
    notice of that length that needs the fewest.
    """
    rows = docs.select(F.col("doc_id"), spaced_words(F.col("text")).alias("_s"))
    rows = rows.withColumn("n_words", count_words(F.col("_s")))
    places = {f"_p{i}": phrase_places(F.col("_s"), F.col("n_words"), p)
              for i, p in enumerate(phrases)}
    words = F.split(F.col("_s"), "  ")

    def blocks(span: int, group: list[dict]) -> Column:
        step = span * STRIDE // BLOCK
        least = min(n["need"] for n in group)
        known = F.array(*[F.lit(w) for w in sorted({w for n in group for w in n["words"]})])
        starts = F.sequence(
            F.lit(0), F.greatest(F.size(words) - step - 1, F.lit(0)), F.lit(step)
        )
        # the place is kept, as notices compete within a block
        held = F.filter(
            F.transform(starts, lambda i: F.struct(
                i.alias("_no"), F.array_intersect(known, F.slice("_w", i + 1, span)).alias("_b"))),
            lambda b: F.size(b["_b"]) >= least,
        )
        # no block holds more than the whole text
        return F.when(F.size(F.array_intersect(known, F.col("_w"))) >= least, held)

    return stage(
        rows.withColumn("_w", words)
        .select("doc_id", "n_words",
                *[blocks(span, group).alias(f"_b{span}") for span, group in by_span(notices)],
                *[c.alias(name) for name, c in places.items()])
        .withColumn("_row", F.monotonically_increasing_id()),
        "license",
    )


def word_order(rows: DataFrame, notices: list[dict]) -> list[str]:
    """The notices' words from rare to frequent, by the number of blocks that hold them."""
    counts = (
        rows.select(F.explode("_blocks._b").alias("_b"))
        .select(F.explode("_b").alias("word"))
        .groupBy("word").agg(F.count("*").alias("n"))
    )
    seen = dict(counts.collect())  # at most the words of the notices
    return sorted({w for n in notices for w in n["words"]}, key=lambda w: (seen.get(w, 0), w))


def match_notices(rows: DataFrame, notices: list[dict]) -> DataFrame:
    """``_row, label, containment`` of every block and notice that match."""
    return reduce(DataFrame.union, [
        match_blocks(rows.select("_row", F.col(f"_b{span}").alias("_blocks")), group)
        for span, group in by_span(notices)
    ])


def match_blocks(rows: DataFrame, notices: list[dict]) -> DataFrame:
    """The same for notices whose blocks have one length, which are in ``_blocks``."""
    order = word_order(rows, notices)
    rank = {w: i for i, w in enumerate(order)}
    heads = []
    for n in notices:
        words = sorted(n["words"], key=rank.get)
        for i, w in enumerate(words[: len(words) - n["need"] + 1]):
            heads.append((w, n["notice"], n["label"], i, len(words), n["need"], words, n["marks"],
                          n["over"]))
    # as many rows as the notices have words
    index = rows.sparkSession.createDataFrame(
        heads, "word string, notice int, label string, at int, size int, need int, "
               "words array<string>, marks array<string>, over array<int>",
    )
    least = min(n["need"] for n in notices)
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("_b"))
    blocks = (
        rows.select("_row", F.inline("_blocks")).withColumn("_b", ordered)
        .select("_row", "_no", "_b", F.posexplode(
            F.slice("_b", F.lit(1), F.size("_b") - least + 1)).alias("_at", "word"))
    )
    size = F.size("_b")
    left = F.least(F.col("size") - F.col("at"), size - F.col("_at"))
    found = (
        blocks.join(F.broadcast(index), "word")
        .where((size >= F.col("need")) & (left >= F.col("need")))
        .withColumn("_shared", F.size(F.array_intersect("_b", "words")))
        .where(F.col("_shared") >= F.col("need"))
    )
    found = found.where(F.size(F.array_except("marks", "_b")) == 0)
    # a block and notice can meet at more than one word; a block has at most all notices
    met = found.groupBy("_row", "_no").agg(F.collect_set(F.struct(
        "notice", "over", "label", (F.col("_shared") / F.col("size")).alias("containment"),
    )).alias("_met"))
    best = F.filter("_met", lambda n: ~F.arrays_overlap(n["over"], F.col("_met.notice")))
    return met.select("_row", F.inline(best)).select("_row", "label", "containment")


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, ...]] = NOTICES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is 1 where a phrase stands and else the largest containment of a matching
    notice, or 0. Null and empty texts have no words, places or labels; repeated rows give a
    row each; an empty table gives an empty result; other columns are not read. Notices are texts
    with a label and, if wanted, the words that must stand in a block; they may be whole licences
    as they stand.
    """
    table = notice_table(notices, threshold)
    rows = scan_rows(docs, phrases, table)
    found = match_notices(rows, table).groupBy("_row").agg(
        F.collect_set("label").alias("_labels"), F.max("containment").alias("_best")
    )
    places = [F.col(f"_p{i}") for i in range(len(phrases))]
    n_base = sum((F.coalesce(p["n"], F.lit(0)) for p in places), F.lit(0)).cast("long")
    base = F.array_distinct(F.array_compact(F.array(*[
        F.when(p.isNotNull(), F.lit(label)) for p, label in zip(places, phrases.values())
    ])))
    labels = F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>")))
    return rows.join(found, "_row", "left").select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(F.array(*[p["first"] for p in places])).alias("first_word"),
        F.array_max(F.array(*[p["last"] for p in places])).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def oracle(
    phrases: dict[str, str] = PHRASES,
    notices: list[tuple[str, ...]] = NOTICES,
    threshold: float = THRESHOLD,
) -> str:
    """The same result in DuckDB's SQL, every block compared with every notice."""
    table = notice_table(notices, threshold)
    phrase_rows = ", ".join(
        f"({p.split()!r}, {label!r})" for p, label in phrases.items()
    )
    notice_rows = ", ".join(
        f"({n['words']!r}, {n['need']}, {n['label']!r}, {n['marks']!r} :: varchar[], {n['span']})"
        for n in table)
    return f"""
with doc as (
 select row_number() over () as r, doc_id, regexp_extract_all(
  translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
phrase(p, label) as (values {phrase_rows}),
place as (
 select r, label, unnest(list_filter(range(len(w)),
   lambda i: list_slice(w, i + 1, i + len(p)) = p)) as i
 from doc, phrase where list_has_all(w, p)),
based as (select r, count(*) as n, min(i) as lo, max(i) as hi,
 list_sort(list_distinct(list(label))) as ls from place group by r),
notice(words, need, label, marks, span) as (values {notice_rows}),
block as (select r, span, i, list_distinct(list_slice(w, i + 1, i + span)) as b
 from (select r, w, span, unnest(range(0, greatest(len(w) - span * {STRIDE} // {BLOCK}, 1),
   span * {STRIDE} // {BLOCK})) as i from doc, (select distinct span from notice))),
met as (
 select r, span, i, label, words, len(list_intersect(b, words)) / len(words) as c
 from block join notice using (span)
 where len(list_intersect(b, words)) >= need and list_has_all(b, marks)),
hit as (
 select r, label, c from met m where not exists (
  select 1 from met o where o.r = m.r and o.span = m.span and o.i = m.i
   and len(o.words) > len(m.words) and list_has_all(o.words, m.words))),
hits as (select r, list(distinct label) as ls, max(c) as c from hit group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_base, lo as first_word, hi as last_word,
 coalesce(array_to_string(based.ls, ','), '') as base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(
  coalesce(based.ls, []), coalesce(hits.ls, [])))), ','), '') as labels,
 case when n > 0 then 1.0 else coalesce(c, 0.0) end :: double as score
from doc left join based using (r) left join hits using (r)
"""
