import random
import re

import pytest

from namesmith.llm import license_scan as L

from .common import awkward_rows, docs_table, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(text):
    text = (text or "").translate(str.maketrans(L.UPPER, L.LOWER))
    words = WORD.findall(text)
    places = [(i, label) for phrase, label in L.PHRASES.items() for p in [phrase.split()]
              for i in range(len(words)) if words[i : i + len(p)] == p]
    base = {label for _, label in places}
    found, best = set(), 0.0
    table = L.notice_table(L.NOTICES, L.THRESHOLD)
    for span in {n["span"] for n in table}:
        for start in range(0, max(len(words) - span // 2, 1), span // 2):
            block = set(words[start : start + span])
            met = [n for n in table if n["span"] == span and set(n["marks"]) <= block
                   and len(block & set(n["words"])) >= n["need"]]
            for n in met:
                if not any(set(o["words"]) > set(n["words"]) for o in met):
                    found.add(n["label"])
                    best = max(best, len(block & set(n["words"])) / len(n["words"]))
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best)


def check(spark, rows):
    df = L.license_scan(docs_table(spark, rows, ["labels", "n_words", "_row"]))
    got = sorted(((r[0], *r[1:]) for r in df.collect()), key=str)
    assert got == sorted(((i, *expected(t)) for i, t in rows), key=str)


def test_equals_every_block_against_every_notice(spark):
    rng = random.Random(3)
    notices = [n for n, *_ in L.NOTICES] + list(L.PHRASES)
    rows = []
    for i in range(120):
        words = prose(rng, rng.randrange(200)).split()
        for _ in range(rng.randrange(4)):
            notice = rng.choice(notices).split()
            for _ in range(rng.randrange(4)):
                notice.pop(rng.randrange(len(notice)))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in notice]
        rows.append((i, rng.choice([" ", "-", ".\n"]).join(words)))
    check(spark, rows)


def test_neighbouring_places(spark):
    check(spark, [(1, "cc by nc cc-BY-nc"), (2, "under the MIT License under the mit license."),
                  (3, "Apache License, Version 2.0 cc by ncx"), (4, "xcc by nc")])


def test_awkward_rows(spark):
    check(spark, awkward_rows())
    assert L.license_scan(docs_table(spark, [])).collect() == []


def test_long_notices(spark):
    rng = random.Random(7)
    middle, body = prose(rng, 50, 10_000), prose(rng, 170, 10_000)
    notices = [*L.NOTICES, (middle, "middle"), (body.upper().replace(" ", ", "), "body")]
    rows, want = [], {}
    for i in range(60):
        words = [f"x{w}" for w in prose(rng, rng.randrange(600)).split()]
        label, notice = rng.choice([("middle", middle), ("body", body), ("mit", L.NOTICES[0][0])])
        notice = notice.split()
        cut = rng.random() < 0.5 and label != "mit"
        at = rng.randrange(len(words) + 1)
        words[at:at] = notice[: len(notice) * 7 // 10] if cut else notice
        rows.append((i, " ".join(words)))
        want[i] = "" if cut else label
    got = {r.doc_id: r for r in L.license_scan(docs_table(spark, rows), notices=notices).collect()}
    assert {i: r.labels for i, r in got.items()} == want
    assert all(r.score == (1.0 if want[i] else 0.0) for i, r in got.items())


def test_blocks_of_short_notices_stay_short():
    table = L.notice_table([*L.NOTICES, ("a " * 33, "x"), ("b " * 65, "y")], L.THRESHOLD)
    own = [n["span"] for n in L.notice_table(L.NOTICES, L.THRESHOLD)]
    assert {s for (n, *_), s in zip(L.NOTICES, own) if len(n.split()) <= L.STRIDE} == {L.BLOCK}
    assert [n["span"] for n in table] == own + [2 * L.BLOCK, 4 * L.BLOCK]


DECLARED = {
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "a Creative Commons Attribution 4.0 International License": "",
    "work licensed under a Creative Commons Attribution-ShareAlike 4.0 International License":
        "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
    "International License": "cc-by-nc-nd",
    "licensed under CC BY-SA 4.0": "cc-by-sa",
    "licensed under CC BY 4.0": "cc-by",
    "licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",  # the first is a base label
    "released under the Apache license": "",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "distributed under the MIT license": "mit",
    "This work is licensed under the GNU Lesser General Public License version 3": "lgpl-3",
    "You can redistribute it and/or modify this program, which is free software, under the terms "
    "of the GNU General Public License": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of "
    "the GNU Affero General Public License": "agpl",
}


def test_notices_that_differ_in_a_word(spark):
    rows = [(i, f"Some words before. {t}. And some behind.") for i, t in enumerate(DECLARED)]
    got = {r.doc_id: r.labels for r in L.license_scan(docs_table(spark, rows)).collect()}
    assert got == dict(enumerate(DECLARED.values()))
    check(spark, rows)


def test_whole_wording(spark):
    """A licence whose first sentence is worded anew is found by the rest of it."""
    rng = random.Random(11)
    rows, want = [], []
    for text, label, *_ in L.NOTICES:
        words = text.split()
        if len(words) > 60:
            rest = words[12:]
            rows.append((len(rows), " ".join([prose(rng, 90), *rest, prose(rng, 300)])))
            rows.append((len(rows), " ".join([prose(rng, 90), *rest[: len(rest) // 2]])))
            want += [label, None]
    got = {r.doc_id: r.labels for r in L.license_scan(docs_table(spark, rows)).collect()}
    assert all(w is None or w in got[i].split(",") for i, w in enumerate(want))
    check(spark, rows)


def test_places_may_overlap(spark):
    rows = [(1, "a a a b a a"), (2, "a b a"), (3, "A-a a a")]
    got = L.license_scan(docs_table(spark, rows), phrases={"a a": "x"}).collect()
    assert sorted((r.doc_id, r.n_base, r.first_word, r.last_word) for r in got) == [
        (1, 3, 0, 4), (2, 0, None, None), (3, 3, 0, 2)]


def test_marks_are_words_of_their_notice():
    with pytest.raises(ValueError):
        L.notice_table([("some words", "x", "others")], 0.8)
