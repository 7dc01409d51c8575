"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_table(spark, rows, extra=()):
    """``(doc_id, text)`` rows as a documents table over several partitions.

    ``extra`` names further string columns, which operators must leave alone.
    """
    ddl = DOCS + "".join(f", {name} string" for name in extra)
    data = [(i, t, "en", "s", len(t) if t is not None else None, *("x" for _ in extra))
            for i, t in rows]
    return spark.createDataFrame(data, ddl).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward_rows(seed=0):
    """Null, empty, white, very long and repeated texts, null and repeated ids."""
    rng = random.Random(seed)
    text = prose(rng, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, prose(rng, 6000)), (5, text), (6, text), (6, text),
        (7, text + " end"), (None, "no id here"), (None, text), (8, "ß É 日本 \x00 x"), (9, "one"),
        (10, prose(rng, 90)),
    ]
