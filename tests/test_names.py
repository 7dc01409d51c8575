from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namesmith.functions import names
from namesmith.functions.sequences import _lcs, lcs_length

EDGES = {
    "getURLForHTTPRequest": ["get", "url", "for", "http", "request"],
    "methodName": ["method", "name"],
    "XMLParser": ["xml", "parser"],
    "ABCd": ["ab", "cd"],
    "a": ["a"],
    "A": ["a"],
    "": [],
    "<no_prediction>": ["<no_prediction>"],
    "item1Foo": ["item1foo"],
    "test_fooBar": ["test_foo", "bar"],
    "toString$x": ["to", "string$x"],
    "__init": ["__init"],
    "çaVa": ["ça", "va"],
    "ab\ncd": ["cd"],
}


def python_subwords(name):
    """A walk over the characters: where does a new word begin?"""

    def lower(c):
        return "a" <= c <= "z"

    def upper(c):
        return "A" <= c <= "Z"

    words = []
    for i, c in enumerate(name):
        before, after = name[i - 1 : i], name[i + 1 : i + 2]
        begins = upper(c) and (lower(before) or upper(before) and lower(after))
        if begins or not words:
            words.append("")
        words[-1] += c.lower()
    return words


def run(spark, values, schema, *columns):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], f"id int, {schema}")
    return [tuple(r)[1:] for r in rows.select("id", *columns).orderBy("id").collect()]


def test_edge_names(spark):
    got = run(spark, [(n,) for n in EDGES], "n string", names.split_camel_case("n"), names.spaced_name("n"))
    assert got == [(words, " ".join(words)) for words in EDGES.values()]


identifiers = st.lists(
    st.text(alphabet="abzABZ019_$", max_size=14), min_size=60, max_size=60
)


@settings(max_examples=4, deadline=None)
@given(identifiers)
def test_random_names(spark, batch):
    got = run(spark, [(n,) for n in batch], "n string", names.split_camel_case("n"))
    for name, (words,) in zip(batch, got):
        assert words == python_subwords(name)
        assert "".join(words) == name.lower()


def test_ngrams_never_count_down(spark):
    values = [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)]
    got = run(spark, values, "w array<string>", names.ngrams("w", 2), names.ngrams("w", 1))
    assert [g[0] for g in got] == [[], [], [["a", "b"]], [["a", "b"], ["b", "c"]]]
    assert [g[1] for g in got] == [[], [["a"]], [["a"], ["b"]], [["a"], ["b"], ["c"]]]


words = st.lists(st.sampled_from("abcd"), max_size=6)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=40, max_size=40))
def test_overlap_and_subsequence(spark, batch):
    got = run(
        spark, batch, "a array<string>, b array<string>",
        names.multiset_overlap("a", "b"), names.multiset_overlap("b", "a"), lcs_length("a", "b"),
    )
    for (a, b), (ab, ba, lcs) in zip(batch, got):
        assert ab == ba == sum((Counter(a) & Counter(b)).values()) <= min(len(a), len(b))
        assert lcs == table_lcs(a, b) == _lcs(b, a)


def table_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = (
                table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            )
    return table[-1][-1]


def test_levenshtein_and_characters(spark):
    got = run(
        spark, [("kitten", "sitting"), ("é", "e"), ("", "abc"), ("A", "a")], "a string, b string",
        names.levenshtein("a", "b"), names.char_tokens(F.concat("a", F.lit("_1"), "b")),
    )
    assert [g[0] for g in got] == [3, 1, 3, 1]
    assert got[0][1] == list("kitten1sitting")
    assert got[1][1] == ["1", "e"]
