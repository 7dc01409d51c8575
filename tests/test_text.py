import ast

from pyspark.sql import functions as F

from namesmith.constants import NULL_TOKENS
from namesmith.functions import text


def column(spark, values, kind, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")
    return [r[1] for r in rows.select("id", build(F.col("v"))).orderBy("id").collect()]


def test_strip_comments(spark):
    bodies = [
        'String u="http://z"; b(); // c\ne(); // end',
        "a /* x\n y */ b /* z */ c",
        "a // b /* c\n d */ e",
        "x // one\r// two\ny",
    ]
    assert column(spark, bodies, "string", text.strip_comments) == [
        'String u="http: e(); // end'.replace(" e()", "e()"),
        "a  b  c",
        "a // b  e",
        "x y",
    ]


def test_clean_and_fill(spark):
    raw = ["ab cde1fgh  xyz!", "123", "", None, "çabc dé", "getName"]
    cleaned = column(spark, raw, "string", text.clean_generated_name)
    assert cleaned == ["cde", "", "", None, "abc", "getName"]
    filled = column(spark, [*cleaned, " \t\n"], "string", text.fill_missing_prediction)
    missing = "<no_prediction>"
    assert filled == ["cde", missing, missing, missing, "abc", "getName", missing]


def test_null_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in NULL_TOKENS] + [("Nan",), (" ",), ("0",)], "v string")
    kept = text.null_tokens(rows, ["v"]).where("v is not null").collect()
    assert sorted(r.v for r in kept) == [" ", "0", "Nan"]


LISTS = [
    [],
    ["a", "b"],
    ['@A("x,y")', "public"],
    ["@X('c')"],
    ["@Y(\"it's\")"],
    ["form\x0cfeed", "tab\tnew\nline", "back\\slash", "\\x41 \\U00000041"],
    ["é", " ", "\U0001f600", "\U000e0001 tag", "\xa0", "", " "],
    ["// c\\", "a'b\"c"],
]


def test_list_literals(spark):
    printed = [repr(items) for items in LISTS]
    assert column(spark, printed, "string", text.parse_list_literal) == LISTS
    rendered = column(spark, LISTS, "array<string>", text.render_list_literal)
    assert [ast.literal_eval(cell) for cell in rendered] == LISTS
    same = [i for i in range(len(LISTS)) if i != 6]
    assert [rendered[i] for i in same] == [printed[i] for i in same]


def test_decode_text(spark):
    raw = [
        "plain\r\nx\ry\n".encode(),
        "naïve".encode(),
        "naïve".encode("latin-1"),
        b"\xef\xbb\xbfbom",
        b"\xff\xfe",
        b"",
    ]
    assert column(spark, raw, "binary", text.decode_text) == [
        "plain\nx\ny\n", "naïve", "naïve", "﻿bom", "ÿþ", "",
    ]


def test_modifier_texts(spark):
    rows = [["@A('x')", "public", "@B", "static,"], [], ["final"]]
    assert column(spark, rows, "array<string>", text.format_annotations) == ["@A(x)\n@B", "", ""]
    assert column(spark, rows, "array<string>", text.format_keywords) == ["public static", "", "final"]
