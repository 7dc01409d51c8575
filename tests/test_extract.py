import random
import tracemalloc
from pathlib import Path

import pytest

from checks import sources, views  # noqa: F401
from checks.registry import QUERIES
from namesmith.operators import java_scan
from namesmith.operators.extract import extract_methods, number_methods, register_java_methods
from namesmith.operators.java_scan import scan_methods
from namesmith.sources.files import read_source_files, scan_source_files

SOURCE = '''package a.b;
import static x.y.Z.*;
/** doc { */
@Ann({"a","b"}) public final class Foo<T extends Comparable<T>> extends Bar implements Q {
  private static final Runnable R = new Runnable() { @Override public void run() { go("}"); } };
  int[] data = {1,2,3}, more = {4};
  static { int x = 1; if (x > 0) { foo(); } }
  Foo(int a) { this.a = a; class Local { int lm() { return 1; } } }
  @Override // c1
  public /* c2 */ String toString() { return "{"; }
  public <K, V extends Map<K, List<V>>> Map<K, List<V>> gen(Map<K,V> m, @A(x=1) int... z) throws IOException { return new HashMap<K, List<V>>() {{ put(1,2); }}; }
  abstract int[] arr(int a);
  Map.Entry en();
  Outer<String>.Inner in2() { return null; }
  native long nat();
  boolean b() { return x == Foo.class; }
  double d()[] { switch (y) { case 1: { break; } default: class Z { char zz() { return '}'; } } } return null; }
  enum E { A, B(1, "x") { void eb() {} }, C { float ef() { return 1f; } }; private final int i; E() {} E get() { return A; } }
  @interface Note { String value() default "x"; int n() default 3; class In { short sh() { return 1; } } }
  interface I { default void dm() { list.forEach(x -> { new Thread(() -> {}) { public void run() {} }.start(); }); } int q(); }
  record P(int a, int b) implements I { P { if (a<0) throw new X(); } static byte mk() { return 1; } }
  String tb() { return """
     void fake() { } " \\""" }
     """; }
  void last() { Comparator<String> c = new Comparator<>() { public int compare(String a, String b) { return new Object() { int hid() { return 1;} }.hid(); } }; }
}
'''

NAMES = [
    ("run", "void_type"), ("lm", "integral_type"), ("toString", "type_identifier"),
    ("gen", "generic_type"), ("arr", None), ("en", "scoped_type_identifier"),
    ("in2", "scoped_type_identifier"), ("nat", "integral_type"), ("b", "boolean_type"),
    ("d", "floating_point_type"), ("zz", "integral_type"), ("eb", "void_type"),
    ("ef", "floating_point_type"), ("get", "type_identifier"), ("sh", "integral_type"),
    ("dm", "void_type"), ("run", "void_type"), ("q", "integral_type"), ("mk", "integral_type"),
    ("tb", "type_identifier"), ("last", "void_type"), ("compare", "integral_type"),
    ("hid", "integral_type"),
]


def kind(method):
    return next((k for k in method if k.endswith(("_type", "_identifier"))), None)


def test_declarations_in_order():
    methods = scan_methods(SOURCE)
    assert [(m["identifier"], kind(m)) for m in methods] == NAMES
    by_name = {m["identifier"]: m for m in methods}
    assert by_name["toString"]["modifiers"] == ["@Override", "// c1", "public"]
    assert by_name["toString"]["block"] == '{ return "{"; }'
    assert by_name["gen"]["formal_parameters"] == "(Map<K,V> m, @A(x=1) int... z)"
    assert by_name["gen"]["generic_type"] == "Map<K, List<V>>"
    assert by_name["in2"]["scoped_type_identifier"] == "Outer<String>.Inner"
    assert by_name["arr"]["block"] is None and by_name["arr"]["modifiers"] == ["abstract"]


@pytest.mark.parametrize(
    "text, names",
    [
        ("", []),
        ("class A { A() {} }", []),
        ("class A { int a = b(1); int c = (d) -> { return 1; }; }", []),
        ("class A { void f() { g(new int[]{1}); } void h(); }", ["f", "h"]),
        ("class A { void f() { for (int i = 0; i < 3; i++) { } } }", ["f"]),
        ("class A { void f() { try (R r = o(); S s = p()) { } } int g() {} }", ["f", "g"]),
        ("class A { void f() { int x = switch (y) { case 1 -> { yield 2; } }; } }", ["f"]),
        ("public @interface N { int v(); }", []),
        ("enum E { A, B; }", []),
        ("module m { requires x; exports y; }", []),
        ("class A { char c = '{'; String s = \"\\\"{\"; void f() {} }", ["f"]),
        ("class A { <T> T f(T t) { return t; } }", ["f"]),
        ("class A { @B(x = {1, 2}) void f() {} }", ["f"]),
        ("class A { void f() {} }}} class B { void g() {} }", ["f", "g"]),
        ("class A { void f() { if (a) { ", ["f"]),
        ("\ufeffclass A { void f() { } }", ["f"]),
        ("@ interface N { int v(); class B { int w() { } } }", ["w"]),
        ("class A { @B(C.class) @D void f(E<F.class> x) { g(C.class, () -> { }); } }", ["f"]),
        ("sealed interface S permits T { void f(); } non-sealed class T { public void f() { } }", ["f", "f"]),
        ("class A { <T> A(T t) { } public A() throws X { } A.B c() { } }", ["c"]),
        ("class A { void f() { label: for (;;) { class L { void g() { } } } } }", ["f", "g"]),
        ("class A { int a = x < y ? b(1) : c(2); int f() { return a < b ? 1 : 2; } }", ["f"]),
        ("class A { java.util.@B List<String> f() { } int @B [] g() { } }", ["f", "g"]),
        ("class A { Runnable r = () -> { new Object() { void f() { } }; }; void g() { } }", ["f", "g"]),
        ("class A { void f() throws @B(1) C, D { } synchronized void g() { synchronized (x) { } } }", ["f", "g"]),
        ("interface I { static <T> void f() { } private int g() { return 1; } int h() ; }", ["f", "g", "h"]),
        ("class A { Object o = new B(new C() { int in() { return 1; } }) { int out() { } }; }", ["in", "out"]),
    ],
)
def test_small_sources(text, names):
    assert [m["identifier"] for m in scan_methods(text)] == names


def test_unterminated_body():
    (method,) = scan_methods("public static int sumTwoNumbers(int a, int b){\n")
    assert method == {
        "identifier": "sumTwoNumbers", "formal_parameters": "(int a, int b)",
        "modifiers": ["public", "static"], "block": "{", "integral_type": "int",
    }


def test_scan_is_linear():
    deep = "class A { void f() { " + "if (a) { " * 5_000 + "} " * 5_000 + "} }"
    assert len(scan_methods(deep)) == 1
    assert len(scan_methods("class A { int x; }\n" * 20_000)) == 0


@pytest.fixture
def tree(tmp_path):
    for name, body in {
        "a/X.java": "class X { public int one() { return 1; } void two() { } }",
        "a/b/Y.java": "class Y { boolean three(); }",
        "a/Z.JAVA": "class Z { void no() { } }",
        "a/readme.txt": "void no() { }",
        ".hidden/H.java": "class H { void four() { } }",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / "a" / "L.java").write_bytes("class L { /* é */\r\n void five() {\r\n} }".encode("latin-1"))
    return tmp_path


def test_directory(spark, tree):
    files = read_source_files(spark, str(tree))
    rows = number_methods(extract_methods(files)).orderBy("id").collect()
    assert [(r.id, r.identifier) for r in rows] == [
        (0, "four"), (1, "five"), (2, "one"), (3, "two"), (4, "three"),
    ]
    assert rows[1].block == "{\n}"
    assert rows[2].file_path == f"{tree}/a/X.java"
    # a file that two roots reach is read once
    both = read_source_files(spark, [str(tree), str(tree / ".hidden")])
    assert extract_methods(both).count() == 5


def test_no_name_is_left_out(spark, tmp_path):
    names = ["a/X.java", "a/_Y.java", "a/.Z.java", "_gen/W.java", "a/.h/V.java"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())

    def found(*roots):
        return {r.path: bytes(r.content).decode() for r in scan_source_files(spark, list(roots)).collect()}

    every = {f"{tmp_path}/{name}": name for name in names}
    assert found(str(tmp_path)) == found(f"file://{tmp_path}") == every
    assert found(f"{tmp_path}/a/_Y.java") == {f"{tmp_path}/a/_Y.java": "a/_Y.java"}
    assert set(found(f"{tmp_path}/a/*.java").values()) == {"a/X.java", "a/_Y.java", "a/.Z.java"}
    assert set(found(f"{tmp_path}/*/.h").values()) == {"a/.h/V.java"}
    (tmp_path / "none").mkdir()
    assert found(f"{tmp_path}/none") == {}
    with pytest.raises(Exception, match="missing"):
        found(f"{tmp_path}/missing")


def test_table_function(spark, tree):
    register_java_methods(spark)
    read_source_files(spark, str(tree)).createOrReplaceTempView("tree_files")
    rows = spark.sql(
        "select m.identifier, m.method_no, m.modifiers from tree_files f,"
        " lateral java_methods(f.file_path, f.text) m order by m.file_path, m.method_no"
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("four", 0, []), ("five", 0, []), ("one", 0, ["public"]), ("two", 1, []), ("three", 0, []),
    ]


MEMBERS = [
    "int a;", "void b() { go(1); }", "@A(x) @B(y) int c(@P(1) int d) { if (e) { } }", "{ go(); }",
    "X f = new X() { @Q(2) void g() { h(); } };", "X i = k(new X() { void l() { } }, 3);",
    "@R(4) void m(int n) throws O;", "enum S { T(5) { void u() { } }, V; void w() { } }",
    "void open(", "class Y { @Z(6) void aa() { Runnable r = new R() { void bb() { } }; } }", "}", ")",
]


def test_methods_of_ended_members_are_not_kept(monkeypatch):
    rng = random.Random(5)
    texts = ["class C { " + " ".join(rng.choices(MEMBERS, k=30)) for _ in range(300)]
    whole = [java_scan.scan_methods(t) for t in texts]
    assert sum(map(len, whole)) > 2000
    monkeypatch.setattr(java_scan, "_CLOSED", 0)
    assert [java_scan.scan_methods(t) for t in texts] == whole

    text = "class C {" + " @A(1) void b(int c) { d(e); }" * 40_000 + "}"
    tracemalloc.start()
    try:
        assert sum(1 for _ in java_scan.each_method(text)) == 40_000
        assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    finally:
        tracemalloc.stop()


def test_written_files_grow_in_number_not_in_size(spark, tmp_path):
    n = 24_000  # more than four tasks write to four files of 5,000
    rows = spark.range(0, n, 1, 1)
    rows.selectExpr(
        "id + 1 as p_partkey", "concat('red p', id) as p_name", "'Brand#11' as p_brand",
        "'STANDARD' as p_type", "cast(id % 50 as int) as p_size",
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    scanned = QUERIES["scan_source_files"](spark, str(tmp_path))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    root = max(shared.glob("sources-*"), key=lambda p: p.stat().st_mtime)
    sizes = [p.read_text().count("public class M") for p in root.glob("part-*")]
    assert max(sizes) <= 5_000 and len(sizes) > 4
    names = scanned.where("identifier <> 'run'").count()
    assert names == sum(sizes) == views.spark_view(spark, str(tmp_path), "source_text").count()
