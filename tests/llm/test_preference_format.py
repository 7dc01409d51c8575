import random

from namesmith.llm import preference_format as P

TURNS = "conv_id long, turn long, role string, text string"
PAIRS = ("pair_id long, chosen array<struct<turn:bigint,role:string,text:string>>, "
         "rejected array<struct<turn:bigint,role:string,text:string>>")


def render(turns):
    out, spans = "", []
    for _, role, text in turns:
        plain = [(x or "").replace("<|", "< |") for x in (role, text)]
        out += f"<|im_start|>{plain[0]}\n"
        start = len(out)
        out += plain[1] + "<|im_end|>\n"
        if role == "assistant":
            spans.append((start, len(out)))
    return out, spans


def expected(pair_id, chosen, rejected):
    a, b = chosen or [], rejected or []
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    (c, cs), (r, rs) = render(a[n:]), render(b[n:])
    return pair_id, n, render(a[:n])[0], c, r, cs, rs


def check(spark, pairs):
    df = P.format_preferences(spark.createDataFrame(pairs, PAIRS))
    got = [(*r[:5], [tuple(s) for s in r[5]], [tuple(s) for s in r[6]]) for r in df.collect()]
    assert sorted(got, key=str) == sorted((expected(*p) for p in pairs), key=str)


def test_random_pairs(spark):
    rng = random.Random(4)

    def turns(n):
        return [(i, rng.choice(["user", "assistant", None]), rng.choice(["a", "b<|x", "", None]))
                for i in range(n)]

    pairs = []
    for i in range(80):
        shared = turns(rng.randrange(4))
        pairs.append((i, shared + turns(rng.randrange(3)), shared + turns(rng.randrange(3))))
    check(spark, pairs)


def test_awkward_pairs(spark):
    one = [(0, "user", "hi"), (1, "assistant", "x" * 100_000)]
    check(spark, [(1, None, None), (2, [], one), (3, one, one), (3, one, one), (None, one, one[:1])])
    assert P.format_preferences(spark.createDataFrame([], PAIRS)).collect() == []


def test_pairs_of_conversations(spark):
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", "q"), (1, 2, "user", "r"), (1, 3, "assistant", "B"),
            (1, 4, "user", "last"), (2, 0, "user", "alone"), (3, 0, "assistant", "only"),
            (None, 0, "user", None), (4, 0, "user", "t"), (4, 0, "user", "t")]
    df = P.repeated_reply_pairs(P.conversation_turns(spark.createDataFrame(rows, TURNS)))
    made = {r.pair_id: ([t.text for t in r.chosen], [t.text for t in r.rejected]) for r in df.collect()}
    assert made == {
        1: (["q", "A", "r", "B"], ["q", "A", "r", "A"]), 2: (["alone"], ["alone"]),
        3: (["only"], [""]), None: ([None], [None]), 4: (["t", "t"], ["t", "t"])}
    assert P.preferences_of(spark.createDataFrame(rows, TURNS)).count() == 5
    assert P.preferences_of(spark.createDataFrame([], TURNS)).collect() == []
