"""Toxicity scores by a weighted finite-state grammar over clauses.

A lexicon turns the words of a clause into tags; five small transducers (insult, threat,
target, negation, reported speech) read the tags and are composed into one. What
counts for a match is where in the composed machine it stands: an insult may be plain,
aimed at somebody, negated or reported, and adds its weight to that sum. A logistic
model over the four sums gives the score.

The lexicon's weights are learned: words, and stems that words begin with, which labelled
toxic texts hold far more often than clean ones. Learning reads a bounded sample of the
labelled rows (``SAMPLE``); scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage

#: labelled rows that learning reads, about
SAMPLE = 20_000
#: share of the toxic texts that must hold a pattern, and the least number
SUPPORT, LEAST_SUPPORT = 0.01, 3
#: a pattern's weight is the log ratio of its shares in toxic and clean texts less so many
#: standard errors, so that chance finds among rare patterns weigh little; kept from ...
DOUBT, LEAST_WEIGHT = 1.25, 2.2
STEM_LENGTHS = range(3, 9)
#: largest share of a stem's texts that one continuation may have
ONE_WORD = 0.6
#: words whose tags a task keeps
KNOWN_WORDS = 1 << 17
KINDS = ["plain", "aimed", "negated", "reported"]

#: small lists for the tags; what is learned comes on top
INSULTS = (
    "idiot moron imbecile stupid dumb pathetic worthless disgusting scum trash loser clown "
    "jerk fool scumbag dumbass bastard bitch asshole vermin parasite subhuman"
).split()
THREATS = "kill hurt destroy strangle stab shoot murder töten umbringen tuer frapper matar".split()
INTENTS = "will shall gonna going must werde wirst vais va voy vamos".split()
TARGETS = "you your yours yourself they them he she du dich dir ihr toi vous tú usted ustedes".split()
NEGATIONS = "not never isn aren don doesn didn won nicht kein keine nie jamais nunca jamás".split()
REPORTS = (
    "said says say wrote writes quoted claimed called calls alleged reported sagte schrieb "
    "dit disait écrit dijo dice escribió"
).split()
PRIOR_WEIGHT = 2.5

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_END = frozenset(".!?;\n")
OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)

# --- the grammar: (state, tag) -> (state, mark); any other tag keeps or follows ``rest`` ---


def insult_machine() -> dict:
    return {"rest": {0: 0}, (0, INSULT): (0, "hit"), (0, THREAT): (0, "hit")}


def threat_machine() -> dict:
    """A threat counts double after a word of intent."""
    return {"rest": {0: 0, 1: 1}, (0, INTENT): (1, None), (1, THREAT): (0, "double")}


def target_machine() -> dict:
    return {"rest": {0: 0, 1: 1}, (0, TARGET): (1, None), (1, INSULT): (1, "aimed"),
            (1, THREAT): (1, "aimed")}


def negation_machine(scope: int = 3) -> dict:
    """A negation reaches over the next words."""
    table: dict = {"rest": {s: max(0, s - 1) for s in range(scope + 1)}}
    for s in range(scope + 1):
        table[s, NEGATION] = (scope, None)
        if s:
            table[s, INSULT] = table[s, THREAT] = (s - 1, "negated")
    return table


def report_machine() -> dict:
    return {"rest": {0: 0, 1: 1}, (0, REPORT): (1, None), (1, INSULT): (1, "reported"),
            (1, THREAT): (1, "reported")}


def compose(*machines: dict) -> dict:
    """The product of the machines over the states that the start reaches.

    ``(state, tag) -> (state, kind, factor)``; kind is None without a hit. A report
    outweighs a negation, and that an aim.
    """
    start = (0,) * len(machines)
    numbers, todo, table = {start: 0}, [start], {}
    while todo:
        states = todo.pop()
        for tag in range(7):
            steps = [m.get((s, tag), (m["rest"][s], None)) for m, s in zip(machines, states)]
            marks = {mark for _, mark in steps}
            goal = tuple(s for s, _ in steps)
            if goal not in numbers:
                numbers[goal] = len(numbers)
                todo.append(goal)
            kind = None
            if "hit" in marks:
                kind = next((k for k in ("reported", "negated", "aimed") if k in marks), "plain")
            table[numbers[states], tag] = (
                numbers[goal], None if kind is None else KINDS.index(kind),
                2.0 if "double" in marks else 1.0,
            )
    return table


GRAMMAR = compose(insult_machine(), threat_machine(), target_machine(), negation_machine(),
                  report_machine())
_TAGS = {w: t for t, words in ((INSULT, INSULTS), (THREAT, THREATS), (INTENT, INTENTS),
                               (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
         for w in words}


class Lexicon(dict):
    """Tag and weight of a word, from learned words and stems and the lists above."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        super().__init__()
        self.words, self.stems = words, stems

    def __missing__(self, word: str) -> tuple[int, float] | None:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        weight = max([self.words.get(word, 0.0), *(
            self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if n < len(word))])
        tag = _TAGS.get(word, OTHER)
        if weight > 0 and tag in (OTHER, INSULT):
            found = (INSULT, weight)
        elif tag in (INSULT, THREAT):
            found = (tag, PRIOR_WEIGHT)
        else:
            found = (tag, 0.0) if tag else None
        self[word] = found
        return found


def clause_sums(text: str | None, lexicon: Lexicon) -> list[float]:
    """The weights of a text's matches by kind, each word once, and the number of tokens."""
    sums, state, seen = [0.0] * len(KINDS), 0, set()
    tokens = _TOKEN.findall((text or "").lower())
    for token in tokens:
        if token in _END:
            state = 0
            continue
        known = lexicon[token]
        if known is None:
            if state:
                state = GRAMMAR[state, OTHER][0]
            continue
        tag, weight = known
        state, kind, factor = GRAMMAR[state, tag]
        if kind is not None and (token, kind) not in seen:
            seen.add((token, kind))
            sums[kind] += weight * factor
    return [*sums, float(len(tokens))]


def score_of(sums: list[float], model: list[float]) -> float:
    """Logistic score; ``model`` has an intercept and slopes for each kind and the length."""
    x = model[0] + sum(b * math.log1p(s) for b, s in zip(model[1:], sums))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def fit_logistic(sums: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Ridge regression by Newton steps, drawn to a cautious grammar where rows are few."""
    prior = np.array([-4.0, 2.5, 3.0, 1.0, 1.0, -0.2])
    pull = np.array([0.05, 0.5, 0.5, 0.5, 0.5, 0.5])
    if not len(toxic) or toxic.min() == toxic.max():
        return prior.tolist()
    x = np.column_stack([np.ones(len(sums)), np.log1p(sums)])
    w = prior.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        step /= max(1.0, np.abs(step).max() / 0.5)  # far from the optimum the curve misleads
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    # more matches never speak for a text, nor does length against it
    return np.r_[w[0], np.maximum(w[1:-1], 0), min(w[-1], 0)].tolist()


# --- learning ---


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``text, toxic, fold`` of about ``limit`` labelled rows outside fold 0, equal texts once.

    The rows are those whose hashed id is below a bound, so each label has the same chance.
    """
    own = labels.where(fold(F.col("doc_id")) != 0).where("toxic is not null").groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("toxic"))
    n = own.count()
    share = min(1.0, limit / max(1, n))
    bound = round(share * (1 << 20))

    def drawn(doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < bound

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(drawn(F.col("_id")))
    rows = texts.join(own.where(drawn(F.col("_id"))), "_id").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"),
        fold(F.col("_id")).cast("int").alias("fold"), F.xxhash64("text").alias("_h"))
    # which of equal texts stays does not depend on the order of rows
    once = rows.groupBy("_h", "toxic").agg(F.min("text").alias("text"), F.min("fold").alias("fold"))
    return stage(once.drop("_h"), "labelled")


def patterns_of(text: str) -> set[tuple[str, bool]]:
    """The words of a text, and the stems that words of it are longer than."""
    words = {w for w in _TOKEN.findall(text.lower()) if w not in _END}
    stems = {(w[:n], True) for w in words for n in STEM_LENGTHS if n < len(w)}
    return stems | {(w, False) for w in words}


def _counter(wanted: set | None):
    schema = pa.schema([("pattern", pa.string()), ("stem", pa.bool_()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                counts: Counter = Counter()
                for text in batch.slice(part, 500).column(0).to_pylist():
                    found = patterns_of(text)
                    counts.update(found if wanted is None else found & wanted)
                yield pa.record_batch([
                    pa.array([p for p, _ in counts], pa.string()),
                    pa.array([s for _, s in counts], pa.bool_()),
                    pa.array(list(counts.values()), pa.int64())], schema)

    return run


def count_patterns(texts: DataFrame, wanted: set | None, least: int) -> dict:
    counts = texts.select("text").mapInArrow(
        _counter(wanted), "pattern string, stem boolean, n long")
    total = counts.groupBy("pattern", "stem").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return {(r["pattern"], r["stem"]): r["n"] for r in total.collect()}


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems: log ratios of their shares in toxic and clean texts.

    A pattern must be in ``SUPPORT`` of the toxic texts, which bounds how many there are.
    """
    n_toxic = sample.where("toxic = 1").count()
    n_clean = sample.where("toxic = 0").count()
    least = max(LEAST_SUPPORT, math.ceil(SUPPORT * n_toxic))
    toxic = count_patterns(sample.where("toxic = 1"), None, least)
    clean = count_patterns(sample.where("toxic = 0"), set(toxic), 1)
    # a stem stands for many words: none of its continuations may make up most of it
    widest: dict[str, int] = {}
    for (pattern, _), t in toxic.items():
        widest[pattern[:-1]] = max(t, widest.get(pattern[:-1], 0))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for (pattern, stem), t in toxic.items():
        if stem and widest.get(pattern, 0) > ONE_WORD * t:
            continue
        c = clean.get((pattern, stem), 0) + 0.5
        weight = math.log((t + 0.5) / (n_toxic + 1)) - math.log(c / (n_clean + 1))
        weight -= DOUBT * math.sqrt(1 / (t + 0.5) + 1 / c)
        if weight >= LEAST_WEIGHT:
            (stems if stem else words)[pattern] = weight
    return words, stems


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> dict:
    """Lexicon and logistic model: patterns from folds 2 to 4, slopes from fold 1."""
    sample = labelled_sample(docs, labels, sample_rows)
    words, stems = learn_lexicon(sample.where("fold > 1"))
    names = [*KINDS, "tokens"]
    ddl = "toxic int, " + ", ".join(f"{k} double" for k in names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(words, stems)
        for batch in batches:
            rows = [clause_sums(t, lexicon) for t in batch.column(0).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array(c, pa.float64()) for c in columns)],
                ["toxic", *names])

    # a fifth of the sample
    rows = sample.where("fold = 1").select("text", "toxic").mapInArrow(sums, ddl).toPandas()
    model = fit_logistic(rows[names].to_numpy(float), rows["toxic"].to_numpy(float))
    return {"words": words, "stems": stems, "model": model}


# --- scoring ---


def text_scores(texts: Iterable[str | None], learned: dict, lexicon: Lexicon) -> list[float]:
    return [score_of(clause_sums(t, lexicon), learned["model"]) for t in texts]


def score_documents(docs: DataFrame, learned: dict) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, from its text alone.

    A null or empty text has no match and gets the score of the intercept. A null doc_id is
    not held out. Repeated rows are scored one by one; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned["words"], learned["stems"])
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                cut = batch.slice(part, 500)
                scores = text_scores(cut.column(2).to_pylist(), learned, lexicon)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), cut.column(1), pa.array(scores, pa.float64()),
                     pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, learned: dict) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below one half."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(learned["words"], learned["stems"])
        for batch in batches:
            scores = text_scores(batch.column(at).to_pylist(), learned, lexicon)
            yield batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
