"""Name functions, metrics, set operations and the whole flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import names
from namesmith.operators import align, breakdown, metrics, overlap
from namesmith.operators.encode import build_vocab
from namesmith.plans.flow import (
    build_examples, build_methods, compare_predictors, evaluate_model, evaluate_stored,
    score_predictors,
)
from namesmith.sources.files import decode_files
from namesmith.sources.tables import read_predictions, report, write_predictions
from namesmith.storage import fresh_path, stage

from . import models, sql, views
from .registry import check


def r6(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, *[r6(name).alias(name) for name in df.columns if name not in keep]
    )


@check(
    "split_camel_case",
    f"""{views.ctes('fx')}
select id, {sql.joined(sql.subwords('identifier'))} as words,
 coalesce(array_to_string({sql.subwords('identifier')}, ' '), '') as spaced from fx""",
)
def subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fx(spark, sf_dir).select(
        "id",
        F.array_join(names.split_camel_case("identifier"), "|").alias("words"),
        names.spaced_name("identifier").alias("spaced"),
    )


@check(
    "ngrams",
    f"""{views.ctes('fx')}
select id, coalesce(array_to_string(list_transform({sql.ngrams('w', 2)},
 lambda g: array_to_string(g, ' ')), '|'), '') as grams
from (select id, {sql.subwords('identifier')} as w from fx)""",
)
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = names.ngrams(names.split_camel_case("identifier"), 2)
    joined = F.array_join(F.transform(grams, lambda g: F.array_join(g, " ")), "|")
    return views.fx(spark, sf_dir).select("id", joined.alias("grams"))


@check(
    "bag_count",
    f"""
select lang, gram, count(*) as n from (
 select lang, unnest(list_transform({sql.ngrams('w', 2)}, lambda g: array_to_string(g, ' '))) as gram
 from (select lang, regexp_extract_all(lower(text), '[a-z]+') as w from documents))
group by all""",
)
def bag_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word sequences of all documents, counted per language."""
    docs = views.working_table(spark, sf_dir, "documents")
    words = docs.select(
        "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w")
    )
    grams = words.select("lang", F.explode(names.ngrams("w", 2)).alias("g"))
    return align.bag_count(
        grams.select("lang", F.array_join("g", " ").alias("gram")), ["lang", "gram"]
    )


@check(
    "multiset_overlap",
    f"""{views.ctes('pairs')},
l as (select example_id, run_id, w, count(*) as n from (select example_id, run_id,
  unnest({sql.subwords('label')}) as w from pairs) group by all),
p as (select example_id, run_id, w, count(*) as n from (select example_id, run_id,
  unnest({sql.subwords('prediction')}) as w from pairs) group by all)
select example_id, run_id, coalesce(sum(case when p.n < l.n then p.n when p.n >= l.n then l.n end), 0)::bigint as common
from pairs left join l using (example_id, run_id) left join p using (example_id, run_id, w)
group by example_id, run_id""",
)
def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = names.multiset_overlap(
        names.split_camel_case("label"), names.split_camel_case("prediction")
    )
    return views.pairs(spark, sf_dir).select(
        "example_id", "run_id", common.cast("long").alias("common")
    )


@check(
    "levenshtein",
    f"""{views.ctes('pairs')}
select example_id, run_id, levenshtein(label, prediction) as distance from pairs""",
)
def levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pairs(spark, sf_dir).select(
        "example_id", "run_id", names.levenshtein("label", "prediction").cast("long").alias("distance")
    )


@check(
    "char_tokens",
    """
select conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]')) as n,
 md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]'), '')) as digest
from conversations""",
)
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = names.char_tokens("text")
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.size(chars).cast("long").alias("n"),
        F.md5(F.array_join(chars, "")).alias("digest"),
    )


def counted(relation: str) -> str:
    return f"""
select *, len(lw) as nl, len(pw) as np, {sql.overlap('lw', 'pw')} as common
from (select *, {sql.subwords('label')} as lw, {sql.subwords('prediction')} as pw from {relation})
"""


COUNTED = counted("pairs")


@check(
    "subword_matches",
    f"""{views.ctes('pairs', counted=COUNTED)}
select run_id, sum(common)::bigint as matches, sum(nl)::bigint as label_subwords,
 sum(np)::bigint as prediction_subwords from counted group by run_id""",
)
def subword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.subword_matches(views.pairs(spark, sf_dir))


@check(
    "subword_accuracy",
    f"""{views.ctes('pairs', counted=COUNTED)}
select run_id, round(sum(common) / sum(np), 6) as accuracy,
 round(sum(common) / sum(nl), 6) as accuracy_by_label from counted group by run_id""",
)
def subword_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.subword_accuracy(views.pairs(spark, sf_dir)), "run_id")


@check(
    "rouge_1_recall",
    f"""{views.ctes('pairs', counted=COUNTED)}
select run_id, round(avg(case when nl = 0 then 0 else common / nl end), 6) as rouge1
from counted group by run_id""",
)
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rouge_n_recall(views.pairs(spark, sf_dir)), "run_id")


@check(
    "rouge_2_recall",
    f"""{views.ctes('pairs', counted=COUNTED,
        grams=f"select run_id, {sql.ngrams('lw', 2)} as lg, {sql.ngrams('pw', 2)} as pg from counted")}
select run_id, round(avg(case when len(lg) = 0 then 0
 else {sql.overlap('lg', 'pg')} / len(lg) end), 6) as rouge2
from grams group by run_id""",
)
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.rouge_n_recall(views.pairs(spark, sf_dir), 2), "run_id")


@check(
    "mean_levenshtein",
    f"""{views.ctes('pairs')}
select run_id, round(avg(levenshtein(label, prediction)), 6) as levenshtein
from pairs group by run_id""",
)
def mean_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.mean_levenshtein(views.pairs(spark, sf_dir)), "run_id")


def similarity_ctes(relation: str) -> dict[str, str]:
    """Word vectors summed per name, then one cosine per distinct pair."""
    return {
        "all_names": f"select label as name from {relation} union select prediction from {relation}",
        "name_words": f"select name, unnest({sql.subwords('name')}) as word from all_names",
        "numbered": "select word, row_number() over (order by word) - 1 as vec_id"
        " from (select distinct word from name_words)",
        "vectors": "select word, embedding::double[] as vec from numbered"
        " join embeddings using (vec_id)",
        "dims": "select name, i, sum(vec[i]) as x from name_words join vectors using (word),"
        " (select unnest(generate_series(1, 64)) as i) group by all",
        "norms": "select name, sqrt(sum(x * x)) as norm from dims group by name",
        "distinct_pairs": f"select run_id, label, prediction, count(*) as copies from {relation}"
        " group by all",
        "dots": "select p.label, p.prediction, sum(a.x * b.x) as dot"
        " from (select distinct label, prediction from distinct_pairs) p"
        " join dims a on a.name = p.label join dims b on b.name = p.prediction and b.i = a.i"
        " group by all",
        "similarities": f"""
select run_id, copies, label, prediction, case
 when {sql.subwords('label')} = {sql.subwords('prediction')} then 1.0
 when coalesce(a.norm, 0) = 0 or coalesce(b.norm, 0) = 0 then 0.0
 else dot / (a.norm * b.norm) end as similarity
from distinct_pairs left join dots using (label, prediction)
left join norms a on a.name = label left join norms b on b.name = prediction""",
    }


SIMILARITY = similarity_ctes("pairs")


@check(
    "pair_similarity",
    f"""{views.ctes('pairs', **SIMILARITY)}
select run_id, label, prediction, copies, round(similarity, 6) as similarity from similarities""",
)
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stage(views.pairs(spark, sf_dir), "pairs")
    scored = metrics.pair_similarity(pairs, views.vectors(spark, sf_dir, pairs))
    return scored.withColumn("similarity", r6("similarity"))


@check(
    "mean_semantic_similarity",
    f"""{views.ctes('pairs', **SIMILARITY)}
select run_id, round(sum(similarity * copies) / sum(copies), 6) as similarity
from similarities group by run_id""",
)
def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stage(views.pairs(spark, sf_dir), "pairs")
    means = metrics.mean_semantic_similarity(pairs, views.vectors(spark, sf_dir, pairs))
    return rounded(means, "run_id")


BASIC = """
select run_id, count(*) as n, sum(common) / sum(np) as accuracy,
 sum(common) / sum(nl) as accuracy_by_label,
 avg(case when nl = 0 then 0 else common / nl end) as rouge1,
 avg(levenshtein(label, prediction)) as levenshtein
from counted group by run_id
"""


def evaluated(relation: str) -> dict[str, str]:
    return {
        "counted": counted(relation),
        "basic": BASIC,
        **similarity_ctes(relation),
        "metrics": """
select * from basic join (select run_id, sum(similarity * copies) / sum(copies) as similarity
 from similarities group by run_id) using (run_id)""",
    }


EVALUATED = evaluated("pairs")
ROUNDED = ", ".join(f"round({name}, 6) as {name}" for name in metrics.METRIC_NAMES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = stage(views.pairs(spark, sf_dir), "pairs")
    return metrics.evaluate(pairs, views.vectors(spark, sf_dir, pairs))


@check(
    "evaluate",
    f"{views.ctes('pairs', **EVALUATED)} select run_id, n, {ROUNDED} from metrics",
)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir), "run_id", "n")


@check(
    "evaluate_order_lines",
    f"""{views.ctes('line_pairs', **evaluated('line_pairs'))}
select run_id, n, {ROUNDED} from metrics""",
)
def evaluate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics over one pair per order line, grouped in three runs."""
    pairs = stage(views.line_pairs(spark, sf_dir), "pairs")
    return rounded(
        metrics.evaluate(pairs, views.vectors(spark, sf_dir, pairs)), "run_id", "n"
    )


@check(
    "report",
    f"""{views.ctes('pairs', **EVALUATED)}
select run_id, line_no, caption, round(value, 6) as value from (
 select run_id, 0 as line_no, 'Accuracy: ' as caption, format('{{:.2f}}', accuracy)::double as value
 from metrics
 union all select run_id, 1, 'ROUGE: ', format('{{:.2f}}', rouge1)::double from metrics
 union all select run_id, 2, 'Levenshtein Distance: ', levenshtein from metrics
 union all select run_id, 3, 'Semantic Similarity: ', format('{{:.2f}}', similarity)::double
 from metrics)""",
)
def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines; their numbers are read back, as the third is an unrounded float."""
    lines = report(scored(spark, sf_dir))
    number = F.regexp_extract("line", "[-0-9.E]+$", 0)
    return lines.select(
        "run_id", "line_no", F.expr("substring(line, 1, length(line) - length(regexp_extract(line, "
                                    "'[-0-9.E]+$', 0)))").alias("caption"),
        F.round(number.cast("double"), 6).alias("value"),
    )


MISSING_PAIRS = """
select run_id, case when label_id % 5 = 0 then '' else label end as label,
 case when label_id % 3 = 0 then '<no_prediction>' else prediction end as prediction
from (select *, length(label) + length(prediction) as label_id from pairs)
"""


@check(
    "evaluate_missing",
    f"""{views.ctes('pairs', gappy=MISSING_PAIRS, counted=counted('gappy'), basic=BASIC)}
select run_id, n, {', '.join(f'round({m}, 6) as {m}' for m in metrics.METRIC_NAMES[:4])} from basic
union all select 'empty', 0, 0.0, 0.0, 0.0, null""",
)
def evaluate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing labels and predictions, and a run without pairs."""
    size = F.length("label") + F.length("prediction")
    some = views.pairs(spark, sf_dir).withColumns({
        "label": F.when(size % 5 == 0, None).otherwise(F.col("label")),
        "prediction": F.when(size % 3 == 0, None).otherwise(F.col("prediction")),
    })
    return rounded(metrics.evaluate(some, runs=["base", "tuned", "empty"]), "run_id", "n")


def chars(name: str) -> str:
    return f"regexp_extract_all(lower({name}), '[a-z0-9]')"


def f1(common: str, a: str, b: str) -> str:
    return f"case when {a} + {b} = 0 then 0 else 2.0 * {common} / ({a} + {b}) end"


# longest common subsequence, one label character per step; a row of its table has a
# leading zero and grows by the best of: a hit after the cell before, above, left
LCS = """
select a, b, list_reduce(
  list_transform(a, lambda c: list_transform(b, lambda d: cast(c = d as bigint))),
  lambda above, hits: list_reduce(
    list_transform(generate_series(1, len(b)), lambda j: [above[j] + hits[j], above[j + 1]]),
    lambda row, cell: list_append(row, greatest(cell[1], cell[2], row[len(row)])), [0::bigint]),
  list_transform(generate_series(0, len(b)), lambda j: 0::bigint))[len(b) + 1] as lcs
from (select distinct a, b from tokens)
"""

CHAR_TOKENS = {
    "tokens": f"select run_id, {chars('label')} as a, {chars('prediction')} as b from pairs"
}


@check(
    "char_rouge",
    f"""{views.ctes('pairs', **CHAR_TOKENS, lcs=LCS,
        counts=f"""select run_id, len(a) as na, len(b) as nb, lcs, {sql.overlap('a', 'b')} as o1,
  greatest(len(a) - 1, 0) as na2, greatest(len(b) - 1, 0) as nb2,
  {sql.overlap('ga', 'gb')} as o2
  from (select *, {sql.ngrams('a', 2)} as ga, {sql.ngrams('b', 2)} as gb
        from tokens join lcs using (a, b))""")}
select run_id, round(avg({f1('o1', 'na', 'nb')}), 6) as rouge1,
 round(avg({f1('o2', 'na2', 'nb2')}), 6) as rouge2,
 round(avg({f1('lcs', 'na', 'nb')}), 6) as "rougeL",
 round(avg({f1('o1', 'na', 'nb')}), 6) as "rougeLsum"
from counts group by run_id""",
)
def char_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.char_rouge(views.pairs(spark, sf_dir)), "run_id")


@check(
    "compare_runs",
    f"""{views.ctes('pairs', **EVALUATED)},
tall as (unpivot (select run_id, {', '.join(metrics.METRIC_NAMES)} from metrics)
 on {', '.join(metrics.METRIC_NAMES)} into name metric value value)
select a.metric, round(a.value, 6) as base, round(b.value, 6) as candidate,
 round(b.value - a.value, 6) as delta, round(b.value / a.value, 6) as ratio
from tall a join tall b using (metric) where a.run_id = 'base' and b.run_id = 'tuned'""",
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.compare_runs(scored(spark, sf_dir), "base", "tuned"), "metric")


@check(
    "best_run",
    f"""{views.ctes('line_pairs', counted=counted('line_pairs'))}
select run_id, round(avg(case when nl = 0 then 0 else common / nl end), 6) as rouge1
from counted group by run_id order by rouge1 desc, run_id limit 1""",
)
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_run(metrics.evaluate(views.line_pairs(spark, sf_dir))), "run_id")


@check(
    "top_runs",
    f"""{views.ctes('line_pairs', counted=counted('line_pairs'))}
select run_id, round(avg(levenshtein(label, prediction)), 6) as levenshtein
from counted group by run_id order by avg(levenshtein(label, prediction)) desc, run_id limit 2""",
)
def top_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.evaluate(views.line_pairs(spark, sf_dir))
    best = metrics.top_runs(scores, by="levenshtein", keep=2)
    return rounded(best.select("run_id", "levenshtein"), "run_id")


@check(
    "lookup_join",
    f"""{views.ctes('fx')}
select l_orderkey, l_linenumber, l_partkey, identifier from lineitem
left join (select * from fx where id % 3 > 0) f on f.id = l_partkey""",
)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )
    methods = views.fx(spark, sf_dir).where("id % 3 > 0").select(
        F.col("id").alias("l_partkey"), "identifier"
    )
    return align.lookup_join(lines, methods, ["l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "identifier"
    )


@check(
    "union_all",
    f"""{views.ctes('pairs')}
select run_id, label, prediction from pairs
union all select 'again', prediction, label from pairs where run_id = 'base'""",
)
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = views.pairs(spark, sf_dir).select("run_id", "label", "prediction")
    again = pairs.where("run_id = 'base'").select(
        F.lit("again").alias("run_id"),
        F.col("prediction").alias("label"),
        F.col("label").alias("prediction"),
    )
    return align.union_all(pairs, again)


@check(
    "multiset_intersect",
    """
select item, count(*) as copies from (
 select l_partkey as item from lineitem where l_returnflag = 'R'
 intersect all select l_partkey from lineitem where l_linestatus = 'F')
group by item""",
)
def multiset_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    item = F.col("l_partkey").alias("item")
    return align.multiset_intersect(
        lines.where("l_returnflag = 'R'").select(item),
        lines.where("l_linestatus = 'F'").select(item),
    )


# the flow in SQL: extracted methods numbered, cleaned, split, both predictors scored
FLOW = {
    "extracted": sql.EXTRACTED,
    "numbered": "select *, file_path || '#' || method_no as id from extracted",
    "clean": sql.CLEAN.replace("from fx", "from numbered"),
    "tagged": sql.TAGGED,
    "train": "select * from tagged where split = 'train'",
    "test": "select * from tagged where split = 'test'",
    "majority": models.MAJORITY,
    "nearest": models.NEAREST,
    "flow_pairs": f"""
select 'base' as run_id, labels as label, coalesce(prediction, '<no_prediction>') as prediction
from test left join majority using (type_identifier, formal_parameters)
union all
select 'tuned', labels, prediction from test join ({models.NEAREST_NAMES % 'nearest'}) using (id)""",
    "counted": counted("flow_pairs"),
    "metrics": BASIC,
}
FLOW_METRICS = ["accuracy", "accuracy_by_label", "rouge1", "levenshtein"]


@check(
    "compare_predictors",
    f"""{views.ctes('sources', **FLOW)},
tall as (unpivot (select run_id, {', '.join(FLOW_METRICS)} from metrics)
 on {', '.join(FLOW_METRICS)} into name metric value value)
select a.metric, round(a.value, 6) as base, round(b.value, 6) as candidate,
 round(b.value - a.value, 6) as delta, round(b.value / a.value, 6) as ratio
from tall a join tall b using (metric) where a.run_id = 'base' and b.run_id = 'tuned'""",
)
def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files through extraction, splits and two predictors to compared scores."""
    files = decode_files(views.source_files(spark, sf_dir))
    return rounded(compare_predictors(files, n_holdout=0.2, n_val=0.1), "metric")


@check(
    "evaluate_model",
    f"""{views.ctes('fx', **models.TAGGED, vocab=sql.vocab('tagged', 'labels', models.ALL_WORDS),
        test="select * from tagged where split = 'test'",
        coded="select id, full_code from test",
        code_ids=models.sql_ids('full_code', models.LENGTH),
        outputs="select id, ids from code_ids",
        decoded=models.DECODED % 'outputs')},
named as (select id, case when name = '' then '<no_prediction>' else name end as prediction
 from ({models.longest('decoded', 'id')})),
label_ids as ({models.sql_ids('labels', models.LENGTH).replace('from coded', 'from test')}),
wanted as ({models.DECODED % 'label_ids'}),
model_pairs as (select 'model' as run_id, text as label, prediction from wanted join named using (id)),
counted as ({counted('model_pairs')}), metrics as ({BASIC.replace(
    'sum(common) / sum(nl)', 'coalesce(sum(common) / nullif(sum(nl), 0), 0)')})
select run_id, n, {', '.join(f'round({m}, 6) as {m}' for m in metrics.METRIC_NAMES[:4])} from metrics""",
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that repeats its input, scored on all test rows."""
    examples = stage(models.tagged(spark, sf_dir), "tagged")
    vocab = stage(build_vocab(examples, "labels", None), "vocab")
    scores = evaluate_model(examples, vocab, models.echo_model, models.LENGTH)
    return rounded(scores, "run_id", "n")


@check(
    "evaluate_stored",
    f"""{views.ctes('sources', **FLOW)}
select run_id, n, {', '.join(f'round({m}, 6) as {m}' for m in FLOW_METRICS)} from metrics""",
)
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the whole flow written, read back and scored against the test split."""
    files = decode_files(views.source_files(spark, sf_dir))
    examples = stage(build_examples(build_methods(files), 0.2, 0.1), "examples")
    path = fresh_path(spark, "predictions")
    write_predictions(score_predictors(examples), path)
    scores = evaluate_stored(examples, read_predictions(spark, path))
    return rounded(scores, "run_id", "n")


CLASSED = {
    "counted": COUNTED,
    "lines": "select id, len(string_split(block, chr(10))) as n from fx where block is not null",
    "bounds": "select quantile_disc(n, 1/3) as low, quantile_disc(n, 2/3) as high from lines where n > 1",
    "classes": f"""
select id, case when block is null then 'none' when n = 1 then 'one line'
  when n <= low then 'to ' || low || ' lines' when n <= high then 'to ' || high || ' lines'
  else 'over ' || greatest(low, high) || ' lines' end as body_class,
 case when mods like '%abstract%' then 'abstract' when mods like '%@Override%' then 'override'
  else 'other' end as purpose,
 case {' '.join(f"when {kind} is not null then '{kind}'" for kind in sql.KINDS)} else 'none' end
  as return_kind
from fx left join lines using (id), bounds""",
    "scored": """
select run_id, body_class, purpose, return_kind, common, nl, np,
 case when nl = 0 then 0 else common / nl end as recall, levenshtein(label, prediction) as distance
from counted join classes on id = example_id""",
}


@check(
    "evaluate_by_class",
    f"""{views.ctes('pairs', **CLASSED)}
select run_id, case when grouping(body_class) = 1 then 'all' else body_class end as body_class,
 case when grouping(purpose) = 1 then 'all' else purpose end as purpose,
 case when grouping(return_kind) = 1 then 'all' else return_kind end as return_kind,
 count(*) as n, round(sum(common) / sum(np), 6) as accuracy,
 round(sum(common) / sum(nl), 6) as accuracy_by_label, round(avg(recall), 6) as rouge1,
 round(avg(distance), 6) as levenshtein
from scored group by grouping sets (
 (run_id), (run_id, body_class), (run_id, purpose), (run_id, return_kind),
 (run_id, body_class, return_kind))""",
)
def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by length of body, purpose and return kind."""
    classes = breakdown.classify_methods(views.fx(spark, sf_dir))
    scores = breakdown.evaluate_by_class(views.pairs(spark, sf_dir), classes)
    return rounded(scores, "run_id", "body_class", "purpose", "return_kind", "n")


def grams(n: int) -> str:
    """The n-grams of both names' subwords, joined, with their clipped matches."""
    return (f"{sql.overlap(f'l{n}', f'p{n}')} as m{n}, len(p{n}) as t{n}")


BLEU = {
    "counted": counted("line_pairs"),
    "grams": "select run_id, nl, np, lw as l1, pw as p1, " + ", ".join(
        f"list_transform({sql.ngrams(w, n)}, lambda g: array_to_string(g, ' ')) as {side}{n}"
        for n in (2, 3, 4) for side, w in (("l", "lw"), ("p", "pw"))) + " from counted",
    "matched": f"select run_id, nl, np, {', '.join(grams(n) for n in (1, 2, 3, 4))} from grams",
    "sums": "select run_id, sum(nl) as nl, sum(np) as np, " + ", ".join(
        f"sum(m{n}) / sum(t{n}) as precision_{n}" for n in (1, 2, 3, 4)) + " from matched group by run_id",
    "penalties": "select *, case when np >= nl then 1.0 else exp(1 - nl / np) end as brevity_penalty from sums",
}


@check(
    "corpus_bleu",
    f"""{views.ctes('line_pairs', **BLEU)}
select run_id, round(brevity_penalty * exp((ln(precision_1) + ln(precision_2) + ln(precision_3)
 + ln(precision_4)) / 4), 6) as bleu, round(brevity_penalty, 6) as brevity_penalty,
 {', '.join(f'round(precision_{n}, 6) as precision_{n}' for n in (1, 2, 3, 4))} from penalties""",
)
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlap.corpus_bleu(views.line_pairs(spark, sf_dir)), "run_id")


@check(
    "set_scores",
    f"""{views.ctes('line_pairs', counted=counted('line_pairs'),
        sets="select run_id, list_distinct(lw) as l, list_distinct(pw) as p from counted",
        sizes="select run_id, len(l) as nl, len(p) as np, len(list_intersect(l, p)) as shared from sets")}
select run_id, round(sum(shared) / sum(np), 6) as precision, round(sum(shared) / sum(nl), 6) as recall,
 round(2.0 * sum(shared) / (sum(nl) + sum(np)), 6) as f1,
 round(avg(case when nl + np = 0 then 0 else 2.0 * shared / (nl + np) end), 6) as mean_f1
from sizes group by run_id""",
)
def set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlap.set_scores(views.line_pairs(spark, sf_dir)), "run_id")
