"""Vocabulary, encoding and name prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.constants import MAX_LENGTH, VOCAB_SIZE
from namesmith.functions.text import (
    clean_generated_name, fill_missing_prediction, rebuild_generated_name,
)
from namesmith.operators import encode as enc
from namesmith.operators import predict as pred
from namesmith.operators.clean import encoded_only
from namesmith.storage import stage

from . import sql, views
from .clean import clean, tagged
from .registry import check

LENGTH, WORDS = MAX_LENGTH, VOCAB_SIZE


def shown(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ").alias(ids)


def train_vocab(examples: DataFrame) -> DataFrame:
    return stage(enc.build_vocab(examples.where("split = 'train'"), "full_code", WORDS), "vocab")


def encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    examples = stage(tagged(spark, sf_dir), "tagged")
    vocab = train_vocab(examples)
    return enc.encode_examples(examples, vocab, LENGTH), vocab


TAGGED = {"clean": sql.CLEAN, "tagged": sql.TAGGED}
VOCAB = {
    "train": "select * from tagged where split = 'train'",
    "vocab": sql.vocab("train", "full_code", WORDS),
}


def sql_ids(text: str, length: int) -> str:
    """Relation of id lists per id: pieces looked up, cut and padded."""
    return f"""
select id, list_resize(ids, {length}, 0) as ids, len(ids) as size from (
 select id, coalesce(list(case when word = '<extra_id_0>' then 2 else coalesce(word_id, 1) end
   order by pos) filter (pos <= {length} and word is not null), []) as ids
 from (select id, unnest(w) as word, generate_subscripts(w, 1) as pos
       from (select id, case when len(w) = 0 then [null] else w end as w
             from (select id, {sql.pieces(text)} as w from coded)))
 left join vocab using (word) group by id)
"""


def sql_padded(column: str) -> str:
    return f"array_to_string({column}, ' ')"


@check(
    "build_vocab",
    f"{views.ctes('fx', **TAGGED, **VOCAB)} select word, word_id, n from vocab",
)
def vocab_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_vocab(tagged(spark, sf_dir))


@check(
    "build_vocab_documents",
    f"with vocab as ({sql.vocab('documents', 'text', 5000)}) select word, word_id, n from vocab",
)
def vocab_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.build_vocab(views.working_table(spark, sf_dir, "documents"), "text", 5000)


@check(
    "encode_examples",
    f"""{views.ctes('fx', **TAGGED, **VOCAB,
        coded="select id, full_code, labels from tagged",
        code_ids=sql_ids('full_code', LENGTH), label_ids=sql_ids('labels', LENGTH))}
select id, split, {sql_padded('c.ids')} as input_ids, {sql_padded('l.ids')} as labels,
 {sql_padded(f'list_transform(generate_series(1, {LENGTH}), lambda i: cast(i <= c.size as integer))')}
  as attention_mask
from tagged join code_ids c using (id) join label_ids l using (id)""",
)
def encode_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = encoded(spark, sf_dir)
    return encoded_only(rows).select(
        "id", "split", shown("labels"), shown("input_ids"), shown("attention_mask")
    )


DOCUMENT_IDS = """with vocab as ({vocab}),
coded as (select doc_id as id, text from documents),
ids as ({ids})
select id, md5({padded}) as digest, size from ids"""
ALL_WORDS = 1 << 40


def document_ids(words: int) -> str:
    return DOCUMENT_IDS.format(
        vocab=sql.vocab("documents", "text", words), ids=sql_ids("text", 512),
        padded=sql_padded("ids"))


@check("encode_documents", document_ids(ALL_WORDS))
def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.working_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text"
    )
    vocab = stage(enc.build_vocab(docs, "text", None), "vocab")
    return digests(enc.encode(docs, vocab, {"input_ids": "text"}, 512))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id",
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), " ")).alias("digest"),
        F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("size"),
    )


@check("encode_documents_by_join", document_ids(5000))
def encode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.working_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text"
    )
    vocab = stage(enc.build_vocab(docs, "text", 5000), "vocab")
    return digests(enc.encode(docs, vocab, {"input_ids": "text"}, 512))


DECODED = f"""
select id, coalesce(string_agg(word, '' order by pos), '') as text
from (select id, unnest(ids) as word_id, generate_subscripts(ids, 1) as pos from %s)
left join vocab using (word_id) group by id
"""


@check(
    "decode_labels",
    f"""{views.ctes('fx', **TAGGED, **VOCAB, coded="select id, labels from tagged",
        label_ids=sql_ids('labels', LENGTH), decoded=DECODED % 'label_ids')}
select id, text as label from decoded""",
)
def decode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vocab = encoded(spark, sf_dir)
    return enc.decode(rows.select("id", "labels"), "labels", vocab, "label")


@check(
    "replace_ignored",
    f"""{views.ctes('fx', **TAGGED, **VOCAB, coded="select id, labels from tagged",
        label_ids=sql_ids('labels', LENGTH))}
select id, {sql_padded('ids')} as labels from label_ids""",
)
def replace_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding hidden from a loss by the ignore id comes back as padding."""
    rows, _ = encoded(spark, sf_dir)
    hidden = F.transform("labels", lambda i: F.when(i == 0, -100).otherwise(i))
    return rows.select("id", enc.replace_ignored(hidden).alias("labels")).select(
        "id", shown("labels")
    )


def longest(relation: str, keys: str) -> str:
    """Relation of the longest word per key, the first of equals, else empty."""
    return f"""
select {keys}, coalesce(word, '') as name from (
 select {keys}, word, row_number() over (partition by {keys} order by len(word) desc, pos) as place
 from (select {keys}, unnest(w) as word, generate_subscripts(w, 1) as pos
       from (select {keys}, case when len(w) = 0 then [null] else w end as w
             from (select {keys}, regexp_extract_all(text, '[a-zA-Z]+') as w from {relation}))))
where place = 1
"""


@check(
    "clean_generated_name",
    longest("documents", "doc_id"),
)
def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.working_table(spark, sf_dir, "documents")
    return docs.select("doc_id", clean_generated_name(F.col("text")).alias("name"))


@check(
    "fill_missing_prediction",
    f"""
select conv_id, turn, case when turn % 3 = 0 or name = '' then '<no_prediction>' else name end as name
from ({longest('conversations', 'conv_id, turn')})""",
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 3 == 0, "").otherwise(clean_generated_name(F.col("text")))
    return turns.select("conv_id", "turn", fill_missing_prediction(name).alias("name"))


# subwords in order of their first place, then joined: the later ones with a capital
REBUILT = f"""
select doc_id, coalesce(string_agg(case when place = 1 then word else upper(word[1]) || word[2:] end,
 '' order by place), '') as name
from (select doc_id, word, row_number() over (partition by doc_id order by first) as place
 from (select doc_id, word, min(pos) as first
  from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos
   from (select doc_id, case when len(w) = 0 then [null] else w end as w
    from (select doc_id, flatten(list_transform(regexp_extract_all(text, '[a-zA-Z]+'),
      lambda r: {sql.subwords('r')})) as w from documents)))
  group by all))
group by doc_id
"""


@check("rebuild_generated_name", f"select doc_id, md5(name) as digest, len(name) as size from ({REBUILT})")
def rebuild_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as generated texts, which repeat most of their words."""
    docs = views.working_table(spark, sf_dir, "documents")
    name = rebuild_generated_name(F.col("text"))
    return docs.select("doc_id", name.alias("name")).select(
        "doc_id", F.md5("name").alias("digest"), F.length("name").cast("long").alias("size"))


def echo_model():
    """A model that repeats its input."""

    def predict(input_ids, attention_mask):
        return input_ids * attention_mask

    return predict


@check(
    "predict_batches",
    f"""{views.ctes('fx', **TAGGED, **VOCAB, coded="select id, full_code from tagged",
        code_ids=sql_ids('full_code', LENGTH),
        outputs="select id, ids from code_ids",
        decoded=DECODED % 'outputs')}
select id, case when name = '' then '<no_prediction>' else name end as prediction
from ({longest('decoded', 'id')})""",
)
def predict_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vocab = encoded(spark, sf_dir)
    return pred.generate_names(rows, vocab, echo_model, LENGTH)


MAJORITY = """
select type_identifier, formal_parameters, labels as prediction from (
 select *, row_number() over (partition by type_identifier, formal_parameters
  order by votes desc, labels) as place
 from (select type_identifier, formal_parameters, labels, count(*) as votes from train
       group by all))
where place = 1
"""

RATIO = f"""
select *, case when ('0x' || substr({sql.shuffle_key('id')}, 1, 8))::bigint % 10000 < 7000
 then 'train' else 'test' end as split from clean
"""
HALVES = {
    "clean": sql.CLEAN,
    "parts": RATIO,
    "train": "select * from parts where split = 'train'",
    "test": "select * from parts where split = 'test'",
}


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from namesmith.operators.split import ratio_split

    parts = stage(ratio_split(clean(spark, sf_dir), 0.7, 0.15), "parts")
    return parts.where("split = 'train'"), parts.where("split <> 'train'")


@check(
    "fit_majority_names",
    f"{views.ctes('fx', **HALVES, model=MAJORITY)} select * from model",
)
def fit_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = halves(spark, sf_dir)
    return pred.fit_majority_names(train)


@check(
    "predict_majority",
    f"""{views.ctes('fx', **HALVES, model=MAJORITY)}
select id, coalesce(prediction, '<no_prediction>') as prediction
from test left join model using (type_identifier, formal_parameters)""",
)
def predict_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(spark, sf_dir)
    return pred.predict_majority(test, stage(pred.fit_majority_names(train), "model"))


def sql_words(text: str) -> str:
    found = f"regexp_extract_all({text}, '[A-Z]?[a-z]+|[A-Z]+')"
    return f"list_distinct(list_transform({found}, lambda w: lower(w)))"


NEAREST = f"""
select word, sum(votes)::bigint as holders, arg_max(labels, place) as prediction from (
 select word, labels, votes, -row_number() over (partition by word order by votes desc, labels)
  as place
 from (select word, labels, count(*) as votes
       from (select labels, unnest({sql_words('full_code')}) as word from train) group by all))
group by word
"""


@check(
    "fit_nearest_names",
    f"{views.ctes('fx', **HALVES, model=NEAREST)} select * from model",
)
def fit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = halves(spark, sf_dir)
    return pred.fit_nearest_names(train)


# per test row the vote held by its rarest known word
NEAREST_NAMES = f"""
select id, coalesce(prediction, '<no_prediction>') as prediction from test left join (
 select id, prediction, row_number() over (partition by id order by holders, word) as place
 from (select id, unnest({sql_words('full_code')}) as word from test) join %s using (word)
) using (id) where place is null or place = 1
"""


@check(
    "predict_nearest",
    f"""{views.ctes('fx', **HALVES, model=NEAREST)}
{NEAREST_NAMES % 'model'}""",
)
def predict_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = halves(spark, sf_dir)
    return pred.predict_nearest(test, stage(pred.fit_nearest_names(train), "model"))


# long texts in place of code: a document's words point to a label of their source
DOCUMENT_ROWS = """
select doc_id as id, source || '_' || lang as labels, text as full_code,
 case when doc_id % 3 = 0 then 'test' else 'train' end as split from documents
"""


@check(
    "predict_nearest_documents",
    f"""with parts as ({DOCUMENT_ROWS}),
train as (select * from parts where split = 'train'),
test as (select * from parts where split = 'test'),
model as ({NEAREST})
{NEAREST_NAMES % 'model'}""",
)
def nearest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.working_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("_"), "lang").alias("labels"),
        F.col("text").alias("full_code"),
    )
    model = stage(pred.fit_nearest_names(docs.where("id % 3 <> 0")), "model")
    return pred.predict_nearest(docs.where("id % 3 = 0"), model)
