"""Cleaning: projections, filters and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions import text
from namesmith.functions.text import null_tokens
from namesmith.operators import clean as ops
from namesmith.operators import split as splits
from namesmith.operators.encode import name_length_budget
from namesmith.storage import stage

from . import sql, views
from .registry import check

KINDS = sql.KINDS


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templated methods as the CSV reader returns them."""
    return null_tokens(views.fx(spark, sf_dir), ["identifier"])


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_methods(methods(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = stage(clean(spark, sf_dir), "cleaned")
    n = cleaned.count()
    return splits.tag_splits(cleaned, n // 5, n // 10)


RESOLVED = f"select * exclude (type_identifier), {sql.RETURN_TYPE} as type_identifier from fx"


@check("drop_index", f"{views.ctes('fx')} select identifier, block, file_path from fx")
def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.fx(spark, sf_dir).select("id", "identifier", "block", "file_path")
    return ops.drop_index(cells)


@check(
    "resolve_return_type",
    f"{views.ctes('fx', resolved=RESOLVED)} select id, type_identifier from resolved",
)
def return_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve_return_type(views.fx(spark, sf_dir)).select("id", "type_identifier")


@check(
    "drop_kind_columns",
    f"""{views.ctes('fx', resolved=RESOLVED)}
select id, identifier, formal_parameters, block, type_identifier, file_path from resolved""",
)
def drop_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = ops.resolve_return_type(views.fx(spark, sf_dir))
    return ops.drop_kind_columns(typed).drop("modifiers")


@check(
    "split_modifiers",
    f"""{views.ctes('fx')}
select id,
 coalesce(array_to_string(list_filter({sql.modifiers()}, lambda m: m like '@%'), chr(10)), '')
   as annotations,
 coalesce(array_to_string(list_filter({sql.modifiers()}, lambda m: m not like '@%'), ' '), '')
   as keywords
from fx""",
)
def split_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    modifiers = F.col("modifiers")
    return views.fx(spark, sf_dir).select(
        "id",
        text.format_annotations(modifiers).alias("annotations"),
        text.format_keywords(modifiers).alias("keywords"),
    )


@check(
    "strip_comments",
    f"{views.ctes('fx')} select id, {sql.strip_comments('block')} as code from fx",
)
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.fx(spark, sf_dir).select("id", text.strip_comments(F.col("block")).alias("code"))


@check(
    "strip_comments_documents",
    f"""
select doc_id, md5({sql.strip_comments(
    "replace(replace(replace(text, ',', ' /* '), '.', ' */ '), ' e', ' // e')")}) as digest
from documents""",
)
def strip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts in which punctuation was turned into comment marks."""
    marked = F.col("text")
    for mark, comment in ((",", " /* "), (".", " */ "), (" e", " // e")):
        marked = F.replace(marked, F.lit(mark), F.lit(comment))
    docs = views.working_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.strip_comments(marked)).alias("digest"))


@check(
    "build_masked_code",
    f"""{views.ctes('fx', clean=sql.CLEAN)}
select id, labels, formal_parameters, type_identifier, file_path, full_code from clean""",
)
def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir).select(
        "id", "labels", "formal_parameters", "type_identifier", "file_path", "full_code"
    )


@check(
    "missing_body_text",
    f"""{views.ctes('fx')}
select id, coalesce(block, 'nan') as as_run, coalesce(block, '') as emptied from fx""",
)
def missing_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.col("block")
    return views.fx(spark, sf_dir).select(
        "id", text.body_text(block).alias("as_run"), text.body_text(block, "").alias("emptied")
    )


RULES = f"""
select id, mods <> '' as modifiers_ok, {sql.RETURN_TYPE} is not null as type_ok,
 {sql.null_token('identifier')} is not null as name_ok,
 block is not null and block not in ('{{}}', '{{' || chr(10) || ' }}') as body_ok,
 mods like '%abstract%' as abstract,
 list_contains({sql.modifiers()}, 'abstract') as strictly_abstract
from fx
"""


@check("method_rules", f"{views.ctes('fx', rules=RULES)} select * from rules")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = ops.resolve_return_type(methods(spark, sf_dir))
    return typed.select(
        "id",
        ops.modifiers_present().alias("modifiers_ok"),
        ops.type_present().alias("type_ok"),
        ops.name_present().alias("name_ok"),
        ops.body_present().alias("body_ok"),
        ops.is_abstract().alias("abstract"),
        ops.is_abstract(strict=True).alias("strictly_abstract"),
    )


@check(
    "valid_methods",
    f"""{views.ctes('fx', rules=RULES)}
select id from rules where modifiers_ok and type_ok and name_ok and (body_ok or abstract)""",
)
def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = ops.resolve_return_type(methods(spark, sf_dir))
    return ops.valid_methods(typed).select("id")


@check(
    "reject_counts",
    f"""{views.ctes('fx', rules=RULES)}
select count(*) as n,
 count(*) filter (modifiers_ok and type_ok and name_ok and (body_ok or abstract)) as kept,
 count(*) filter (not (body_ok or abstract)) as no_body,
 count(*) filter (not type_ok) as no_type, count(*) filter (not name_ok) as no_name,
 count(*) filter (not modifiers_ok) as no_modifiers
from rules""",
)
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reject_counts(ops.resolve_return_type(methods(spark, sf_dir)))


@check("head", "select o_orderkey, o_custkey from orders order by o_orderkey limit 10")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders")
    return splits.head(orders, 10, "o_orderkey").select("o_orderkey", "o_custkey")


ORDER_RANKS = f"""
select o_orderkey as id, o_custkey, {sql.shuffle_key('o_orderkey')} as k,
 row_number() over (order by {sql.shuffle_key('o_orderkey')}, o_orderkey) as place from orders
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), "o_custkey"
    )


@check("shuffle", f"select id, k, place from ({ORDER_RANKS})")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namesmith.operators.align import number_rows

    keyed = orders(spark, sf_dir).select("id", splits.shuffle_key().alias("k"))
    places = number_rows(keyed, ["k", "id"], "place")
    return places.select("id", "k", (F.col("place") + 1).alias("place"))


@check("take_first", f"select id, o_custkey from ({ORDER_RANKS}) where place <= 1000")
def take_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.take_first(orders(spark, sf_dir), 1000)


@check("holdout_rest", f"select id, o_custkey from ({ORDER_RANKS}) where place > 1000")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, _ = splits.holdout(orders(spark, sf_dir), 1000)
    return rest


@check(
    "second_split",
    f"""
select id, case when row_number() over (order by {sql.shuffle_key('id', '42:2')}, id) <= 400
 then 'validation' else 'test' end as part
from ({ORDER_RANKS}) where place <= 1000""",
)
def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, held = splits.holdout(orders(spark, sf_dir), 1000)
    test, validation = splits.second_split(held, 400)
    return test.select("id", F.lit("test").alias("part")).unionByName(
        validation.select("id", F.lit("validation").alias("part"))
    )


@check(
    "tag_splits",
    f"""
select id, case when place > 1000 then 'train'
 when row_number() over (partition by place > 1000
   order by {sql.shuffle_key('id', '42:2')}, id) <= 500
 then 'validation' else 'test' end as split
from ({ORDER_RANKS})""",
)
def tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tag_splits(orders(spark, sf_dir), 1000, 500).select("id", "split")


@check(
    "ratio_split",
    f"""
select id, case when b < 7000 then 'train' when b < 8500 then 'validation' else 'test' end as split
from (select o_orderkey as id,
  ('0x' || substr({sql.shuffle_key('o_orderkey')}, 1, 8))::bigint % 10000 as b from orders)""",
)
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.ratio_split(orders(spark, sf_dir)).select("id", "split")


@check(
    "complement",
    """
select doc_id, lang from documents where doc_id not in (select doc_id from labels)""",
)
def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.working_table(spark, sf_dir, "documents")
    labelled = views.table(spark, sf_dir, "labels")
    return splits.complement(docs, labelled, "doc_id").select("doc_id", "lang")


@check(
    "name_length_budget",
    f"""{views.ctes('fx', clean=sql.CLEAN)}
select cast(ceil(avg(len({sql.subwords('labels')}))) as bigint) + 2 as name_length_budget
from clean""",
)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_length_budget(clean(spark, sf_dir))
