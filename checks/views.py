"""Inputs derived from the driver tables, as SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesmith.functions.names import split_camel_case
from namesmith.operators.align import number_rows
from namesmith.storage import stage

TABLES = ["part", "lineitem"]


# tables whose rows are costly to work on: one small file should still use all cores
SPREAD = {"part", "documents", "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def working_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that uses all cores; one of as many files is not moved for that."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in SPREAD and len(rows.inputFiles()) < cores else rows


# one method per part; modifiers as text joined by "|"
FX = """
select p_partkey as id,
 case when p_partkey % 97 = 0 then 'nan' when p_partkey % 89 = 0 then '' else
  case p_size % 4 when 0 then 'get' when 1 then 'is' when 2 then 'find' else 'parseXMLFor' end
  || upper(substr(p_name,1,1)) || replace(substr(p_name,2), ' ', '')
  || case when p_partkey % 3 = 0 then upper(substr(p_type,1,1)) || lower(substr(p_type,2)) else '' end
  || case when p_partkey % 7 = 0 then 'URL' else '' end
  || case when p_partkey % 10 = 0 then 'Get' else '' end end as identifier,
 case p_size % 3 when 0 then '()' when 1 then '(int a)' else '(String a, List<String> b)' end as formal_parameters,
 case p_partkey % 5 when 0 then '@Override|public' when 1 then 'public|static'
  when 2 then '@A("x")|protected' when 3 then '' else 'public|abstract' end as mods,
 case when p_partkey % 5 = 4 then null when p_partkey % 11 = 0 then '{}'
  when p_partkey % 13 = 0 then '{' || chr(10) || ' }'
  when p_partkey % 17 = 0 then null
  else '{' || chr(10) || '  // note ' || p_brand || chr(10) || '  return ' || replace(p_name,' ','.')
   || '; /* a' || chr(10) || ' b */' || chr(10) || '}' end as block,
 case when p_size % 8 = 0 then 'Artifact' end as type_identifier,
 case when p_size % 8 = 1 then 'boolean' end as boolean_type,
 case when p_size % 8 = 2 then 'double' end as floating_point_type,
 case when p_size % 8 = 3 then 'List<String>' end as generic_type,
 case when p_size % 8 = 4 then 'Map.Entry' end as scoped_type_identifier,
 case when p_size % 8 = 5 then 'int' end as integral_type,
 case when p_size % 8 = 6 then 'void' end as void_type,
 'src/' || replace(p_brand,'#','') || '/F' || cast(p_partkey % 50 as varchar(9)) || '.java' as file_path
from part
"""

# labels and predictions of two runs; the second one is right more often
_RUN = """
select a.id as example_id, '{run}' as run_id, a.identifier as label,
 case when a.id % {hits} = 0 then a.identifier
  when a.id % 31 = 0 then '<no_prediction>' else b.identifier end as prediction
from fx a join fx b on b.id = (a.id * 7 + 3) % (select count(*) from part)
where a.identifier not in ('','nan') and b.identifier not in ('','nan')
"""
PAIRS = _RUN.format(run="base", hits=4) + "union all" + _RUN.format(run="tuned", hits=2)

# the same names in far more pairs: one per order line
LINE_PAIRS = """
select run_id, a.identifier as label,
 case when prediction_id < 0 then '<no_prediction>' else b.identifier end as prediction
from (select l_returnflag as run_id, l_partkey as label_id,
  case when l_linenumber % 4 = 0 then l_partkey when l_orderkey % 31 = 0 then -1 - l_orderkey
   else (l_partkey * 7 + l_suppkey) % (select count(*) from part) end as prediction_id
  from lineitem) l
join (select id, identifier from fx where identifier not in ('','nan')) a on a.id = label_id
left join (select id, identifier from fx where identifier not in ('','nan')) b on b.id = prediction_id
where prediction_id < 0 or b.identifier is not null
"""

# one Java file per named method: around it a field, a constructor, text that only
# looks like code, and for every fifth one a method nested in its body
SOURCES = """
select id, 'src/M' || cast(id as varchar(20)) || '.java' as file_path, identifier,
 formal_parameters, mods, type_identifier, boolean_type, floating_point_type, generic_type,
 scoped_type_identifier, integral_type, void_type,
 case when id % 5 = 0 and block is not null then '{ Runnable r = new Runnable() {' || chr(10)
   || '  @Override public void run() { go("}"); }' || chr(10) || ' };' || substr(block, 2)
  else block end as block
from fx where identifier <> ''
"""

SOURCE_TEXT = """
select *, 'package p.q;' || chr(10) || chr(10)
 || case when id % 23 = 0 then '// caf' || chr(233) || ' {' else '/* public void ghost() { } */' end
 || chr(10) || 'public class M' || cast(id as varchar(20)) || ' extends Base {' || chr(10)
 || '  private String text = "} void no() { ";' || chr(10)
 || '  M' || cast(id as varchar(20)) || '(int a) { this.a = a; }' || chr(10)
 || '  ' || replace(mods, '|', ' ') || ' '
 || coalesce(type_identifier, boolean_type, floating_point_type, generic_type,
     scoped_type_identifier, integral_type, void_type, 'int[]')
 || ' ' || identifier || formal_parameters || coalesce(' ' || block, ';') || chr(10)
 || '}' || chr(10) as text
from sources
"""

VIEWS = {
    "fx": FX,
    "pairs": PAIRS,
    "line_pairs": LINE_PAIRS,
    "sources": SOURCES,
    "source_text": SOURCE_TEXT,
}
NEEDS = {
    "fx": [],
    "pairs": ["fx"],
    "line_pairs": ["fx"],
    "sources": ["fx"],
    "source_text": ["fx", "sources"],
}


def ctes(*names: str, **more: str) -> str:
    """WITH clause defining the named views (and what they need), then ``more``."""
    wanted: list[str] = []
    for name in names:
        for item in [*NEEDS[name], name]:
            if item not in wanted:
                wanted.append(item)
    parts = [f"{name} as ({VIEWS[name]})" for name in wanted]
    parts += [f"{name} as ({sql})" for name, sql in more.items()]
    return "with " + ",\n".join(parts)


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view on Spark."""
    for base in TABLES:
        working_table(spark, sf_dir, base).createOrReplaceTempView(base)
    # an accented letter from its code point; chr() stops at ASCII on Spark
    return spark.sql(f"{ctes(name)} select * from {name}".replace("chr(233)", "decode(X'C3A9', 'UTF-8')"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templated methods with modifiers as an array."""
    return with_modifiers(spark_view(spark, sf_dir, "fx"))


def with_modifiers(df: DataFrame) -> DataFrame:
    items = F.filter(F.split("mods", "[|]"), lambda m: m != "")
    return df.withColumn("modifiers", items).drop("mods")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "pairs")


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_view(spark, sf_dir, "line_pairs")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: some files in ISO-8859-1, some with ``\\r\\n``."""
    text = F.when(F.col("id") % 29 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(
        F.col("text")
    )
    content = F.when(F.col("id") % 23 == 0, F.encode(text, "ISO-8859-1")).otherwise(
        F.encode(text, "UTF-8")
    )
    return spark_view(spark, sf_dir, "source_text").select(
        F.col("file_path").alias("path"), content.alias("content")
    )


def vectors(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    """Vectors for the words of the names: the n-th word gets the n-th embedding."""
    words = (
        names.select(F.explode(F.array("label", "prediction")).alias("name"))
        .select(F.explode(split_camel_case("name")).alias("word"))
        .distinct()
    )
    numbered = number_rows(words, ["word"], "vec_id")
    embeddings = table(spark, sf_dir, "embeddings")
    found = numbered.join(embeddings, "vec_id").select("word", F.col("embedding").alias("vec"))
    return stage(found, "vectors")
