"""SQL snippets of the oracles."""

from namesmith.constants import NULL_TOKENS, TYPE_KINDS as KINDS

FIELDS = ["identifier", "formal_parameters", "mods", "block", *KINDS]

# what the scanner must find in the templated files: the method, then the nested one
EXTRACTED = f"""
select file_path, 0 as method_no, {', '.join(FIELDS)} from sources
union all
select file_path, 1, 'run', '()', '@Override|public', '{{ go("}}"); }}',
 null, null, null, null, null, null, 'void'
from sources where id % 5 = 0 and block is not null
"""


def subwords(name: str) -> str:
    marked = (
        rf"regexp_replace(regexp_replace({name}, '([a-z])([A-Z])', '\1|\2', 'g'),"
        rf" '([A-Z])([A-Z][a-z])', '\1|\2', 'g')"
    )
    return f"list_filter(string_split(lower({marked}), '|'), lambda w: w <> '')"


def joined(items: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({items}, '{sep}'), '')"


def overlap(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least("
        f"len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"
    )


def ngrams(words: str, n: int) -> str:
    return (
        f"list_transform(generate_series(1, len({words}) - {n - 1}),"
        f" lambda i: list_slice({words}, i, i + {n - 1}))"
    )


def modifiers(mods: str = "mods") -> str:
    return f"list_filter(string_split({mods}, '|'), lambda m: m <> '')"


def strip_comments(code: str) -> str:
    return (
        rf"regexp_replace(regexp_replace({code}, '(?s)/\*.*?\*/', '', 'g'),"
        rf" '//[^\n]*\n', '', 'g')"
    )


def null_token(column: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    return f"case when {column} in ({tokens}) then null else {column} end"


def shuffle_key(column: str, seed: str = "42") -> str:
    return f"md5('{seed}:' || cast({column} as varchar))"


RETURN_TYPE = f"coalesce({', '.join(KINDS)})"

# typed and valid methods with the masked text
CLEAN = f"""
select id, identifier as labels, formal_parameters, mods, block, type_identifier, file_path,
 replace(coalesce(array_to_string(
      list_filter({modifiers()}, lambda m: m like '@%'), chr(10)), ''), '''', '')
 || chr(10)
 || replace(replace(coalesce(array_to_string(
      list_filter({modifiers()}, lambda m: m not like '@%'), ' '), ''), '''', ''), ',', '')
 || ' ' || type_identifier || ' <extra_id_0>' || formal_parameters || ' '
 || {strip_comments("coalesce(block, 'nan')")} as full_code
from (select * exclude (type_identifier, identifier), {RETURN_TYPE} as type_identifier,
       {null_token('identifier')} as identifier from fx)
where identifier is not null and type_identifier is not null and mods <> ''
 and ((block is not null and block not in ('{{}}', '{{' || chr(10) || ' }}'))
  or mods like '%abstract%')
"""

# clean methods of which a fifth is held out, half of it for validation
TAGGED = f"""
select *, case when first_rank > n_clean // 5 then 'train'
  when row_number() over (partition by first_rank > n_clean // 5
   order by {shuffle_key('id', '42:2')}, id) <= n_clean // 10
  then 'validation' else 'test' end as split
from (select *, row_number() over (order by {shuffle_key('id')}, id) as first_rank,
  count(*) over () as n_clean from clean)
"""

PIECES = r"<extra_id_0>|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[ \t\r\n]+|[^A-Za-z0-9 \t\r\n]"


def pieces(text: str) -> str:
    return f"regexp_extract_all({text}, '{PIECES}')"


def vocab(relation: str, column: str, size: int) -> str:
    return f"""
select word, n, cast(row_number() over (order by n desc, word) + 2 as integer) as word_id
from (select word, count(*) as n from (select unnest({pieces(column)}) as word from {relation})
      where word <> '<extra_id_0>' group by word order by n desc, word limit {size})
"""
