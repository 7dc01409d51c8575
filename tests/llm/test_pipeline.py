import duckdb

import corpus_pipeline
from namesmith.llm import toxic_grammar

from .test_hyperminhash import expected as same_groups
from .test_suffix_dedup import kept_bytes
from .test_benchmark_leaks import expected as leaks
from .test_chunk_bpe import library  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path, library):  # noqa: F811
    """Each stage on what the one before kept, and run() equal to the last."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    items = duckdb.sql(f"select item_id, text from '{SF_DIR}/benchmark.parquet'").fetchall()
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        ids = sorted(r.doc_id for r in after)
        assert ids
        if name == "toxicity":
            learned = toxic_grammar.learn(
                spark.read.parquet(f"{SF_DIR}/documents.parquet"),
                spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            lexicon = toxic_grammar.Lexicon(learned["words"], learned["stems"])
            assert ids == sorted(
                r.doc_id for r in before if toxic_grammar.score_of(
                    toxic_grammar.clause_sums(r.text, lexicon), learned["model"]) < 0.5)
        elif name == "near_dedup":
            groups = same_groups([(r.doc_id, r.text) for r in before], 5)
            assert ids == sorted(i for i, _, c in groups if i == c)
        elif name == "suffix_dedup":
            cut = kept_bytes([r.text.encode() for r in before], corpus_pipeline.PASSAGE)
            want = {r.doc_id: k.decode(errors="ignore") for r, (k, _, _) in zip(before, cut)}
            assert {r.doc_id: r.text for r in after} == want
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "decontamination":
            dirty = {d for d, _ in leaks([(r.doc_id, r.text) for r in before], items)}
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in dirty)
        else:
            assert len(after) == len(before)
            assert all(r.n_tokens == library(r.text)[0] for r in after)
        if name != "bpe":
            assert docs.columns == columns
        before = after
    assert sorted(corpus_pipeline.run(spark, SF_DIR).collect(), key=str) == sorted(before, key=str)
