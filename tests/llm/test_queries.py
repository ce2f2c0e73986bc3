"""Every registered query on the smallest data set: its columns, its rows, and its SQL if there is one."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corpusloom.llm import decontaminate, neardup, secret_scan
from corpusloom.llm.oracles import LLM_ORACLES
from corpusloom.llm.queries import LLM_QUERIES
from tools.check_oracles import compare, connect

from . import brute

COLUMNS = {
    "op1": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"],
    "op6": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7": ["doc_id", "log_ratio", "log_odds", "key", "kept"],
    "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10": ["doc_id", "n_tokens", "ids", "round_trip"],
    "op11": ["doc_id", "fingerprint", "component_id"],
    "op12": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    "op13": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, sf_dir, name):
    df = LLM_QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    if name in LLM_ORACLES:
        ok, message = compare(spark, connect(sf_dir), name, LLM_QUERIES[name], LLM_ORACLES[name], sf_dir)
        assert ok, message
    else:
        assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_pipeline_stages(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "decontamination", "secrets", "encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).cache()
    rows = first.orderBy("doc_id").collect()
    assert first.columns == columns and 0 < len(rows) <= docs.count()
    near = corpus_pipeline.STAGES[1][1](spark, first, sf_dir).cache()
    want = {i for i, (_, c) in brute.near_duplicates([(r.doc_id, r.text) for r in rows]).items() if i == c}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want
    clean = corpus_pipeline.STAGES[2][1](spark, near, sf_dir).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    left = [r for r in rows if r.doc_id in want]
    hits = brute.overlaps([r.text for r in left], items)
    want = {r.doc_id for r, (n, hit, _) in zip(left, hits) if not (hit and 20 * hit >= n)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want
    safe = corpus_pipeline.STAGES[3][1](spark, clean, sf_dir).cache()
    assert safe.columns == columns and {r.doc_id for r in safe.collect()} == want
    assert all(not brute.base_spans(r.text) and r.n_chars == len(r.text) for r in safe.collect())
    last = corpus_pipeline.STAGES[4][1](spark, safe, sf_dir)
    assert {r.doc_id for r in last.collect()} == want and last.where("not round_trip").count() == 0


def test_pipeline_on_odd_rows(spark, docs, nothing, sf_dir):
    for stage in (lambda d: neardup.keep_first(d), lambda d: secret_scan.redact(d), lambda d: decontaminate.keep_clean(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))):
        assert stage(docs).columns == docs.columns and stage(nothing).count() == 0
