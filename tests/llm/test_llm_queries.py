"""The registered llm queries: SQL twins, schemas, and the pipeline stage by stage."""

import re

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from velum.llm.queries import ORACLE, QUERIES

ROOT = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_main_text": "page_id url text n_chars",
    "op2_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op3_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_quality": "doc_id held_out score predicted",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_url_filter": "page_id host path rule verdict",
    "op9_ngram_join": "doc_id n_shingles component_id",
    "op11_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op13_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    ok, message = compare(spark, connect(ROOT), ROOT, name, QUERIES, ORACLE)
    assert ok, message
    assert "types differ" not in message, message


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, ROOT)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    source = "pages" if "page_id" in df.columns else "documents"
    assert df.count() == spark.read.parquet(f"{ROOT}/{source}.parquet").count()


def test_pipeline_stages(spark):
    """Every stage keeps rows of its predecessor as they are; what goes, goes for its reason."""
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{root}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, root)
        if name == "mixing":
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in docs.collect())
            break
        after = after.cache()
        assert after.columns == docs.columns
        gone = docs.join(after.select("doc_id"), "doc_id", "left_anti").join(labels, "doc_id", "left").toPandas()
        assert len(gone) and after.exceptAll(docs).count() == 0
        if name == "quality":
            assert (gone.quality.dropna() == 0).mean() > 0.9
        if name == "toxicity":
            assert (gone.toxic.dropna() == 1).mean() > 0.9
        if name == "near_duplicates":
            def sets(df):
                out = {}
                for r in df.select("doc_id", "text").collect():
                    w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
                    out[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
                return out

            before, kept = sets(docs), sets(after)
            assert all(any(100 * len(before[i] & s) >= 80 * len(before[i] | s) for k, s in before.items() if k != i) for i in gone.doc_id)
            ids = sorted(kept)
            assert not any(100 * len(kept[a] & kept[b]) >= 80 * len(kept[a] | kept[b]) for n, a in enumerate(ids) for b in ids[:n])
        docs = after
    assert docs.where(F.col("text").isNull()).count() == 0
