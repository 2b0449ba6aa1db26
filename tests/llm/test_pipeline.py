"""The pipeline's stages on odd and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = [(None, None, None, None), (None, "", None, None), (5_000_001, "12 34", "en", None), (5_000_002, "съешь ещё этих мягких булок да выпей чаю " * 9, None, "s"), (None, "съешь ещё этих мягких булок", None, "s")]
    rows = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    twice = docs.limit(3)
    every = docs.unionByName(twice).unionByName(rows.select(*docs.columns))
    clashing = "row found key node mark size h bytes shard_bytes lang_pred score known"
    return every.withColumns({c: F.lit(c) for c in clashing.split()} | {"tags": F.create_map(F.lit("k"), F.lit(1))}).cache()


def test_stages_in_turn(spark, odd):
    docs, columns = odd, odd.columns
    texts = {r.text for r in odd.select("text").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(columns) - 1] == [c for c in columns if c != "shard_bytes"] if name == "sharding" else out.columns == columns, name
        rows = out.collect()
        assert rows and {r.text for r in rows} <= texts and all(r.row == "row" and r.mark == "mark" and r.tags == {"k": 1} for r in rows)
        if name == "language_id":
            assert not any(r.text is None or "съешь" in r.text or r.text in ("", "12 34") for r in rows)
        if name == "near_dedup":
            assert max(Counter((r.doc_id, r.text) for r in rows).values()) == 1
        if name == "mixing":
            assert max(Counter((r.doc_id, r.text) for r in rows).values()) <= 2
        docs = spark.createDataFrame(rows, out.schema)


def test_stages_by_themselves(spark, odd):
    """Each stage takes what an earlier one would have dropped."""
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, SF).filter("doc_id IS NULL").count() >= (0 if name == "mixing" else 1)


def test_empty_tables(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).collect() == []


def test_wanted_languages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "WANTED", ("de",))
    kept = Counter(r.lang for r in corpus_pipeline.in_known_language(spark, docs, SF).select("lang").collect())
    assert kept["de"] >= 0.9 * docs.filter("lang = 'de'").count() and kept["de"] >= 0.9 * sum(kept.values())
