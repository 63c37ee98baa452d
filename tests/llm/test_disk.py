"""What operators leave on disk while they run."""

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from auditloom.llm import components, near_dups, ngram_lm, store
from auditloom.llm.store import discard, shared_folder, stored


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_shuffles_go_with_the_query_that_is_stored(spark):
    """Without waiting for the driver's garbage collection."""
    shared_folder(spark)
    before = shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    once = stored(counts.repartition(3, "k"), "disk-test")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert sorted(map(tuple, once.collect())) == [(k, 100) for k in range(10)] == sorted(map(tuple, counts.collect()))
    folder = os.path.dirname(once.inputFiles()[0].removeprefix("file://"))
    discard(once, counts)
    assert not os.path.exists(folder)


def test_near_duplicates_keep_no_table_that_nothing_reads(spark, tmp_path, monkeypatch):
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(words[:100] if k % 2 else [*words[100:], str(k)])) for k in range(40)]
    monkeypatch.setattr(store, "shared_folder", lambda spark: str(tmp_path))
    got = near_dups.near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(k, 1 if k % 2 else 0) for k in range(40)}
    assert left <= {"near-rows", "near-links", "near-classes", "near-placed", "components", "near-held", "near-met"}


def test_lm_tables_hold_packed_counts(spark, monkeypatch):
    """No row for a word or an n-gram, but one for all that a chunk has in a bucket; and under 8 bytes for an n-gram on its way."""
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(f"w{x}" for x in rng.integers(0, 60, 400))) for k in range(60)]
    rows: dict[str, int] = {}
    keep = ngram_lm.stored

    def noted(df, name):
        out = keep(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_lm, "stored", noted)
    got = ngram_lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 5 == 0, ngram_lm.LmSettings(chunk_bytes=30_000))
    assert got.count() == 60 and max(rows.values()) <= 16, rows

    table = pa.table({"chunk": pa.array([0] * 60), "text": pa.array([t for _, t in docs]), "training": pa.array([True] * 60)})
    asked = ngram_lm.ask_grams(table, ngram_lm.Buckets(0, 2, 2), 3)
    n = sum(asked["n"].to_pylist())
    assert n > 20_000 and sum(len(x) for c in ("keys", "numbers") for x in asked[c].to_pylist()) < 8 * n
    for k in range(2):
        half = ngram_lm.ask_grams(table, ngram_lm.Buckets(k, k + 1, 2), 3)
        assert half.to_pylist() == asked.slice(k, 1).to_pylist()


def test_lm_lookups_and_packing():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, (1 << 63) - 1, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.unique(np.concatenate([keys, keys[:50] + np.uint64(2), np.arange(5, dtype=np.uint64)]))
    values = rng.integers(1, 1 << 40, len(keys))
    facts = ngram_lm.Facts.of(keys[::-1], values[::-1])
    assert facts.look(keys).tolist() == values.tolist()
    absent = np.setdiff1d(np.concatenate([keys + np.uint64(1), keys - np.uint64(1)]), keys)
    assert not facts.look(absent).any() and not ngram_lm.Facts(keys[:0], values[:0]).look(keys).any()
    assert ngram_lm.unpacked(ngram_lm.packed(keys), len(keys), np.uint64).tolist() == keys.tolist()
    assert ngram_lm.unpacked(ngram_lm.packed(values / 4), len(keys), np.float64).tolist() == (values / 4).tolist()


def test_components_keep_their_last_table_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda spark: str(tmp_path))
    links = spark.range(30).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(links).collect()
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(map(tuple, got)) == [(k, 0) for k in range(31)]
