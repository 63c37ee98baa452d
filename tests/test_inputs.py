"""Inputs that grow: how they are made and dealt to tasks."""

import hashlib
import re

import pytest

from pyspark.sql import functions as F

from auditloom.operators import semantic as M
from auditloom.operators import tokens as K
from auditloom.operators.extract import parse_pages
from auditloom.plans import fixtures as X


def test_cleaning_lists_its_characters_and_keeps_the_same_ones(spark):
    sql = X.sql_for_spark(X.ENRICHED_PAGES, "/nowhere")
    assert X.PLAIN not in sql and X.PLAIN in X.sql_for_duckdb(X.ENRICHED_PAGES)
    assert not re.search("A-Z|0-9:|a-z", re.search(r"\[\^ [^']*\+", sql).group())
    points = [p for p in [*range(1, 0x3000), *range(0xD700, 0xD800), *range(0xE000, 0xE100), *range(0xFF00, 0x10100), 0x1F600] if not 0xD800 <= p < 0xE000]
    spark.createDataFrame([(p, f"x {chr(p)}{chr(p)}  y") for p in points], "p int, text string").createOrReplaceTempView("clean_case")
    listed = X.sql_for_spark(X.plain("text"), "/nowhere").replace(" /*G*/", "")
    for r in spark.sql(f"select p, {listed} got from clean_case").collect():
        want = re.sub("  +", " ", re.sub(X.PLAIN, " ", f"x {chr(r.p)}{chr(r.p)}  y")).strip(" ")
        assert r.got == want, r


def test_parsing_tasks_grow_in_number_with_the_files_read(spark, tmp_path, monkeypatch):
    pages = [(k, f"https://s.example/p{k}", f"<title>t {k}</title><body><p>{'some words ' * (k % 7)}</p></body>") for k in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages"))
    read = spark.read.parquet(str(tmp_path / "pages"))
    size = sum(f.stat().st_size for f in (tmp_path / "pages").glob("*.parquet"))
    columns = ["page_id", "title", "body_text_content"]
    want = sorted(map(tuple, parse_pages(read).select(columns).collect()))
    monkeypatch.setattr(K, "TASK_BYTES", -(-size // 40))
    assert 38 <= K.cluster_pages(read).rdd.getNumPartitions() <= 40
    got = parse_pages(read).select(columns)
    assert sorted(map(tuple, got.collect())) == want
    # what is not read from files is dealt as before
    assert K.cluster_pages(spark.createDataFrame(pages, read.schema)).rdd.getNumPartitions() <= 8
    assert got.groupBy("page_id").agg(F.count("*").alias("n")).where("n <> 1").count() == 0


def test_bag_vector_counts_every_first_byte(spark):
    words = [f"w{k}" for k in range(3000)] + ["Éa", "日本", "é"]
    texts = [" ".join(words), "", " \t", None, "one", "One one", *words[:300], *words[-3:]]
    assert len({hashlib.md5(w.encode()).digest()[0] for w in words}) == 256
    column = M.bag_vector(F.col("text"))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in df.select("k", column.alias("got")).collect():
        counts = [0] * M.DIMENSIONS
        for w in (texts[r.k] or "").lower().split():
            counts[hashlib.md5(w.encode()).digest()[0] % M.DIMENSIONS] += 1
        norm = sum(c * c for c in counts) ** 0.5
        assert r.got == pytest.approx([c / norm if norm else 0.0 for c in counts], abs=1e-6)
    # no number is made of each word any more
    assert "conv(" not in df.select(column)._jdf.queryExecution().optimizedPlan().toString()
