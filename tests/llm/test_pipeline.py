"""The corpus pipeline against plain versions of its stages, the query registry, and results over the smallest tables."""

import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from palimpsest.llm import catalog
from tests.llm.test_dedup import every_pair, slow_simhash
from tests.llm.test_mixing_packing import slow_targets

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables")


def test_registry():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near dedup", "mix sources", "packing"]


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "1234 5678 ---", "en", "src0", 13), (10**6 + 1, None, "en", "src0", 0), (10**6 + 2, "漢字 仮名 漢字 仮名 漢字", None, "src1", 14)], docs.schema)
    copies = docs.filter("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 2 * 10**6)
    start = docs.unionByName(junk).unionByName(copies).cache()

    one = corpus_pipeline.language_id(spark, start, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {r.doc_id for r in start.collect()} - {10**6, 10**6 + 1, 10**6 + 2}

    two = corpus_pipeline.near_dedup(spark, one, SF)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    least = dict(zip((i for i, _ in rows), every_pair(rows, corpus_pipeline.WIDE_BITS, corpus_pipeline.PRINTS), strict=True))
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(set(least.values()))
    assert not any(r.doc_id >= 2 * 10**6 for r in two.collect())

    three = corpus_pipeline.mix_sources(spark, two, SF)
    assert three.columns == docs.columns
    before, after = {}, {}
    for d, out in ((two, before), (three, after)):
        for r in d.collect():
            out[r.source] = out.get(r.source, 0) + len(r.text.split())
    want, longest = slow_targets(before), max(len(r.text.split()) for r in two.collect())
    assert all(abs(after.get(s, 0) - want[s]) <= longest / 2 + 1 for s in want)
    assert {r["count"] for r in three.groupBy("doc_id").count().collect()} <= {1, 2, 3}

    four = corpus_pipeline.pack(spark, three, SF)
    assert four.count() == three.count() and sorted(r.doc_id for r in four.collect()) == sorted(r.doc_id for r in three.collect())


@needs_tables
def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "length", "bucket", "batch", "place", "padding"} <= set(got.columns) and got.count() > 50


@needs_tables
def test_contracts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    crc = lambda i: zlib.crc32(str(i).encode())
    lm = catalog.op1_maxent(spark, SF).collect()
    assert len(lm) == len(docs) and all(r.held_out == (crc(r.doc_id) % 5 == 1) and r.n_tokens == len(docs[r.doc_id].text.encode().split()) + 1 for r in lm)
    lang = catalog.op4_language_id(spark, SF).collect()
    assert len(lang) == len(docs) and all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in lang)
    held = [r for r in lang if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    prints = catalog.op2_simhash(spark, SF).collect()
    assert all(r.fingerprint == f"{slow_simhash(docs[r.doc_id].text):016x}" for r in prints)
    pages = catalog.op10_main_text(spark, SF).collect()
    assert len(pages) == 50 and all(len(r.text) == r.n_chars for r in pages)


@needs_tables
def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({catalog.oracle_sql()['op7_mixing']})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in catalog.op7_mixing(spark, SF).collect()) == want
