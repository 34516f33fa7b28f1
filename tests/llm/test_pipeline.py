from __future__ import annotations

import os
import random

import duckdb
import pytest

import corpus_pipeline
from sparkwell.llm import queries

from .conftest import sentence

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(19)
    at = tmp_path_factory.mktemp("corpus")
    item = sentence(r, 40)
    shared = sentence(r, 60)
    docs, labels = [], []
    for i in range(300):
        w = sentence(r, 90).split()
        toxic = i % 6 == 0
        if toxic:
            w[i % 50] = "cretin"
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs[7] = (7, docs[1][1], "en", "s", 0)
    docs[11] = (11, docs[11][1] + " " + item, "en", "s", 0)
    for i in (13, 14):
        docs[i] = (i, docs[i][1] + " " + shared, "en", "s", 0)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict((d[0], d[1]) for d in docs), shared


def test_each_stage(spark, folder):
    at, texts, shared = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic = {i for i in texts if i % 6 == 0 and i != 7}
    assert kept[0].keys() == texts.keys() - toxic
    assert kept[1].keys() == kept[0].keys() - {7}
    assert kept[2].keys() == kept[1].keys() and shared[10:-10] not in kept[2][13] and kept[2][13] == texts[13][: len(kept[2][13])]
    assert kept[3].keys() == kept[2].keys() - {11}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert out.select("doc_id").distinct().count() == 248


def test_stages_on_odd_tables(spark, folder, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), folder[0])
            assert out.count() >= 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")
def test_queries_run_and_match_sql(spark):
    for name, query in queries.QUERIES.items():
        rows = query(spark, FOLDER)
        if name not in queries.ORACLE_SQL:
            assert rows.count() > 0, name
            continue
        con = duckdb.connect()
        for table in ("pages", "documents", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
        want = con.execute(queries.ORACLE_SQL[name]).fetchall()
        columns = [c[0] for c in con.description]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in rows.select(*columns).collect())
