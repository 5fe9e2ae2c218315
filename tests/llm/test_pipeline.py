"""The pipeline's stages against what their operators decide, and the registered queries against their SQL."""

import random

import duckdb
import pytest

import corpus_pipeline
from postlens.llm import langid, registry
from postlens.llm.simhash import fingerprint
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(name, spark, sf, db):
    assert compare(registry.QUERIES[name](spark, sf).toPandas(), db.execute(registry.ORACLES[name]).fetchdf()) == ""


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "12 34", "en", None, 5)], docs.schema)
    kept, columns = [docs.unionByName(odd)], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, kept[-1], sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or made.columns == columns
        made.write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False)) and len(ids[1]) >= 0.99 * (len(ids[0]) - 3)
    assert not ids[1] & {9001, 9002, 9003}
    prints = [fingerprint(r["text"]) for r in kept[3].collect()]
    assert all(bin(a ^ b).count("1") > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert ids[4] == ids[5] and kept[5].where("n_tokens > 0").count() == len(ids[5])


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_language_stage_keeps_texts_between_close_languages(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + "x", f"l{i % 8}") for i in range(160)]  # languages that hardly differ
    docs = spark.createDataFrame([*rows, *((160 + i, letter, None) for i, letter in enumerate("abcdefghq")), (1000, None, "l0"), (1001, "12 !", "l1")], "doc_id long, text string, lang string")
    scores = [r["score"] for r in langid.identify(docs, langid.train(docs)).where("lang_pred <> 'und'").collect()]
    assert min(scores) < 0.5
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(169))
