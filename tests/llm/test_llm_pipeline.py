"""The pipeline on planted cases, stage by stage."""

import corpus_pipeline
import __spark_entry__ as entry
from clickpath.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id = 3").first()["text"]
    clean = docs.first()
    plant = [(900001, " ".join(reversed(clean["text"].split())) + f"\n{item}", "en", "p", 0), (900002, clean["text"], "en", "p", 0), (900003, "Write to jo.doe@mail.example.org soon, it is late.", "en", "p", 0)]
    docs = docs.union(spark.createDataFrame(plant, docs.schema))
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert clean["doc_id"] in ids[2] and 900002 in ids[1] and 900002 not in ids[2]
    assert 900001 in ids[2] and 900001 not in ids[3]
    assert frames[4].where("doc_id = 900003").first()["text"] == "Write to [EMAIL] soon, it is late."
    assert ids[4] == ids[3] == ids[5]
    assert frames[5].where("n_ids = 0 and doc_id = 900003").count() == 0


def test_tokenize_keeps_the_n_best(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50)
    docs = docs.union(spark.createDataFrame([(900004, None, "en", "p", 0), (900005, "", "en", "p", 0)], docs.schema))
    rows = corpus_pipeline.tokenize(spark, docs, SF).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert all(r["n_best"][0]["ids"] == r["ids"] and r["n_best"][0]["score"] == r["score"] for r in rows)
    assert sum(len(r["n_best"]) == 4 for r in rows) > 40
    assert all(a["score"] >= b["score"] and a["ids"] != b["ids"] for r in rows for a, b in zip(r["n_best"], r["n_best"][1:]))


def test_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and len(QUERIES) == 13
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
