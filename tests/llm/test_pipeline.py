import os
import re
import zlib

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from lanegraph.llm import mixing, packing, quality_classifier, quality_rules, simhash
from lanegraph.llm.queries import queries
from tests.llm.fixtures import clashing, documents, frame

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_one_by_one(spark):
    """Each stage equals what its operator decides on the same rows; run() equals the stages in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "quality_classifier", "simhash_near_dedup", "mixing", "packing"]
    one = cp.rules_stage(spark, docs, SF)
    assert ids(one) == ids(quality_rules.judge_documents(docs, labels).where("kept"))
    one = one.cache()
    two = cp.classifier_stage(spark, one, SF)
    assert ids(two) == ids(quality_classifier.score_documents(one, labels).where(f"score >= {quality_classifier.THRESHOLD}"))
    two = two.cache()
    three = cp.dedup_stage(spark, two, SF)
    assert ids(three) == sorted({r["component_id"] for r in simhash.near_documents(two).collect()})
    three = three.cache()
    four = cp.mixing_stage(spark, three, SF)
    want = sorted(r["doc_id"] for r in mixing.mix(three, labels, cp.TARGETS).collect() for _ in range(r["copies"]))
    assert ids(four) == want
    assert all(df.columns == docs.columns for df in (one, two, three, four))
    five = cp.packing_stage(spark, four.cache(), SF)
    assert five.where("piece = 0").count() == len(want)
    whole = cp.run(spark, SF)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(five) and packing.CAPACITY == 4096


def test_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeats, clashing columns and a very long text through all stages; then tables without rows."""
    for name, docs, labels in (("some", documents(3, 40) + [(900, "word and more " * 9000, "en", "s", 1)], [(i, int(i % 4 > 0), 0) for i in range(40)] + [(3, None, None), (None, 1, 0), (3, 1, 1)]), ("none", [], [])):
        sf = str(tmp_path / name)
        clashing(frame(spark, docs)).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        done = cp.run(spark, sf).collect()
        assert bool(done) == bool(docs)
        assert all(r["offset"] + r["length"] <= packing.CAPACITY for r in done)
        long = [r for r in done if r["doc_id"] == 900]
        assert sum(r["length"] for r in long) == 0 or [r["start"] for r in sorted(long, key=lambda r: r["piece"])][0] == 0


def test_stages_bound_arrow_batches(spark, tmp_path):
    """Batches end by their bytes, so that neither executors nor workers hold thousands of long texts at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    try:
        for name, stage in cp.STAGES:
            spark.conf.set(key, before)
            stage(spark, frame(spark, documents(3, 10)), sf)
            rows = spark.range(0, 1500, 1, 1).selectExpr("id", "repeat('word ', 2000) AS text")
            sizes = [r["bytes"] for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches), "bytes long").collect()]
            assert len(sizes) > 4 and max(sizes) < 2.9e6, name  # by default one batch of 15 MB
    finally:
        spark.conf.set(key, before)


def test_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_columns_of_the_queries(spark):
    """What the thin queries add to their operators: marks of held-out rows, hex digits, predictions, verdicts; one row per document."""
    made = {int(k[2:].split("_")[0]): f for k, f in queries().items()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    crc = {i: zlib.crc32(str(i).encode()) for i in docs}
    rows = {n: {r["doc_id"]: r for r in made[n](spark, SF).collect()} for n in (1, 2, 3, 7, 9)}
    assert all(set(r) == set(docs) for r in rows.values())
    known = {r["lang"] for r in docs.values()} | {"und"}
    for i in docs:
        one, two, three, seven, nine = (rows[n][i] for n in (1, 2, 3, 7, 9))
        assert one["held_out"] == (crc[i] % 4 == 2) and one["lang_pred"] in known and 0 <= one["score"] <= 1
        assert int(two["fingerprint"], 16) >= 0 and len(two["fingerprint"]) == 16 and two["component_id"] <= i
        assert three["n_chars"] == len(docs[i]["text"] or "") and 0 <= three["near_edited"] <= 1
        assert seven["held_out"] == (crc[i] % 5 == 0) and seven["predicted"] == int(seven["score"] >= 0.3)
        assert nine["n_words"] == len(re.findall("[^\\x20\\x09-\\x0D]+", docs[i]["text"] or "")) and not (nine["kept"] and nine["base_failed"])
    held = [one["lang_pred"] == docs[i]["lang"] for i, one in rows[1].items() if one["held_out"] and one["lang_pred"] != "und"]
    assert sum(held) > 0.9 * len(held)
