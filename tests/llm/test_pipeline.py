"""The pipeline against a plain composition of its laws on the smallest tables."""

import corpus_pipeline
from datascout.llm import importance, mixing, sharding
from tests.llm.helpers import documents, saved
from tests.llm.test_near_duplicates import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        rows = now.collect()
        now = spark.createDataFrame(rows, now.schema)
        kept[name] = rows
        if name != "shard":
            assert now.columns == columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored, _, least = importance.judge(docs, labels)
    assert {r.doc_id for r in kept["quality_classifier"]} == {r.doc_id for r in scored.where(f"key >= {least}").collect()}
    want, _ = brute([(r.doc_id, r.text) for r in kept["quality_classifier"]])
    assert {r.doc_id for r in kept["simhash_near_dedup"]} == {i for i, _ in want}
    plain = lambda t: " ".join(t.split())
    items = [plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in kept["simhash_near_dedup"]} - {r.doc_id for r in kept["benchmark_decontamination"]}
    assert gone >= {r.doc_id for r in kept["simhash_near_dedup"] if any(i in plain(r.text) for i in items)} and len(gone) < 0.2 * len(kept["simhash_near_dedup"])
    clean = spark.createDataFrame(kept["benchmark_decontamination"], docs.schema)
    taken = {r.doc_id: r.taken for r in mixing.take(mixing._narrow(clean, [], 3)).collect() if r.taken}
    words = {}
    for r in kept["mix_sources"]:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == taken
    shards = {r.doc_id: r.shard for r in sharding.place(docs).collect()}
    assert all(r.shard == shards[r.doc_id] for r in kept["shard"]) and len(kept["shard"]) == len(kept["mix_sources"])
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, run)) == sorted(map(str, kept["shard"]))


def test_special_rows_and_clashing_columns_go_through(spark):
    long = " ".join(f"w{i * 7 % 1009}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id here at all"), (4, long), (5, long + " more"), (6, "A"), (7, None), (None, None)]
    docs = documents(spark, rows, extra=["rid", "key", "log_weight", "__text", "row", "shard_of", "`a.b`", "h", "c0", "taken"])
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "A"), (None, None)], "item_id long, text string")
    got = corpus_pipeline.run(spark, saved(spark, documents=docs, labels=labels, benchmark=bench))
    assert got.columns == [*docs.columns, "shard", "grown_shard"]
    assert {r.doc_id for r in got.collect()} <= {3, 4, 5, None} and got.where("doc_id = 4 OR doc_id = 5").select("doc_id").distinct().count() <= 1
    assert corpus_pipeline.run(spark, saved(spark, documents=docs.limit(0), labels=labels.limit(0), benchmark=bench.limit(0))).collect() == []
