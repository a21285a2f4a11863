"""Micro cases with hand-made expectations, and invariants of search and maintenance."""

import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from datascout.functions import scalars as X
from datascout.plans.facade import vectors
from datascout.operators import catalog as C
from datascout.operators import facets as B
from datascout.operators import profiling as P
from datascout.operators import samples as N
from datascout.operators import search as S
from datascout.operators import text as T
from datascout.operators import vectors as V
from datascout.plans import registry
from datascout.sources import readers as R
from datascout.sources import sinks
from datascout.sources.workdir import work_dir
from datascout.streaming import ingest


def one(spark, value, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(value)], f"i int, v {kind}").orderBy("i").select(column).collect()]


def test_numbers_and_times(spark):
    v = F.col("v")
    assert one(spark, [" 12.5 ", "", "nan", "Infinity", "12d", "-1e3", None, ".5", "1."], X.safe_float(v)) == [12.5, None, None, None, None, -1000.0, None, 0.5, 1.0]
    got = one(spark, ["1700000000", "1700000000123", "2024-01-02 03:04:05.9", "2024-01-02T03:04:05+02:00", "junk", None, ""], X.iso_seconds(X.parse_time(v)))
    assert got == ["2023-11-14T22:13:20Z"] * 2 + ["2024-01-02T03:04:05Z", "2024-01-02T01:04:05Z", None, None, None]
    assert [str(x) for x in one(spark, ["01/31/2024", "31.01.2024", "Jan 31, 2024"], F.to_date(X.parse_date_like(v)))] == ["2024-01-31"] * 3


def test_epochs_of_a_known_unit(spark):
    v = F.col("v")
    texts = ["1700000000", "10000000001", "50000000000", "1700000000123", "9999999999999", "2024-01-02", "junk", None]
    day = lambda unit: one(spark, texts, F.to_date(X.parse_time(v, unit)).cast("string"))
    assert day("s")[:3] + day("s")[4:] == ["2023-11-14", "2286-11-20", "3554-06-09", None, "2024-01-02", None, None]
    assert day("ms")[:4] == ["1970-01-20", "1970-04-26", "1971-08-02", "2023-11-14"]
    assert day(None)[:4] == ["2023-11-14", "1970-04-26", "1971-08-02", "2023-11-14"]
    views = spark.createDataFrame([(1, "https://x/", '{"rowsUpdatedAt": 10000000001}'), (2, "https://x/", '{"viewLastModified": "1700000000"}')], "id long, base_url string, payload string")
    assert [str(r.last_update_date) for r in R.view_metadata(views, unit="s").orderBy("id").collect()] == ["2286-11-20", "2023-11-14"]
    with pytest.raises(ValueError):
        X.epoch_to_timestamp(v, "minutes")


@pytest.mark.parametrize("first", [0, 96_060, 500_000])
def test_views_of_large_ids(spark, first, tmp_path):
    """The query gives its SQL's dates for ids whose epochs are above 1e10 as well."""
    path = str(tmp_path)
    spark.range(first, first + 12).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src1' AS source", "1L AS n_chars").coalesce(1).write.parquet(f"{path}/documents.parquet")
    got = {r.id: r.last_update_date and r.last_update_date.isoformat() for r in registry.QUERIES["view_metadata"](spark, path).collect()}
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert got == {r[0]: r[1] and r[1].isoformat() for r in db.execute(f"SELECT id, last_update_date FROM ({registry.SQL['view_metadata']})").fetchall()}
    assert sum(d is not None for d in got.values()) == 6


def test_names_labels_and_ids(spark):
    v = F.col("v")
    assert one(spark, ["LATITUDE", "pickup_lat", "lat1", "flat", "pickupLat"], v.rlike(X.LAT_NAME)) == [True, True, True, False, False]
    assert one(spark, ["data.cityofnewyork.us", "data.cityofchicago.org"], X.domain_label(v)) == ["Cityofnewyork.Us", "Cityofchicago"]
    assert one(spark, [" AB12-cd34", "abc", None, "12345-678"], X.dataset_id(v)) == ["ab12-cd34", None, None, None]
    assert one(spark, [0, 1023, 1152, 1 << 21], X.readable_bytes(v), "bigint") == ["0.00 B", "1023.00 B", "1.12 KiB", "2.00 MiB"]


def test_boxes(spark):
    boxes = [([0, 0, 1, 1], True), ([0, 0, 0, 1], False), ([-181, 0, 1, 1], False), ([0, 0, 1, float("nan")], False), (None, False)]
    got = one(spark, [b and [float(x) for x in b] for b, _ in boxes], X.valid_bbox(*[F.get("v", F.lit(i)) for i in range(4)]), "array<double>")
    assert got == [w for _, w in boxes]
    touch = lambda a, b: spark.range(1).select(X.boxes_touch(tuple(map(F.lit, map(float, a))), tuple(map(F.lit, map(float, b))))).first()[0]
    assert touch([0, 0, 1, 1], [1, 1, 2, 2]) and not touch([0, 0, 1, 1], [1.1, 0, 2, 1])
    assert touch([170, 0, -170, 1], [-175, 0, -172, 1]) and not touch([170, 0, -170, 1], [0, 0, 10, 1]) and touch([170, 0, -170, 1], [175, 0, -179, 2])
    with pytest.raises(ValueError):
        S.touches_box([1.0, 2.0])


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "the banana"), (3, None), (4, "cherry")], "id long, body string")
    q = spark.createDataFrame([(1, "Apple the"), (2, "banana banana"), (3, "the of"), (4, None)], "qid long, keywords string")
    got = {(r.qid, r.id): r.score for r in T.bm25(q, docs, "body").collect()}
    n, avg = 3, 5 / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    tf = lambda f, dl: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg))
    want = {(1, 1): idf(1) * tf(2, 3), (2, 1): 2 * idf(2) * tf(1, 3), (2, 2): 2 * idf(2) * tf(1, 1)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_operators_arms_and_paging(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} x", f"w{i % 5} y w{i % 2}") for i in range(60)], "id long, title string, description string").withColumns({"ufd": F.col("title"), "sfd": F.lit("")})
    q = spark.createDataFrame([(1, "w1 y"), (2, "w0 x")], "qid long, keywords string")
    both = T.lexical(q, docs, operator="and").collect()
    assert all(r.id % 5 == 1 or r.id % 2 == 1 for r in both if r.qid == 1) and all(r.id % 3 == 0 for r in both if r.qid == 2)
    whole = [(r.qid, r.id) for r in T.ranked(T.lexical(q, docs, operator="or"), 100).orderBy("qid", "rank").collect()]
    pages = [(r.qid, r.id) for k in range(0, 100, 10) for r in T.ranked(T.lexical(q, docs, operator="or"), 10, k).orderBy("qid", "rank").collect()]
    assert sorted(pages) == sorted(whole) and len(set(pages)) == len(pages)
    for wrong in (dict(arm="none"), dict(operator="xor")):
        with pytest.raises(ValueError):
            T.lexical(q, docs, **wrong)
    assert T.search_fields("sfd", 0) == {"sfd": 1.0}


def test_facets_add_up(spark):
    m = spark.createDataFrame([(1, i, f"k{i % 13}", ["a", "a", f"t{i % 2}"]) for i in range(50)] + [(1, 99, None, None)], "qid int, id int, domain string, types array<string>")
    got = S.facet(m, F.col("domain")).collect()
    assert len(got) == 10 and {sum(r.n for r in got) + r.other for r in got} == {50}
    assert {(r.key, r.n) for r in S.facet(m, F.col("types")).collect()} == {("a", 50), ("t0", 25), ("t1", 25)}


@pytest.mark.parametrize("dense", [1, 2, 10**9])
def test_facets_from_bitmaps(spark, dense):
    records = spark.createDataFrame([(i * 977 - 100_000, f"k{i % 13}" if i % 5 else f"rare{i}", ["a", "a", f"t{i % 2}", None]) for i in range(900)] + [(99, None, None)], "id long, domain string, types array<string>")
    matches = records.selectExpr("explode(array(1, 2, 3)) AS qid", "id").where("qid = 1 OR qid = 2 AND id > 0 OR qid = 3 AND id = 99")
    for value in (F.col("domain"), F.col("types")):
        index = B.index_values(records, value, dense)
        want = S.facet(matches.join(records, "id"), value)
        assert sorted(map(tuple, B.facet(matches, index).collect())) == sorted(map(tuple, want.collect()))
        assert (index.dense.count() == 0) == (dense == 10**9) and (index.sparse.count() == 0) == (dense == 1)


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(50, None)], "id long, vector array<float>")
    q = v.where("id < 3").withColumnRenamed("id", "qid")
    exact = {(r.qid, r.id, r.score) for r in V.knn(q, v, 3).collect()}
    assert {(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.2)} <= exact and len(exact) == 9
    assert {(r.qid, r.id, r.score) for r in V.knn_lists(q, v, 3).collect()} <= {(r.qid, r.id, r.score) for r in V.knn(q, v, 20).collect()}
    assert V.knn_lists(q, v.where("id < 0"), 3).collect() == [] and len(V.knn_lists(q, v.where("id = 4"), 3).collect()) == 3
    t = spark.createDataFrame([(1, "red fish"), (2, None)], "id long, text string")
    assert [len(r.vector) for r in V.embed(t, "text", 16).collect()] == [16, 16]
    assert [r.vector for r in V.embed(t, "text", encoder=lambda xs: [[float(len(x))] for x in xs]).orderBy("id").collect()] == [[8.0], [0.0]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_approximate_neighbours(spark, sf):
    v = vectors(spark, f"/root/testdata/{sf}")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    exact = {(r.qid, r.id) for r in V.knn(q, v).collect()}
    got = {(r.qid, r.id) for r in V.knn_lists(q, v).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_compressed_vectors(spark, sf):
    v = vectors(spark, f"/root/testdata/{sf}")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "qid")
    books, codes = V.compress(v)
    exact = {(r.qid, r.id): r.score for r in V.knn(q, v).collect()}
    got = {(r.qid, r.id): r.score for r in V.knn_codes(q, v, codes, books).collect()}
    assert len(got) == len(exact) and len(got.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(exact[p] == s for p, s in got.items() if p in exact)
    assert codes.agg(F.max(F.length("codes"))).first()[0] == 64 // 4 and codes.count() == v.where("vector IS NOT NULL").count()


def test_compressed_vectors_of_odd_tables(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 0.0, float(i % 3)]) for i in range(20)] + [(50, None)], "id long, vector array<float>")
    q = v.where("id < 3 OR id = 50").withColumnRenamed("id", "qid")
    books, codes = V.compress(v)
    assert {(r.qid, r.id, r.score, r["rank"]) for r in V.knn_codes(q, v, codes, books, 3).collect()} == {(r.qid, r.id, r.score, r["rank"]) for r in V.knn(q, v, 3).collect()}
    none = v.where("id = 50")
    books, codes = V.compress(none)
    assert books is None and V.knn_codes(q, none, codes, books).collect() == [] == V.knn_codes(q.limit(0), v, *reversed(V.compress(v))).collect()


def test_index_search_is_the_plain_search(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} x", f"w{i % 5} y w{i % 2} w{i % 5}" if i % 7 else None) for i in range(60)] + [(99, None, "the of")], "id long, title string, description string")
    q = spark.createDataFrame([(1, "w1 y y"), (2, "w0 x"), (3, "the"), (4, None), (5, "zzz w1")], "qid long, keywords string")
    index = T.build_index(docs, ["title", "description"], work_dir(spark, "index"))
    rows = lambda df: sorted((r.qid, r.id, r.score) for r in df.collect())
    for op in ("and", "or"):
        assert rows(T.lexical(q, index, operator=op)) == rows(T.lexical(q, docs, operator=op))
    none = T.build_index(docs.where("id < 0"), ["title", "description"], work_dir(spark, "index"))
    assert rows(T.lexical(q, none, operator="or")) == []


def test_a_search_for_few_terms_skips_other_pages(spark, tmp_path):
    docs = spark.range(30_000).selectExpr("id", "concat('w', id % 5000, ' x', id % 777, ' both both') AS body").coalesce(2)
    spark.conf.set("parquet.block.size", str(1 << 17))
    try:
        index = T.build_index(docs, ["body"], str(tmp_path / "i"))
    finally:
        spark.conf.unset("parquet.block.size")
    q = spark.createDataFrame([(1, "w77 both nothing")], "qid long, keywords string")
    rare = spark.createDataFrame([(1, "w77")], "qid long, keywords string")
    near = lambda df: {r.id: round(r.score, 9) for r in df.collect()}
    assert near(T.indexed_bm25(q, index, "body")) == near(T.bm25(q, docs, "body"))

    def scanned(df):
        df.collect()
        plan, todo, rows = df._jdf.queryExecution().executedPlan(), [], []
        todo.append(plan)
        while todo:
            p = todo.pop()
            name = p.nodeName()
            if name == "AdaptiveSparkPlan":
                todo.append(p.executedPlan())
            elif name.endswith("QueryStage"):
                todo.append(p.plan())
            elif name.startswith("Scan parquet") and "postings" in p.toString() + str(p.relation().location().rootPaths()):
                rows.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return sum(rows)

    assert 0 < scanned(T.indexed_bm25(rare, index, "body")) < 0.1 * index.postings.count()


def test_hybrid_filter_before_or_after(spark):
    docs = spark.createDataFrame([(i, "none", "none", i % 2) for i in range(10)], "id long, title string, description string, odd int")
    v = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, vector array<float>")
    q, qv = spark.createDataFrame([(1, "zzz")], "qid long, keywords string"), spark.createDataFrame([(1, [0.0])], "qid long, vector array<float>")
    ids = lambda mode: sorted(r.id for r in S.hybrid(q, qv, docs, v, F.col("odd") == 1, 4, mode, operator="or").collect())
    assert ids("post") == [1, 3] and ids("pre") == [1, 3, 5, 7]


def test_join_forms_agree_with_plain_joins(spark):
    q = spark.range(30).selectExpr("id AS qid", "date_add(date'2020-01-01', cast(id * 97 % 900 AS int)) AS q_start", "date_add(date'2020-01-01', cast(id * 97 % 900 + id * 20 AS int)) AS q_end", "cast(id * 53 % 360 - 180 AS double) AS q_min_lon", "cast(id * 31 % 170 - 85 AS double) AS q_min_lat")
    q = q.selectExpr("*", "CASE WHEN q_min_lon + 40 > 180 THEN q_min_lon - 320 ELSE q_min_lon + 40 END AS q_max_lon", "q_min_lat + 5 AS q_max_lat")
    r = spark.range(200).selectExpr("id", "date_add(date'2020-01-01', cast(id * 7 AS int)) AS t_start", "date_add(date'2020-01-01', cast(id * 7 + id % 500 AS int)) AS t_end", "cast(id * 17 % 350 - 180 AS double) AS min_lon", "cast(id * 11 % 170 - 85 AS double) AS min_lat", "cast(id * 17 % 350 - 170 AS double) AS max_lon", "cast(id * 11 % 170 - 80 AS double) AS max_lat")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(S.join_time(q, r)) == pairs(q.crossJoin(r).where("t_end >= q_start AND t_start <= q_end").select("qid", "id"))
    cols = ("min_lon", "min_lat", "max_lon", "max_lat")
    assert pairs(S.join_boxes(q, r)) == pairs(q.crossJoin(r).where(X.boxes_touch(tuple(F.col("q_" + c) for c in cols), tuple(map(F.col, cols)))).select("qid", "id"))


def test_staleness_and_upsert(spark):
    inc = spark.createDataFrame([(1, "Socrata", "a"), (2, "socrata", "a"), (3, "socrata", "a"), (4, "socrata", None), (5, "socrata", "a"), (6, "ckan", "a")], "id int, provider string, source_ts string")
    idx = spark.createDataFrame([(2, "a"), (3, "b"), (4, "a"), (5, None), (6, "a")], "id int, indexed_ts string")
    assert {r.id: r.state for r in C.staleness(inc, idx).collect()} == {1: "new", 2: "current", 3: "stale", 4: "unknown", 5: "unknown", 6: "unknown"}
    now = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 7), (3, "z", 1)], "id int, v string, seq int")
    once = C.upsert(now, new, "id", "seq")
    assert {(r.id, r.v) for r in once.collect()} == {(1, "old"), (2, "y"), (3, "z")} == {(r.id, r.v) for r in C.upsert(once, new, "id", "seq").collect()}


def test_profiles(spark):
    t = spark.createDataFrame([("10", "2024-01-01", "POINT (1 2)", None), ("x", "2024-03-01", "POINT (3 95)", "a")] + [(str(i), "2024-02-01", "POINT (5 6)", "b") for i in range(20)], "n string, start_date string, geom string, c string")
    cells = P.unpivot(t, "t")
    types = {r.name: (r.structural_type, r.kind) for r in P.structural_types(cells).collect()}
    assert types == {"n": ("Number", "numerical"), "start_date": ("DateTime", "temporal"), "geom": ("GeoCoordinates", "spatial"), "c": ("Text", "categorical")}
    assert tuple(P.spatial_coverage(cells).first()) == ("t", 1.0, 2.0, 5.0, 6.0)
    assert tuple(map(str, P.temporal_coverage(cells).first())) == ("t", "2024-01-01", "2024-03-01")
    assert sum(r["count"] for r in P.numeric_histogram(cells).collect() if r.name == "n") == 21


def test_profile_text_by_width(spark):
    col = lambda i: (f"c{i}", "Number", [], 3, 1.5, None, 0.0, 2.0)
    kind = "dataset string, nb_rows long, nb_columns long, types array<string>, columns array<struct<name:string,structural_type:string,semantic_types:array<string>,num_distinct_values:long,mean:double,std:double,min:double,max:double>>, attribute_keywords array<string>, spatial_coverage struct<label:string,bbox:array<double>>"
    rows = [("narrow", 5, 2, ["numerical"], [col(0), col(1)], ["c0"], ("L", None)), ("wide", 5, 90, [], [col(i) for i in range(90)], None, None), ("none", 5, None, None, [], ["a", "b"], None)]
    got = {r.dataset: json.loads(r.profile) for r in P.profile_text(spark.createDataFrame(rows, kind)).collect()}
    assert got["narrow"]["columns"][0] == {"name": "c0", "structural_type": "Number", "num_distinct_values": 3, "mean": 1.5, "min": 0.0, "max": 2.0} and got["narrow"]["spatial_coverage"] == {"label": "L"}
    assert len(got["wide"]["columns"]) == 80 and set(got["wide"]["columns"][0]) == {"name", "structural_type"} and got["wide"]["columns_truncated"] == {"shown": 80, "total": 90}
    assert got["none"] == {"nb_rows": 5, "column_names": ["a", "b"]}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "reg.json").write_text(json.dumps([{"url": " a.gov ", "dataset_count": 5}, {"url": "b.gov", "dataset_count": 50}, {"url": "a.gov"}, {"url": " "}, {"url": None}]))
    reg = R.read_registry(spark, str(tmp_path / "reg.json"))
    assert [r.url for r in R.registry_domains(reg).orderBy("pos").collect()] == ["a.gov", "b.gov"]
    sinks.write_registry(R.large_registry(reg.withColumn("dataset_count", F.col("dataset_count").cast("string"))), str(tmp_path / "out"))
    assert [r.url for r in spark.read.json(str(tmp_path / "out")).collect()] == ["b.gov"]
    (tmp_path / "cat.json").write_text(json.dumps([{"id": "x", "types": ["spatial"], "unknown": 1}]))
    assert R.read_catalog(spark, str(tmp_path / "cat.json")).first().types == ["spatial"]
    (tmp_path / "t.csv").write_bytes(b"a,b\n1,x\nbad\xff,y\n")
    assert [r.a for r in R.read_table(spark, str(tmp_path / "t.csv"), "a int, b string").collect()] == [1, None]
    sinks.create_table(spark, "portals_t", "domain string")
    spark.sql("INSERT INTO portals_t VALUES ('a')")
    sinks.create_table(spark, "portals_t", "domain string")
    assert spark.table("portals_t").count() == 1
    sinks.create_table(spark, "portals_t", "domain string", replace=True)
    assert spark.table("portals_t").count() == 0


def test_profile_store_replaces_by_key(spark):
    path = work_dir(spark, "p")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(30)], "id int, v string")
    C.store_profiles(rows, path)
    C.store_profiles(rows.where("id = 7").selectExpr("id", "'new' AS v"), path)
    C.store_profiles(spark.createDataFrame([(99, "x")], "id int, v string"), path)
    got = {r.id: json.loads(r.profile)["v"] for r in C.read_profiles(spark, path, "int").collect()}
    assert got == {**{i: f"v{i}" for i in range(30)}, 7: "new", 99: "x"}
    assert C.read_profiles(spark, work_dir(spark, "none"), "int").collect() == []
    found = C.find_profiles(spark.createDataFrame([("ab",), ("abc",), ("q",)], "want string"), spark.createDataFrame([("abc",), ("ab_profile.json",), ("abd",)], "name string"))
    assert {(r.want, r.name) for r in found.collect()} == {("ab", "ab_profile.json"), ("abc", "abc")}


def test_streams_equal_batches(spark, tmp_path):
    kind = "id long, v string, seq long"
    for k in range(3):
        spark.createDataFrame([(i % 7, f"v{k}-{i}", k * 100 + i) for i in range(20)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: ingest.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.read.parquet(str(tmp_path / "in")).schema)
    got = ingest.stream_upsert(stream(), str(tmp_path / "cat"), "id", "seq")
    assert {r.id for r in got.collect()} == set(range(7)) and got.count() == 7
    assert sorted(map(str, ingest.stream_upsert(stream(), str(tmp_path / "cat"), "id", "seq").collect())) == sorted(map(str, got.collect()))
    spark.createDataFrame([(3, "late", 999), (50, "new", 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = {r.id: r.v for r in ingest.stream_upsert(stream(), str(tmp_path / "cat"), "id", "seq").collect()}
    assert late == {**{r.id: r.v for r in got.where("id <> 3").collect()}, 3: "late", 50: "new"}
    none = ingest.file_stream(spark, str(tmp_path / "in"), "*.nothing", spark.read.parquet(str(tmp_path / "in")).schema)
    assert ingest.stream_upsert(none, str(tmp_path / "empty"), "id", "seq").collect() == []
    ingest.stream_counts(stream(), str(tmp_path / "n"), "v")
    assert {(r.v, r.n) for r in ingest.stream_counts(stream(), str(tmp_path / "n"), "v").where("v LIKE 'v%'").collect()} == {(f"v{k}-{i}", 1) for k in range(3) for i in range(20)}


def test_portal_defaults(spark):
    kind = "domain string, dataset_count int"
    some, none, default = spark.createDataFrame([("a", 1)], kind), spark.createDataFrame([], kind), spark.createDataFrame([("x", 0), ("y", 0)], kind)
    assert [r.domain for r in N.or_default(some, default).collect()] == ["a"]
    assert sorted(r.domain for r in N.or_default(none, default).collect()) == ["x", "y"]


def test_samples_at_any_depth(spark):
    rows, text = [{"a": 1, "b": {"z": [1, "é"], "y": None}, "c": None}, 7, None, [1], "s"], "u,v\r\n\r\n3,4"
    shown = [{"a": "1", "b": '{"z":[1,"é"],"y":null}', "c": None}, {"value": "7"}, {"value": None}, {"value": "[1]"}, {"value": "s"}]
    deep = {"rows": [5]}
    for _ in range(9):
        deep = {"k": [0, deep]}
    cases = [
        ({"rows": rows}, (shown, None)), ({"x": {"y": [{"z": {"data": rows}}]}}, (shown, None)), ({"a": "p,q\n1,2", "columns": [{"c": 1}, {"sampleData": [5]}]}, ([{"value": "5"}], None)),
        ({"sample": "only", "b": text}, (None, text)), ({"rows": "no", "profiler_metadata": {"sample_data": []}}, ([], None)), ({"sample": text, "data": [1]}, ([{"value": "1"}], None)),
        ({"b": {"rows": [1]}, "a": {"rows": [2]}}, ([{"value": "1"}], None)), ({"a": [[], [{"q": text}]], "profiler_metadata": {"x": {"y": {"rows": [8]}}}}, ([{"value": "8"}], None)), (deep, ([{"value": "5"}], None)), (text, (None, text)), ([text, 1], (None, text)),
        ([], None), (None, None), (3, None), ("x", None), ({"rows": {"a": 1}, "sample": "one line"}, None),
    ]
    texts = [(i, json.dumps(p, ensure_ascii=False)) for i, (p, _) in enumerate(cases)] + [(100, None), (101, ""), (102, "{bad"), (103, '{"a":1,"a":2}'), (0, json.dumps(cases[0][0], ensure_ascii=False))]
    found = N.located(spark.createDataFrame(texts, "id int, profile string"))
    got = {r.id: (r.rows, r.text) for r in found.collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}
    assert "Python" not in found._jdf.queryExecution().toString()
    assert N.located(spark.createDataFrame([], "id int, profile string")).collect() == []


def test_last_write_with_equal_order_values(spark):
    rows = [(1, "a", 5), (1, "b", 5), (1, "c", 5), (None, "n", 1)]
    got = {str(sorted(map(str, C.last_per_key(spark.createDataFrame(rows[k:] + rows[:k], "id int, v string, seq int").repartition(k + 1), "id", "seq").collect()))) for k in range(4)}
    assert len(got) == 1
    now = spark.createDataFrame([(None, "old", 0), (1, "old", 0)], "id int, v string, seq int")
    assert {(r.id, r.v) for r in C.upsert(now, spark.createDataFrame([(None, "new", 1)], "id int, v string, seq int"), "id", "seq").collect()} == {(None, "new"), (1, "old")}
