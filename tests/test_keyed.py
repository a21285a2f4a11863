import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.operators import catalog as C
from datascout.sources import keyed
from datascout.sources.workdir import work_dir
from datascout.streaming import ingest

KIND = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("seq", T.LongType())])


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def held(spark, path, before=None):
    return {r.id: r.v for r in keyed.read(spark, path, "id", KIND, before).collect()}


def on_disk(spark, path):
    local = urlparse(path).path
    return {p: spark.read.parquet(f"{local}/{p}").count() for p in os.listdir(local)}


def test_writes_are_in_proportion_to_changes(spark):
    path, r = work_dir(spark, "k"), random.Random(1)
    want = {i: "v" for i in range(4000)} | {None: "none"}
    keyed.put(spark, path, table(spark, [(i, v, 0) for i, v in want.items()]), "id", "seq", KIND, 0)
    changed = 0
    for version in range(1, 6):
        rows = [(r.choice([*range(4500), None]), f"{version}-{k}", k) for k in range(50)]
        keyed.put(spark, path, table(spark, rows), "id", "seq", KIND, version)
        want |= {i: v for i, v, _ in rows}
        changed += len({i for i, _, _ in rows})
    assert held(spark, path) == want
    assert sum(on_disk(spark, path).values()) == 4001 + changed


def test_many_writes_merge_and_older_versions_can_be_read(spark, monkeypatch):
    monkeypatch.setattr(keyed, "DELTAS", 3)
    path, want, at = work_dir(spark, "k"), {i: "v" for i in range(40)}, {}
    keyed.put(spark, path, table(spark, [(i, v, 0) for i, v in want.items()]), "id", "seq", KIND, 0)
    for version in range(1, 8):
        rows = [(k % 50, f"{version}", 1) for k in range(version * 3, version * 3 + 4)]
        keyed.put(spark, path, table(spark, rows), "id", "seq", KIND, version)
        at[version] = dict(want)
        want |= {i: v for i, v, _ in rows}
        assert held(spark, path) == want and held(spark, path, version) == at[version]
        keyed.put(spark, path, table(spark, rows), "id", "seq", KIND, version)  # the write again
        assert held(spark, path) == want
    assert keyed.newest(spark, path) == 7
    assert len(on_disk(spark, path)) < 9 and any(p.startswith("part=-1_") for p in on_disk(spark, path))


@pytest.mark.parametrize("version", [1, 3])
def test_a_write_that_was_cut_short_hides_nothing(spark, monkeypatch, version):
    monkeypatch.setattr(keyed, "DELTAS", 3)
    path = work_dir(spark, "k")
    for v in range(version):
        keyed.put(spark, path, table(spark, [(i, f"v{v}", 1) for i in range(v, 30)]), "id", "seq", KIND, v)
    want = held(spark, path)
    keyed.put(spark, path, table(spark, [(1, "new", 1), (99, "new", 1)]), "id", "seq", KIND, version)
    local = urlparse(path).path
    os.remove(f"{local}/part={version}_{version}/_SUCCESS")
    for p in os.listdir(local):  # a merge that was cut short as well
        if p.startswith("part=-1_"):
            os.remove(f"{local}/{p}/_SUCCESS")
    assert held(spark, path) == want and keyed.newest(spark, path) == version - 1
    keyed.put(spark, path, table(spark, [(1, "again", 1)]), "id", "seq", KIND, version)
    assert held(spark, path) == {**want, 1: "again"}


def test_stored_profiles_after_a_torn_write(spark):
    path = work_dir(spark, "p")
    C.store_profiles(spark.range(50).selectExpr("id", "'a' AS v"), path)
    C.store_profiles(spark.range(5).selectExpr("id", "'b' AS v"), path)
    os.remove(f"{urlparse(path).path}/part=1_1/_SUCCESS")
    assert C.read_profiles(spark, path).where("profile LIKE '%a%'").count() == 50
    C.store_profiles(spark.range(3).selectExpr("id", "'c' AS v"), path)
    assert C.read_profiles(spark, path).count() == 50 and C.read_profiles(spark, path).where("profile LIKE '%c%'").count() == 3


def test_streams_over_many_batches_and_starts(spark, tmp_path):
    r, users, moves, batches = random.Random(3), {}, {}, []
    kind = T.StructType.fromDDL("id long, kind string, seq long, note string")
    for k in range(4):
        rows = [(r.choice([*range(12), None]), r.choice(["a", "b", "c", None]), r.choice([k * 10, k * 10 + 1, None]), f"{k}-{i}") for i in range(15)]
        rows = list({(i, s): (i, t, s, n) for i, t, s, n in rows}.values())  # no ties
        batches.append(rows)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        skipped = ingest.stream_upsert(stream(), str(tmp_path / "skip"), "id", "seq", "kind")
        catalog, counts = ingest.stream_portals(stream(), str(tmp_path / "portals"), "id", "seq", "kind")
        last = {}
        for x in rows:
            if x[0] not in last or (x[2] is not None, x[2] or 0) > (last[x[0]][2] is not None, last[x[0]][2] or 0):
                last[x[0]] = x
        for i, x in last.items():
            moves[i] = x
            if i not in users or users[i][1] != x[1]:
                users[i] = x
        assert {r.id: tuple(r) for r in skipped.collect()} == users
        assert {r.id: tuple(r) for r in catalog.collect()} == moves
        now = [x[1] for x in moves.values() if x[1]]
        assert {r.kind: r.n for r in counts.collect()} == {t: now.count(t) for t in set(now)}
    again, counts = ingest.stream_portals(stream(), str(tmp_path / "portals"), "id", "seq", "kind")
    assert {r.id: tuple(r) for r in again.collect()} == moves
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in held
    written = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "portals" / "rows").iterdir())
    assert written == sum(len({x[0] for x in rows}) for rows in batches)  # a row for each key of each batch, no more
    assert spark.read.format("statestore").load(str(tmp_path / "portals" / "progress"), stateVarName="held").agg(F.count("key")).first()[0] == len(moves)
