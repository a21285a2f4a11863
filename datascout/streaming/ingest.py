"""Incremental catalog maintenance with Structured Streaming.  What a batch writes is in proportion to its arrivals."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalog import _tie
from ..sources import keyed

#: Fixed value: the state store that keeps state of processors on disk.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Columns that a change has besides those of its arrival: whether the key was there before, and the watched value that it had then.
KNOWN, BEFORE = "__known", "__before"


def file_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


class Changes(StatefulProcessor):
    """Keeps one value of each key in state; of a batch's arrivals of a key it passes on the last, with the value before, if it isn't to be skipped."""

    def __init__(self, seq: str, watched: str, kind: str, skip_equal: bool):
        self.seq, self.watched, self.kind, self.skip_equal = seq, watched, kind, skip_equal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", f"value {self.kind}")

    def _order(self, row: Row) -> tuple:
        return row[self.seq] is not None, row[self.seq], row["__tie"]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=self._order)
        known = self.held.exists()
        before = self.held.get()[0] if known else None
        if known and self.skip_equal and before == last[self.watched]:
            return
        self.held.update((last[self.watched],))
        own = last.asDict()
        del own["__tie"]
        yield Row(**own, **{KNOWN: known, BEFORE: before})

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """A query that starts inside keeps its state on disk; the session's own choice comes back after."""
    old = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.set(_STORE[0], old)


def _changes(arrivals: DataFrame, key: str, seq: str, watched: str, skip_equal: bool) -> DataFrame:
    """A stream of changes: columns of arrivals, KNOWN and BEFORE."""
    field = arrivals.schema[watched]
    kind = T.StructType([*[T.StructField(f.name, f.dataType) for f in arrivals.schema], T.StructField(KNOWN, T.BooleanType()), T.StructField(BEFORE, field.dataType)])
    rows = arrivals.withColumn("__tie", _tie(arrivals))
    return rows.groupBy(key).transformWithState(Changes(seq, watched, field.dataType.simpleString(), skip_equal), kind, "Update", "None")


def _run(stream: DataFrame, put, path: str, update: bool = True) -> None:
    with _state_store(stream.sparkSession):
        query = stream.writeStream.outputMode("update" if update else "append").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_upsert(arrivals: DataFrame, path: str, key: str, seq: str, unchanged: str | None = None) -> DataFrame:
    """Puts each arriving batch over the catalog at `path` by key, and returns the catalog after all that is there has arrived.

    Of several arrivals of a key in a batch the last by seq counts.  A batch writes these rows and nothing else.
    unchanged: a column; an arrival whose value equals its key's last one is skipped.  That value is kept in the query's state, by key, so the
    catalog isn't read for it.  A batch that runs again writes its version again.  A stream that starts again without new
    arrivals returns the catalog as it is.  Columns are atomic if `unchanged` is given.
    """
    spark, schema = arrivals.sparkSession, arrivals.schema

    def put(batch: DataFrame, number: int) -> None:
        keyed.put(batch.sparkSession, f"{path}/rows", batch, key, seq, schema, number)

    _run(_changes(arrivals, key, seq, unchanged, True) if unchanged else arrivals, put, path, bool(unchanged))
    return keyed.read(spark, f"{path}/rows", key, schema)


def stream_counts(arrivals: DataFrame, path: str, by: str) -> DataFrame:
    """Arrivals counted by a column, kept up to date with each batch; the last counts are returned, also by a stream that starts again without arrivals.

    The counts are the query's state; a batch writes those that it changed.
    """
    spark = arrivals.sparkSession
    counts = arrivals.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        keyed.put(batch.sparkSession, f"{path}/rows", batch, by, "n", counts.schema, number)

    _run(counts, put, path)
    return keyed.read(spark, f"{path}/rows", by, counts.schema)


def stream_portals(arrivals: DataFrame, path: str, key: str, seq: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The catalog as stream_upsert() keeps it, and how many of its records each value of `by` has: (by, n), values without records left out.

    State knows each record's value, so a record that moves from one value to another takes one off the old count: neither the
    catalog nor its counts are computed anew.  A batch reads the counts of the values that it changes.  Null counts nowhere.
    """
    spark, schema = arrivals.sparkSession, arrivals.schema
    changed = T.StructType([*schema, T.StructField(KNOWN, T.BooleanType()), T.StructField(BEFORE, schema[by].dataType)])
    counted = T.StructType([T.StructField(by, schema[by].dataType), T.StructField("n", T.LongType())])

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        keyed.put(own, f"{path}/rows", batch, key, seq, changed, number)
        news = keyed.changes(own, f"{path}/rows", changed, number)
        steps = news.select(F.explode(F.array(F.struct(F.col(by).alias("v"), F.lit(1).alias("d")), F.struct(F.when(F.col(KNOWN), F.col(BEFORE)).alias("v"), F.lit(-1).alias("d")))).alias("s")).select("s.*")
        steps = steps.where("v IS NOT NULL").groupBy("v").agg(F.sum("d").alias("d")).where("d <> 0")
        old = keyed.read(own, f"{path}/counts", by, counted, number).withColumnRenamed("n", "old")
        new = steps.join(old, F.col("v") == F.col(by), "left").select(F.col("v").alias(by), (F.coalesce("old", F.lit(0)) + F.col("d")).alias("n"))
        keyed.put(own, f"{path}/counts", new, by, "n", counted, number)

    _run(_changes(arrivals, key, seq, by, False), put, path)
    return keyed.read(spark, f"{path}/rows", key, changed).drop(KNOWN, BEFORE), keyed.read(spark, f"{path}/counts", by, counted).where("n > 0")
