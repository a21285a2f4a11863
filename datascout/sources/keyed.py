"""Tables kept by key in a folder: a base, and deltas that hold what each write brought, the newer over the older.

A write adds its own rows as a delta of the next version and touches nothing else.  Many deltas are merged into one, and with the base once they
have a share of its rows.  A part counts once its job has committed it, so a write that was cut short hides nothing and
is written again; parts that were replaced stay until the next merge, for readers that are still at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas that are merged; share of the base's rows in deltas at which they are merged with it.
DELTAS, SHARE = 16, 0.5


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _committed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) version of each part whose job has finished; first is -1 for a base."""
    fs, found = _folder(spark, f"{path}/part=*/_SUCCESS")
    names = [s.getPath().getParent().getName() for s in fs.globStatus(found) or []]
    return [tuple(map(int, n.removeprefix("part=").split("_"))) for n in names]


def _part(path: str, part: tuple[int, int]) -> str:
    return f"{path}/part={part[0]}_{part[1]}"


def _cover(parts: list[tuple[int, int]], before: int | None) -> list[tuple[int, int]]:
    """The parts that make up the table, or the table as it was before a version: a base, if there is one, and deltas after it."""
    out, upto = [], -2
    for first, last in sorted((p for p in parts if before is None or p[1] < before), key=lambda p: (p[0], -p[1])):
        if last > upto:
            out.append((first, last))
            upto = last
    return out


def newest(spark: SparkSession, path: str) -> int:
    """Number of the newest version; -1 if there is none."""
    return max((last for _, last in _committed(spark, path)), default=-1)


def _rows(spark: SparkSession, path: str, parts: list[tuple[int, int]], key: str, schema: T.StructType) -> DataFrame:
    """The rows of the parts, of each key those of the newest."""
    each = [spark.read.schema(schema).parquet(_part(path, p)) for p in parts]
    if len(each) < 2:
        return each[0] if each else spark.createDataFrame([], schema)
    base, deltas = (each[0], parts[1:]) if parts[0][0] < 0 else (None, parts)
    late = None
    for p, rows in zip(reversed(deltas), reversed(each)):
        rows = rows.select(F.struct(*[f"`{c}`" for c in schema.names]).alias("row"), F.lit(p[1]).alias("version"))
        late = rows if late is None else late.unionByName(rows)
    late = late.groupBy(F.col("row")[key].alias("__k")).agg(F.max_by("row", "version").alias("row"))
    new = late.select("row.*")
    if base is None:
        return new
    gone = late.select("__k")
    return base.join(gone, F.col(f"`{key}`").eqNullSafe(F.col("__k")), "left_anti").unionByName(new)


def read(spark: SparkSession, path: str, key: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The table, or as it was before a version."""
    return _rows(spark, path, _cover(_committed(spark, path), before), key, schema)


def changes(spark: SparkSession, path: str, schema: T.StructType, version: int) -> DataFrame:
    """What a version brought, as long as it isn't merged."""
    return spark.read.schema(schema).parquet(_part(path, (version, version)))


def put(spark: SparkSession, path: str, rows: DataFrame, key: str, seq: str, schema: T.StructType, version: int) -> None:
    """Writes version `version`: of each key of rows the last by seq.  A write that runs again under its number replaces what it wrote before."""
    from ..operators.catalog import last_per_key

    _merge(spark, path, key, schema, version)
    last_per_key(rows.select(*[f"`{c}`" for c in schema.names]), key, seq).write.mode("overwrite").parquet(_part(path, (version, version)))


def _merge(spark: SparkSession, path: str, key: str, schema: T.StructType, version: int) -> None:
    """Merges the parts before a version if there are many, and removes those that an earlier merge replaced."""
    parts = _committed(spark, path)
    cover = _cover(parts, version)
    deltas = [p for p in cover if p[0] >= 0]
    if len(deltas) < DELTAS:
        return
    size = lambda some: sum(spark.read.parquet(_part(path, p)).count() for p in some)  # noqa: E731  from the files' footers
    bases = cover[: len(cover) - len(deltas)]
    whole = not bases or size(deltas) >= SHARE * size(bases)
    made = (-1 if whole else deltas[0][0], deltas[-1][1])
    _rows(spark, path, cover if whole else deltas, key, schema).hint("rebalance").write.mode("overwrite").parquet(_part(path, made))
    for p in parts:
        if p[1] < version and p not in cover and p != made:
            fs, gone = _folder(spark, _part(path, p))
            fs.delete(gone, True)
