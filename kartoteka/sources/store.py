"""A store of results by document id, in place of a service's memory: upserts, look-ups of many ids, downloads by format.

The store is a folder of Parquet files in hash buckets of the id, with Bloom filters on it. An upsert adds a generation and
rewrites nothing; of several generations of an id the latest counts, and `compacted` keeps that one alone. A look-up reads the
buckets of the ids that are asked for, and in them the row groups that may hold such an id.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.sources import shared

FORMATS = ("json", "xlsx", "docx")
#: Ids up to this number are written into the query, so that buckets are pruned when it is planned.
LITERAL_IDS = 1000
#: Bytes of an asked id's row, to see whether all of them may be broadcast.
ID_ROW_BYTES = 64
BROADCAST_BYTES = 32 << 20
_OWN = ("bucket", "generation", "place")


@dataclass(frozen=True)
class Store:
    """A store's place and its fixed number of buckets. ids_per_bucket sizes the Bloom filters."""

    path: str
    buckets: int
    key: str = "document_id"
    ids_per_bucket: int = 100_000


def create(spark: SparkSession, path: str, buckets: int = 64, key: str = "document_id", ids_per_bucket: int = 100_000) -> Store:
    """A new store; its settings stand beside its rows, as buckets can't change later."""
    if shared.exists(spark, f"{path}/settings"):
        raise ValueError(f"a store is there already: {path}")
    store = Store(path, buckets, key, ids_per_bucket)
    spark.createDataFrame([(json.dumps(asdict(store)),)], "value string").coalesce(1).write.text(f"{path}/settings")
    return store


def opened(spark: SparkSession, path: str) -> Store:
    return Store(**json.loads(spark.read.text(f"{path}/settings").first().value) | {"path": path})


def _bucket(store: Store, key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(store.buckets)).cast("int")


def upsert(store: Store, rows: DataFrame, generation: int, place: Column | None = None) -> None:
    """Adds rows; a later generation's row replaces an earlier one's of the same id.

    place: of rows of one id within the generation the one with the greatest place stays, and of equal places any; without it
    all are taken for equal documents. A generation that is written again, as a stream does after a failure, changes nothing.
    Rows without an id can't be found again and are not kept. All generations have the same columns.
    """
    if clash := {c.lower() for c in rows.columns} & set(_OWN):
        raise ValueError(f"columns of the store's own: {sorted(clash)}")
    known = rows.where(F.col(store.key).isNotNull())
    keyed = known.withColumns({"bucket": _bucket(store, F.col(store.key)), "generation": F.lit(generation).cast("long"), "place": (F.lit(0) if place is None else place).cast("long")})
    # hashed ids fill buckets evenly; a sorted file has narrow row groups
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", store.key)
    writer = dealt.write.mode("append").partitionBy("bucket")
    name = f"parquet.bloom.filter.enabled#{store.key}"
    writer.option(name, "true").option(f"parquet.bloom.filter.expected.ndv#{store.key}", str(store.ids_per_bucket)).parquet(f"{store.path}/rows")


def _rows(spark: SparkSession, store: Store) -> DataFrame | None:
    there = f"{store.path}/rows"
    return spark.read.parquet(there) if shared.exists(spark, there) else None


def _latest(rows: DataFrame, store: Store) -> DataFrame:
    """One row an id: of the latest generation, then place, then content. Ids are hashed, and a repeated id costs its own rows."""
    values = [c for c in rows.columns if c not in (*_OWN, store.key)]
    whole = F.max(F.struct("generation", "place", *values)).alias("r")
    return rows.groupBy("bucket", store.key).agg(whole).select("bucket", store.key, "r.generation", "r.place", *[f"r.{c}" for c in values])


def results(spark: SparkSession, store: Store) -> DataFrame | None:
    """All ids' latest rows; null for a store without any."""
    rows = _rows(spark, store)
    return None if rows is None else _latest(rows, store).drop(*_OWN)


def compacted(spark: SparkSession, store: Store) -> None:
    """Rewrites the buckets in which an id has several rows, each at once when it is whole; others stay as they are."""
    rows = _rows(spark, store)
    if rows is None:
        return
    # a row a bucket that has repeats comes back: no more than there are buckets
    twice = rows.groupBy("bucket", store.key).count().where("count > 1").select("bucket").distinct()
    if not (found := [r.bucket for r in twice.collect()]):
        return
    few = _latest(rows.where(F.col("bucket").isin(found)), store).select(*rows.columns)
    dealt = few.repartition("bucket").sortWithinPartitions("bucket", store.key)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
    name = f"parquet.bloom.filter.enabled#{store.key}"
    writer.option(name, "true").option(f"parquet.bloom.filter.expected.ndv#{store.key}", str(store.ids_per_bucket)).parquet(f"{store.path}/rows")


def held(spark: SparkSession, store: Store, ids: list[str] | DataFrame) -> DataFrame | None:
    """The latest rows of some ids: a list, or a table's column of the key's name; null for a store without rows.

    Up to LITERAL_IDS ids of a list prune buckets and row groups in the plan. A table's ids are joined, by broadcast if they are
    small; which buckets they have is asked before, so that only these are read.
    """
    rows = _rows(spark, store)
    if rows is None:
        return None
    if isinstance(ids, list) and len(ids) > LITERAL_IDS:
        ids = spark.createDataFrame([(i,) for i in ids], f"{store.key} string")
    if isinstance(ids, list):
        known = [F.lit(i) for i in dict.fromkeys(ids) if i is not None]
        near = F.col("bucket").isin(*[_bucket(store, i) for i in known]) if known else F.lit(False)
        return _latest(rows.where(near & F.col(store.key).isin(*known)), store).drop(*_OWN)
    asked = ids.select(store.key).where(F.col(store.key).isNotNull()).distinct().withColumn("bucket", _bucket(store, F.col(store.key)))
    n, buckets = asked.agg(F.count("*"), F.collect_set("bucket")).first()
    small = n * ID_ROW_BYTES <= BROADCAST_BYTES
    rows = rows.where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    return _latest(rows.join(F.broadcast(asked) if small else asked, ["bucket", store.key], "left_semi"), store).drop(*_OWN)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _of(spark: SparkSession, store: Store, asked: DataFrame, columns: list[str]) -> DataFrame:
    """Asked rows beside what the store holds of their ids; `_found` tells whether it holds any."""
    found = held(spark, store, asked)
    if found is None:
        return asked.withColumns({"_found": F.lit(False), **{c: F.lit(None).cast("string") for c in columns}})
    return asked.join(found.select(store.key, F.lit(True).alias("_found"), *columns), store.key, "left").withColumn("_found", F.coalesce("_found", F.lit(False)))


def lookup(spark: SparkSession, store: Store, asked: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, code, payload, message) for each asked row: 200 with what is stored, 404 for an id that isn't there."""
    rows = _of(spark, store, asked.select(store.key), [payload])
    absent = F.concat(F.lit(f"No result for {store.key}="), _quoted(F.coalesce(store.key, F.lit(""))))
    return rows.select(store.key, F.when(F.col("_found"), 200).otherwise(404).alias("code"), F.col(payload).alias("payload"), F.when(~F.col("_found"), absent).alias("message"))


def download(spark: SparkSession, store: Store, asked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(key, format, code, path, message) for each asked (key, format): 200 with a file's path, 400 for a format that there isn't,
    404 for an id or file that isn't there. Formats may be in any case.

    files: the paths that exist, as column path; without it stored paths are taken for existing ones.
    """
    rows = _of(spark, store, asked.select(store.key, F.lower("format").alias("format")), [f"{f}_path" for f in FORMATS])
    path = F.coalesce(*[F.when(F.col("format") == f, F.nullif(F.col(f"{f}_path"), F.lit(""))) for f in FORMATS])
    rows = rows.withColumn("path", path)
    if files is None:
        rows = rows.withColumn("_there", F.lit(True))
    else:
        there = files.select("path").distinct().withColumn("_there", F.lit(True))
        rows = rows.join(there, "path", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    known = F.coalesce(F.col("format").isin(*FORMATS), F.lit(False))
    said = F.coalesce("format", F.lit(""))
    code = F.when(~F.col("_found"), 404).when(~known, 400).when(F.col("path").isNull() | ~F.col("_there"), 404).otherwise(200)
    message = (
        F.when(~F.col("_found"), F.concat(F.lit(f"No result for {store.key}="), _quoted(F.coalesce(store.key, F.lit("")))))
        .when(~known, F.concat(F.lit("Unknown format "), _quoted(said), F.lit(f". Supported: {', '.join(FORMATS)}")))
        .when(F.col("path").isNull(), F.concat(F.lit("File not found for format="), _quoted(said)))
        .when(~F.col("_there"), F.concat(F.lit("File not found: "), "path"))
    )
    return rows.select(store.key, "format", code.alias("code"), F.when(code == 200, F.col("path")).alias("path"), message.alias("message"))
