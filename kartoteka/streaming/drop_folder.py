"""A folder into which documents are dropped, as a stream: the same plan, micro-batch by micro-batch, and counters of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kartoteka.plans.details import counters, with_details
from kartoteka.schema import Settings
from kartoteka.sources import files, store

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, settings: Settings = Settings(), per_batch: int = 1000, within: str | None = None) -> DataFrame:
    """Files with the settings' extensions as they arrive, described; others are not read.

    within: a file whose content came before, in files whose times of change are no further apart than this, is not a row again.
    Its state is a hash for each file of that time; contents are dealt by their hash, so a batch of copies meets in one state
    store and no content is kept.
    """
    stream = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", files.glob(settings.extensions)).load(folder)
    described = files.described(stream.withWatermark("modificationTime", within) if within else stream, "modificationTime")
    return described.dropDuplicatesWithinWatermark(["sha256"]).drop("modificationTime") if within else described.drop("modificationTime")


def watched(spark: SparkSession, folder: str, settings: Settings = Settings(), per_batch: int = 1000, within: str | None = None, **backends) -> DataFrame:
    """Results of arrivals; backends are those of `files.with_text`."""
    return with_details(files.with_text(arrivals(spark, folder, settings, per_batch, within), settings, **backends), settings)


def started(results: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes results as Parquet; the checkpoint makes each file count once, whatever is lost."""
    writer = results.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counted(results: DataFrame, counts: store.Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps documents by status, as a running state, in a store whose key is `status`.

    A batch gives the statuses that changed, and they are upserted as the generation of the batch's number: a batch that is run
    again after a failure writes the same counts, and a restart goes on from the state in the checkpoint.
    """

    def upserted(batch: DataFrame, number: int) -> None:
        store.upsert(counts, batch, number)

    writer = counters(results).writeStream.outputMode("update").foreachBatch(upserted).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def totals(spark: SparkSession, counts: store.Store) -> DataFrame:
    """The counts as they stand: (status, n), all three statuses."""
    known = spark.createDataFrame([(s,) for s in ("done", "needs_review", "failed")], "status string")
    found = store.results(spark, counts)
    if found is None:
        return known.withColumn("n", F.lit(0).cast("long"))
    return known.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
