"""The corpus pipeline: stages that take documents and return what they keep of them, each written before the next.

Toxic documents go, then those without a language; one document of each group of near duplicates stays, words that an earlier
document has in the same order go, and what is left is packed into sequences. All but the last stage return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.llm import _common as C
from kartoteka.llm import langid, neardup, packing, substrings, toxicity

#: A document whose language is less probable than this among the known ones is rejected.
LEAST_LANGUAGE = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 by the model of op8; null and empty texts have no toxic term and stay."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    mark = C.free_name("toxicity", docs.columns)
    return toxicity.score(docs, machine, to=mark).where(F.col(mark) < 0.5).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a probability of LEAST_LANGUAGE or more; those without a letter go.

    Null and empty texts have no letter. Repeated rows are judged alike; an empty table gives an empty one; long texts are read whole.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    lang, score = C.free_name("said", docs.columns), C.free_name("probability", docs.columns)
    said = langid.predict(docs, model, lang=lang, score=score)
    return said.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of five-word-shingle near duplicates.

    Rows of one id are one document, of which one row stays. Rows without an id can't be named, and stay. What goes is
    decided on ids; the ids are broadcast if they are small in bytes, else the texts are shuffled by id once.
    """
    found = C.written(neardup.near_duplicates(docs, k=5).where("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "near")
    gone = found.where("not kept").select("doc_id")
    again = found.where("kept").select("doc_id")
    small = gone.count() * neardup.ID_ROW_BYTES <= C.BROADCAST_BYTES
    known = docs.where("doc_id is not null").join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)
    if not again.isEmpty():
        known = known.dropDuplicates(["doc_id"])
    return known.unionByName(docs.where("doc_id is null"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 13-word windows that a document with a smaller id has.

    Null and empty texts stay as they are, and so do repeated rows of one id, as no id is smaller than itself; an empty table gives
    an empty one; long texts are read whole.
    """
    return substrings.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no piece; a long text is cut.
    """
    return packing.packed_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned models nor the local search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is a Parquet table in the shared folder that the next one reads.

    These tables go when the application ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{C.shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        C.remove_at_end(spark, path)
        docs = spark.read.parquet(path)
    return docs
