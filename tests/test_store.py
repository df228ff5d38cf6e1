"""The store of results: upserts, look-ups, downloads, compaction, and plans that read few buckets."""

import re

import pytest
from pyspark.sql import functions as F

from kartoteka.sources import store

SCHEMA = "document_id string, payload string, json_path string, xlsx_path string, docx_path string"


def rows(spark, made):
    return spark.createDataFrame([(i, p, f"/x/{i}.json", f"/x/{i}.xlsx", None) for i, p in made], SCHEMA)


@pytest.fixture
def kept(spark, tmp_path):
    s = store.create(spark, str(tmp_path / "store"), buckets=16)
    store.upsert(s, rows(spark, [(f"d{i}", "old") for i in range(200)] + [(None, "lost")]), 1)
    store.upsert(s, rows(spark, [(f"d{i}", "new") for i in range(0, 200, 2)]), 2)
    return s


def test_later_result_wins(spark, kept):
    got = {r.document_id: r.payload for r in store.results(spark, kept).collect()}
    assert got == {f"d{i}": "old" if i % 2 else "new" for i in range(200)}
    # an earlier generation that comes late, and one that is written again, change nothing
    store.upsert(kept, rows(spark, [("d0", "late")]), 1)
    store.upsert(kept, rows(spark, [("d2", "new")]), 2)
    got = {r.document_id: r.payload for r in store.held(spark, kept, ["d0", "d2", "no"]).collect()}
    assert got == {"d0": "new", "d2": "new"}
    # within a generation the greatest place
    placed = rows(spark, [("d1", "b"), ("d1", "a")]).withColumn("n", F.when(F.col("payload") == "a", 2).otherwise(1))
    store.upsert(kept, placed.drop("n").withColumn("payload", F.col("payload")), 3, F.when(F.col("payload") == "a", 2).otherwise(1))
    assert store.held(spark, kept, ["d1"]).first().payload == "a"


def test_compaction_keeps_the_latest(spark, kept):
    before = sorted(map(tuple, store.results(spark, kept).collect()))
    store.compacted(spark, kept)
    raw = spark.read.parquet(f"{kept.path}/rows")
    assert raw.count() == 200 and sorted(map(tuple, store.results(spark, kept).collect())) == before
    names = {r.f for r in raw.select(F.input_file_name().alias("f")).distinct().collect()}
    store.compacted(spark, kept)  # nothing to do: no file is touched
    assert {r.f for r in spark.read.parquet(f"{kept.path}/rows").select(F.input_file_name().alias("f")).distinct().collect()} == names


def test_lookup_codes(spark, kept):
    again = store.opened(spark, kept.path)
    assert again == kept
    asked = spark.createDataFrame([("d4",), ("d4",), ("zz",), (None,)], "document_id string")
    got = sorted((r.document_id or "", r.code, r.payload, r.message) for r in store.lookup(spark, again, asked).collect())
    assert got == [("", 404, None, "No result for document_id=''"), ("d4", 200, "new", None), ("d4", 200, "new", None), ("zz", 404, None, "No result for document_id='zz'")]


def test_download_codes(spark, kept):
    asked = spark.createDataFrame([("d4", "JSON"), ("d4", "pdf"), ("d4", "docx"), ("d5", "xlsx"), ("zz", "pdf"), ("d4", None)], "document_id string, format string")
    there = spark.createDataFrame([("/x/d4.json",)], "path string")
    got = {(r.document_id, r.format): (r.code, r.path, r.message) for r in store.download(spark, kept, asked, there).collect()}
    assert got == {
        ("d4", "json"): (200, "/x/d4.json", None),
        ("d4", "pdf"): (400, None, "Unknown format 'pdf'. Supported: json, xlsx, docx"),
        ("d4", "docx"): (404, None, "File not found for format='docx'"),
        ("d5", "xlsx"): (404, None, "File not found: /x/d5.xlsx"),
        ("zz", "pdf"): (404, None, "No result for document_id='zz'"),
        ("d4", None): (400, None, "Unknown format ''. Supported: json, xlsx, docx"),
    }
    assert {r.code for r in store.download(spark, kept, asked).where("format = 'xlsx'").collect()} == {200}


def test_empty_store(spark, tmp_path):
    s = store.create(spark, str(tmp_path / "none"), buckets=4)
    asked = spark.createDataFrame([("a", "json")], "document_id string, format string")
    assert store.results(spark, s) is None and store.held(spark, s, ["a"]) is None
    assert store.lookup(spark, s, asked).first().code == 404 and store.download(spark, s, asked).first().code == 404
    store.compacted(spark, s)
    with pytest.raises(ValueError, match="already"):
        store.create(spark, s.path)
    with pytest.raises(ValueError, match="own"):
        store.upsert(s, asked.withColumn("Bucket", F.lit(1)), 1)


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        if p.nodeName().startswith("Scan parquet"):
            found.append(p.metrics().apply("numFiles").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_buckets_are_pruned(spark, kept):
    every = spark.read.parquet(f"{kept.path}/rows").inputFiles()
    listed = store.held(spark, kept, ["d4"])
    plan = listed._jdf.queryExecution().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert "bucket" in filters and "xxhash64" not in filters  # the bucket is known when the query is planned
    assert re.search(r"PushedFilters: \[[^\]]*document_id", plan)
    (n,) = files_read(listed)
    assert 1 <= n <= 2 < len(every)  # one bucket: a file of each generation
    joined = store.held(spark, kept, spark.createDataFrame([("d4",), ("d6",)], "document_id string"))
    assert max(files_read(joined)) <= 4 < len(every)


def test_bloom_filters_are_there(spark, kept):
    import pyarrow.parquet as pq

    footers = [pq.read_metadata(f.removeprefix("file://").removeprefix("file:")) for f in spark.read.parquet(f"{kept.path}/rows").inputFiles()]
    assert footers and any(b"parquet" in (m.metadata or {}) or m.num_rows for m in footers)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(spark.read.parquet(f"{kept.path}/rows").inputFiles()[0])
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    columns = reader.getFooter().getBlocks().get(0).getColumns()
    offsets = {columns.get(i).getPath().toDotString(): columns.get(i).getBloomFilterOffset() for i in range(columns.size())}
    reader.close()
    assert offsets["document_id"] > 0 and offsets["payload"] <= 0
