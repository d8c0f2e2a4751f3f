from pyspark.sql import functions as F

from adaptlm.operators.events import session_windows
from adaptlm.sources.tables import append, replace_partition
from adaptlm.streaming.streams import StreamRegistry, file_stream, run_batches, sessions, to_table, unique_documents


def test_stream_dedup_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    append(docs, str(tmp_path / "in"))
    append(docs.limit(20), str(tmp_path / "in"))
    stream = unique_documents(file_stream(spark, str(tmp_path / "in"), docs.schema))
    to_table(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.select("doc_id").distinct().count()
    seen = []
    run_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == 80
    r = StreamRegistry()
    r.add("docs", stream)
    assert r.get("docs") is stream and r.get("none") is None


def test_stream_sessions_are_batch_sessions(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    append(e, str(tmp_path / "in"))
    late = e.limit(1).withColumn("ts", F.expr("timestamp '2025-01-01'")).withColumn("user_id", F.lit(-1).cast("long"))
    query = to_table(sessions(file_stream(spark, str(tmp_path / "in"), e.schema), "user_id", "ts"), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    append(late, str(tmp_path / "in"))  # moves the watermark past all sessions
    to_table(sessions(file_stream(spark, str(tmp_path / "in"), e.schema), "user_id", "ts"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    append(late.withColumn("ts", F.expr("timestamp '2025-03-01'")), str(tmp_path / "in"))
    to_table(sessions(file_stream(spark, str(tmp_path / "in"), e.schema), "user_id", "ts"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("user_id >= 0")
    want = session_windows(e, "user_id", "ts")
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_replace_partition_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, x string"), path, "user_id")
    replace_partition(spark.createDataFrame([(1, "c")], "user_id int, x string"), path, "user_id")
    assert sorted((r.user_id, r.x) for r in spark.read.parquet(path).collect()) == [(1, "c"), (2, "b")]
