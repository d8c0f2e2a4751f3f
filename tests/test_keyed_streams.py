"""Streams with state by key against the batch operators."""

import random
import time

from pyspark.sql import functions as F

from adaptlm.operators import sessions
from adaptlm.streaming import keyed
from adaptlm.streaming.streams import file_stream

SCHEMA = "user_id long, search_id long, ts long, terms map<string,double>"


def test_sessions_of_shuffled_arrivals_are_those_of_the_batch(spark, tmp_path):
    keyed.rocksdb(spark)
    r = random.Random(5)
    rows = [(u, 100 * u + i, r.randint(0, 9000), {t: float(r.randint(1, 3)) for t in r.sample("abcdefgh", 3)}) for u in range(3) for i in range(25)]
    ends = [(0, None, 4000, None)]
    r.shuffle(rows)
    batches = [ends + rows[:25], rows[25:50] + rows[:5], rows[50:]]
    (tmp_path / "in").mkdir()
    stream = file_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema)
    log = keyed.session_log(stream, 1800, 0.6, "3 hours")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        log.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {x.search_id: x.session_id for x in keyed.sessions_of(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    s = spark.createDataFrame(rows, SCHEMA).withColumn("ended", F.when(F.col("user_id") == 0, 4000))
    near = sessions.near_pairs(s, "ts", 1800, "ended")
    alike = sessions.pair_cosines(near, s.select("search_id", F.explode("terms").alias("term", "weight"))).where("cosine >= 0.6 - 1e-12")
    want = sessions.min_labels(s.select(F.col("search_id").cast("string").alias("node")), alike.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    assert got == {int(x.node): x.root for x in want.collect()} and 5 < len(set(got.values())) < 75


def test_rows_wait_for_a_pause(spark, tmp_path):
    keyed.rocksdb(spark)
    schema = "user string, n long"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    put(("a", 1), ("b", 1))
    out = keyed.flushed_when_idle(file_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema), "user", 4000)
    query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for n in (2, 3):
            time.sleep(1.5)
            put(("a", n))
        until = time.time() + 60
        while time.time() < until:
            time.sleep(1)
            try:
                found = spark.read.parquet(f"file://{tmp_path}/out").collect()
            except Exception:  # no file yet
                continue
            if len(found) == 4:
                break
    finally:
        query.stop()
    assert sorted((r.user, r.n, r.held) for r in found) == [("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("b", 1, 1)] and sorted(r.place for r in found if r.user == "a") == [0, 1, 2]
