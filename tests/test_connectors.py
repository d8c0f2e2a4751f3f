import datetime
import json

from pyspark.sql import functions as F

from adaptlm.functions.codecs import EVENT_KINDS, decode_kinds, encode_kinds
from adaptlm.operators import em
from adaptlm.sources.connectors import DocumentProducer, ResultSource
from adaptlm.streaming.streams import StreamRegistry, to_table


def test_result_source_asks_for_aligned_pages(spark):
    class Numbers(ResultSource):
        page_size = 5

        @classmethod
        def name(cls):
            return "numbers"

        def results(self, query, start, count):
            assert (start - 1) % 5 == 0 and count == 5
            for pos in range(start, min(start + count, 14)):
                yield pos, f"{query} {pos}", f"http://{query}/{pos}", None

    spark.dataSource.register(Numbers)
    read = lambda queries, **o: spark.read.format("numbers").options(queries=json.dumps(queries), **o).load()
    got = read(["a", "", "b"], start=4, count=20).orderBy("search_id", "pos").collect()
    assert [(r.search_id, r.pos) for r in got] == [(i, p) for i in (0, 2) for p in range(4, 14)]
    assert got[0].title == "a 4" and got[0].url == "http://a/4" and got[0].summary is None
    assert read([]).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        chosen = lambda where, queries=("a", "b", "c"): (df := read(list(queries), start=1, count=30, pushdown=True).where(where), [(r.search_id, r.pos) for r in df.orderBy("search_id", "pos").collect()])
        df, rows = chosen("search_id = 1 AND pos > 5 AND pos <= 9 AND title LIKE 'b%'")
        assert rows == [(1, p) for p in range(6, 10)] and df.rdd.getNumPartitions() == 1  # one page of one query
        df, rows = chosen("search_id IN (0, 2) AND pos = 11")
        assert rows == [(0, 11), (2, 11)] and df.rdd.getNumPartitions() == 2
        assert chosen("pos < 1")[1] == [] and chosen("search_id = 9")[1] == [] and len(chosen("pos >= 3")[1]) == 33
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_producer_streams_every_document_once(spark, tmp_path):
    folder = tmp_path / "made"
    folder.mkdir()
    day = datetime.datetime(2024, 1, 1)

    class Files(DocumentProducer):
        @classmethod
        def name(cls):
            return "made_files"

        def produced(self):
            import os

            return len(os.listdir(self.options["path"]))

        def documents(self, first, end):
            for k in range(first, end):
                with open(f"{self.options['path']}/{k}") as f:
                    yield f"d{k}", f.read(), None, f"http://x/{k}", day

    registry = StreamRegistry()
    registry.produce(spark, "made", Files, path=folder, stretch=3)
    assert registry.names() == ["made"]
    stream = lambda: registry.get("made")
    for made in (7, 7, 12):
        for k in range(made):
            (folder / str(k)).write_text(f"text {k}")
        to_table(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("number").collect()
    assert [(r.number, r.doc_id, r.title) for r in rows] == [(k, f"d{k}", f"text {k}") for k in range(12)]
    assert spark.read.format("made_files").option("path", str(folder)).load().count() == 12


def test_event_kinds_of_ones_own(spark):
    kinds = EVENT_KINDS | {"save": (("folder", "string"), ("pos", "int"))}
    rows = spark.createDataFrame([("click", 3, "u", None), ("save", 4, None, "f"), ("other", 5, "x", "y"), ("save", None, None, None)], "kind string, pos int, url string, folder string")
    parts = {f: F.col(f) if f in rows.columns else F.lit(None) for fields in kinds.values() for f, _ in fields}
    coded = rows.select("kind", encode_kinds(F.col("kind"), parts, kinds).alias("value"))
    assert [r.value for r in coded.collect()] == ["3\tu", "f\t4", None, ""]
    got = [r.d for r in coded.select(decode_kinds(F.col("kind"), F.col("value"), kinds).alias("d")).collect()]
    assert (got[0].pos, got[0].url, got[0].folder) == (3, "u", None)
    assert (got[1].pos, got[1].url, got[1].folder) == (4, None, "f")
    assert set(got[2]) == {None}


def _climb(target, comps, priors, w, most=20):
    """Plain EM from weights w."""
    import math

    last = None
    for k in range(most):
        mix = [sum(a * c[i] for a, c in zip(w, comps)) for i in range(len(target))]
        g = [p + sum(t * a * c[i] / m for i, (t, m) in enumerate(zip(target, mix)) if m > 0) for p, a, c in zip(priors, w, comps)]
        w = [x / sum(g) for x in g]
        like = sum(t * math.log(m) for t, i in zip(target, range(len(target))) if (m := sum(a * c[i] for a, c in zip(w, comps))) > 0)
        if k and abs(like - last) < abs(like + last) * 1e-6:
            break
        last = like
    return w, like


def test_em_restarts_keep_the_likeliest(spark):
    target, comps, priors = [5.0, 2.0, 1.0], [[0.7, 0.2, 0.1], [0.1, 0.1, 0.8], [0.3, 0.4, 0.3]], [0.1, 0.0, 0.9]
    rows = spark.createDataFrame([(1, target, comps, priors)], "k int, target array<double>, components array<array<double>>, priors array<double>")
    one = em.mixing_weights(rows, "k").first()
    w, like = _climb(target, comps, priors, [1 / 3] * 3)
    assert abs(one.likelihood - like) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(one.weights, w))
    starts = rows.select(*(em._drawn(F.col("components"), 7, k) for k in range(4))).first()
    ends = [_climb(target, comps, priors, s) for s in starts]
    assert all(abs(sum(s) - 1) < 1e-12 for s in starts) and len({tuple(s) for s in starts}) == 4
    many = em.mixing_weights(rows, "k", tries=4, seed=7).first()
    w, like = max(ends, key=lambda x: x[1])
    assert abs(many.likelihood - like) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(many.weights, w))
