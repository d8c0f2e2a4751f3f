"""WARC archives: writing, the monolithic gzip normaliser, and reading by offset.

Archives are written by Spark's text writer: a record without its closing blank
lines is a row, the blank lines are the line separator, and gzip compression makes
each file one gzip stream. The normaliser inflates such a stream once, from its
start to its end, and rewrites every record as a gzip member of its own; a
sidecar index with the members' offsets is a table. Readers seek to a member.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adaptlm.llm.shared import drop_path, keyed, new_path, scratch, written

END = "\r\n\r\n"
BLOCK = 1 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"


def with_digests(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, payload_digest, key: the page that stands for its payload, and whether this is it.

    Among equal payloads of min_bytes or more the smallest page_id (null last, then
    the earliest row) is the response; the others revisit it.
    """
    rows = keyed(pages, "page_id", "url", "html").select("rid", F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # digests are compared without payloads: a payload that very many pages have stays where its pages are
    narrow = rows.where(F.col("payload_bytes") >= min_bytes).select("rid", "page_id", "payload_digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("rid"))
    first = narrow.groupBy(F.col("payload_digest").alias("f_digest")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("f_digest", F.col("first.page_id").alias("first_page"), F.col("first.rid").alias("first_rid"))
    again = narrow.join(first, F.col("payload_digest") == F.col("f_digest")).where("rid <> first_rid").select(F.col("rid").alias("again"), "first_page", "first_rid")
    return rows.join(written(again, "revisits"), F.col("rid") == F.col("again"), "left").withColumn("revisit", F.col("again").isNotNull())


def _uri(page: str, rid: str) -> Column:
    """The record id of a page's row."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(":"), F.hex(F.col(rid)["f"]), F.lit("-"), F.col(rid)["r"].cast("string"))


def record() -> Column:
    """A WARC/1.1 record up to its closing blank lines, as binary."""
    # header values hold no line breaks; the url is kept as such elsewhere
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "")
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), _uri("page_id", "rid"),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), _uri("first_page", "first_rid"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.length(body).cast("string"), F.lit(END),
    )
    return F.concat(head.cast("binary"), body)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100) -> None:
    """Archives of pages (page_id, url, html) under path, one gzip stream each. Null html is an empty payload; repeated rows are records each."""
    rows = with_digests(pages, min_bytes).select(record().cast("string").alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", END).text(path)


def open_path(uri: str):
    """The file system and path of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^file:/*", "file:///", uri))


def inflated(stream) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members, in blocks."""
    z = zlib.decompressobj(31)
    while data := stream.read(BLOCK):
        while data:
            yield z.decompress(data, 4 * BLOCK)
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


def records(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, int, Iterator[bytes]]]:
    """Head, length of the body and blocks of the body of each record; a body must be read before the next record."""
    held = bytearray()
    blocks = iter(blocks)

    def more() -> bool:
        for b in blocks:
            if b:
                held.extend(b)
                return True
        return False

    def body(n: int) -> Iterator[bytes]:
        while n:
            if not held and not more():
                raise ValueError("archive ends inside a record")
            out = bytes(held[:n])
            del held[: len(out)]
            n -= len(out)
            yield out

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends inside a head")
                return
        head = bytes(held[: at + 4])
        del held[: at + 4]
        size = re.search(rb"\r\nContent-Length: *(\d+)", head)
        if not size:
            raise ValueError("record without a Content-Length")
        n = int(size[1])
        rest = body(n)
        yield head, n, rest
        for _ in rest:
            pass
        while len(held) < 4 and more():
            pass
        if bytes(held[:4]) != b"\r\n\r\n":
            raise ValueError("record without its closing lines")
        del held[:4]


def field(head: bytes, name: str) -> str | None:
    """The value of a head's field."""
    m = re.search(rb"\r\n" + name.encode() + rb": *([^\r]*)\r", head)
    return m[1].decode(errors="replace") if m else None


def normalise_file(source: str, target: str) -> Iterator[tuple[int, int, str, str]]:
    """Rewrite one archive with a member for each record; gives (offset, length, record id, type). The file appears under its name when whole."""
    (fs_in, path_in), (fs_out, path_out) = open_path(source), open_path(target)
    fs_out.create_dir(path_out.rpartition("/")[0], recursive=True)
    part, at = f"{path_out}.{uuid.uuid4().hex}.part", 0
    with fs_in.open_input_stream(path_in, compression=None) as stream, fs_out.open_output_stream(part, compression=None) as out:
        for head, _, body in records(inflated(stream)):
            z, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
            for piece in itertools.chain([head], body, [b"\r\n\r\n", None]):
                data = z.flush() if piece is None else z.compress(piece)
                out.write(data)
                size += len(data)
            yield at, size, field(head, "WARC-Record-ID"), field(head, "WARC-Type")
            at += size
    fs_out.move(part, path_out)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Every archive (*.gz) in the folder source and its sub-folders with a member for each record, under target; returns the index (see INDEX), also written beside it.

    An archive keeps its place and name below the folder, as <name>.warc.gz; two that would get one name are an error.
    A file is one task, as its stream cannot be split; memory is bounded by a block
    and a head. A rerun task writes its file anew and puts it in place when whole.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(source)
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source).select("path")
    name = F.regexp_replace(F.substr(F.col("path"), F.lit(len(base) + 1)), r"(\.warc)?\.gz$", "")
    paths = written(files.select("path", F.concat(F.lit(target.rstrip("/") + "/"), name, F.lit(".warc.gz")).alias("out")), "archives")
    clash = paths.groupBy("out").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if clash:
        raise ValueError(f"{clash.n} archives would get one name, {clash.out}")
    paths = paths.repartition(max(1, spark.sparkContext.defaultParallelism), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = []
                for row in normalise_file(path, out):
                    held.append((out, *row))
                    if len(held) == 10_000:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "offset", "length", "record_id", "record_type"])

    index = f"{target}/index"
    paths.mapInArrow(run, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that an index points to: record_id, record_type, refers_to, payload_bytes, payload_digest (of the full payload), and payload, if payloads.

    A response's payload is digested again and must agree with its head; a revisit has none, and states the digest and size of the response that it refers to.
    """
    schema = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    columns = len(schema.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                out = []
                for archive, offset, length in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if archive not in files:
                        for f in files.values():
                            f.close()
                        fs, path = open_path(archive)
                        files = {archive: fs.open_input_file(path)}
                    f = files[archive]
                    f.seek(offset)
                    for head, _, body in records([zlib.decompress(f.read(length), 31)]):
                        data, digest, size = b"".join(body), field(head, "WARC-Payload-Digest").removeprefix("sha256:"), int(field(head, "X-Payload-Length"))
                        kind = field(head, "WARC-Type")
                        if kind == "response" and (hashlib.sha256(data).hexdigest(), len(data)) != (digest, size):
                            raise ValueError(f"payload of {field(head, 'WARC-Record-ID')} is damaged")
                        out.append((field(head, "WARC-Record-ID"), kind, field(head, "WARC-Refers-To"), size, digest, data)[:columns])
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][:columns]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return index.select("archive", "offset", "length").mapInArrow(run, schema)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of write_archives()."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write pages as archives, normalise them and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to. An empty table gives no rows."""
    spark = pages.sparkSession
    whole, split = new_path(spark, "warc-monolithic"), new_path(spark, "warc")
    with scratch(spark):
        write_archives(pages, whole, min_bytes)
        index = normalise(spark, whole, split)
    drop_path(spark, whole)
    back = read_records(index, payloads=False)
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
