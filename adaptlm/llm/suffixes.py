"""Suffix-array dedup: removes bytes covered by strings that start more than once in the corpus.

1. Anchors. Each window of `length` bytes is named after the least hash of its 32-byte
   grams; equal windows share it wherever they stand. Runs of windows with one
   name form a context (the bytes they cover). Windows whose name no other context has
   cannot repeat, and go before anything else is shuffled. Equal contexts are counted before they are shuffled, so that
   thousands of copies are one row; what such a context covers repeats.
2. Suffix arrays. The different contexts of a name are brought together and their
   suffixes sorted by the difference-cover method: sampled triples get names, which
   are sorted again as a string while they are ambiguous and short of `length`,
   the other suffixes are merged in, and neighbours' prefixes are compared.
   Names with more contexts than one task should take are made longer: a context is cut to
   pieces of windows that hold the gram at near places, all of which cover the same bytes
   around it; those bytes are the piece's new name. Equal pieces are counted, the others sorted
   as above, and what is still crowded is cut finer, at last to single windows.
3. Repeating windows go back to every document that holds the context.

The array is thus the corpus's, in parts that need not see each other: windows with
different names differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import keyed, release, scratch, slices, tidy, written
from adaptlm.llm.words import mixed, text_bytes

GRAM = 32
#: Symbols in one suffix array; three ranks of this size fit a 64-bit key.
SYMBOLS = 1 << 20
#: Contexts of one name in one suffix array; names with more are made longer, in CUT parts of the gram's places.
MOST_CONTEXTS, CUT = 200, 4
KEY = "struct<f:long,r:long>"
_ODD = mixed(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(4711))


# --- difference cover ---


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of integer keys, and their number."""
    order = np.argsort(keys)
    s = keys[order]
    r = np.empty(len(keys), np.int64)
    dense = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]]))
    r[order] = dense
    return r, int(dense[-1])


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of text (integers above 0), by at least its first depth symbols; equal ranks only if these agree."""
    n = len(text)
    if n < 8:
        pad = np.concatenate([text, np.zeros(n, text.dtype)])
        rows = [tuple(pad[i : i + n]) for i in range(n)]
        place = {x: i for i, x in enumerate(sorted(set(rows)), 1)}
        return np.array([place[x] for x in rows], np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(6, np.int64)])
    bits = int(t.max()).bit_length()
    # sampled suffixes: at 1 and 2 modulo 3, named by their triples
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)
    at = np.concatenate([one, two])
    names, many = _ranks((t[at] << (2 * bits)) | (t[at + 1] << bits) | t[at + 2])
    if many < len(at) and depth > 3:
        # the names of both residues, one string after the other with an end mark between, three symbols each
        string = np.concatenate([names[: len(one)], [0], names[len(one) :]]) + 1
        deep = suffix_ranks(string, -(-depth // 3))
        names = _ranks(np.concatenate([deep[: len(one)], deep[len(one) + 1 :]]))[0]
    rank = np.zeros(n + 6, np.int64)
    rank[at] = names
    rank[n:] = np.where(np.arange(n, n + 6) == n, rank[n : n + 6], 0)
    # the others by their first symbol and the rank that follows
    rest = np.arange(0, n, 3)
    wide = int(rank.max()).bit_length()
    by_one = (t[rest] << wide) | rank[rest + 1]
    by_two = (((t[rest] << bits) | t[rest + 1]) << wide) | rank[rest + 2]
    one, two = one[one < n], two[two < n]
    ones, twos = (t[one] << wide) | rank[one + 1], (((t[two] << bits) | t[two + 1]) << wide) | rank[two + 2]
    # merge: what each kind counts of the other; equal keys agree to the depth
    less = np.concatenate([[0], np.cumsum(np.bincount(rank[np.concatenate([one, two])]))])
    o_ones, o_twos, o_by_one, o_by_two = (np.argsort(k) for k in (ones, twos, by_one, by_two))
    s_ones, s_twos, s_by_one, s_by_two = ones[o_ones], twos[o_twos], by_one[o_by_one], by_two[o_by_two]
    out = np.empty(n, np.int64)
    # questions go in their own order, which keeps the searches near each other
    out[rest[o_by_one]] = np.searchsorted(s_by_one, s_by_one) + np.searchsorted(s_ones, s_by_one)
    out[rest[o_by_two]] += np.searchsorted(s_twos, s_by_two)
    out[one[o_ones]] = less[rank[one[o_ones]]] + np.searchsorted(s_by_one, s_ones)
    out[two[o_twos]] = less[rank[two[o_twos]]] + np.searchsorted(s_by_two, s_twos)
    return out + 1


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its starts have a string of this length that starts elsewhere too, in any of them."""
    sizes = [len(x) for x in texts]
    begin = np.cumsum([0, *(s + 1 for s in sizes)])
    text = np.zeros(begin[-1], np.uint8)
    symbols = np.ones(begin[-1], np.int64)  # 1 ends a text
    for b, x in zip(begin, texts):
        text[b : b + len(x)] = np.frombuffer(x, np.uint8)
        symbols[b : b + len(x)] = text[b : b + len(x)].astype(np.int64) + 2
    rank = suffix_ranks(symbols, length)
    starts = np.concatenate([np.arange(b, b + max(0, s - length + 1)) for b, s in zip(begin, sizes)])
    order = starts[np.argsort(rank[starts])]
    padded = np.concatenate([text, np.zeros(length, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, length)
    same = np.ones(max(0, len(order) - 1), bool)
    for a, b in ((0, 16), (16, length)):  # most neighbours part early
        some = np.flatnonzero(same)
        for part in np.array_split(some, max(1, len(some) // 20_000)):
            same[part] = (rows[order[part], a:b] == rows[order[part + 1], a:b]).all(1)
    hit = np.zeros(len(text), bool)
    hit[order[:-1][same]] = hit[order[1:][same]] = True
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin, sizes)]


# --- anchors ---


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on."""
    h = _BYTES[data]
    for k in range(5):
        m = 1 << k
        h = h[:-m] * _ODD[k] + h[m:]
    return mixed(h)


def contexts_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """name, first window, number of windows, and whether the name's gram may occur twice, for each run of windows of a text."""
    h = gram_hashes(data)
    least, width, step = h, length - GRAM + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(lo, append=len(least))
    if n.max() > width:  # long runs of one gram are cut to even parts
        parts = -(-n // width)
        base = np.repeat(lo, parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.minimum(base + (k + 1) * width, np.repeat(lo + n, parts))
        lo, n = base + k * width, end - base - k * width
    name = least[lo]
    small = np.sort(h[h <= name.max()])
    twice = small[1:][small[1:] == small[:-1]]
    return name, lo, n, np.isin(name, twice) if len(twice) else np.zeros(len(name), bool)


def members(rows: DataFrame, length: int) -> DataFrame:
    """name, c1, c2 (128-bit hash of the context's bytes), rid, lo, n, twice for every context of rows rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = text_bytes(part.column(1))
                view = memoryview(data)
                found, digests, places = [], [], []
                for k, a, b in zip(range(part.num_rows), offsets[:-1], offsets[1:]):
                    if b - a >= length:
                        c = contexts_of(data[a:b], length)
                        found.append(c)
                        places.append(np.full(len(c[0]), k))
                        first, last = (c[1] + a).tolist(), (c[1] + c[2] + (a + length - 1)).tolist()
                        digests.extend([hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(first, last)])
                if found:
                    name, lo, n, twice = (np.concatenate(x) for x in zip(*found))
                    c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    rids = part.column(0).take(pa.array(np.concatenate(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1])), rids, pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["name", "c1", "c2", "rid", "lo", "n", "twice"])
        tidy()

    return rows.select("rid", "text").mapInArrow(run, f"name long, c1 long, c2 long, rid {KEY}, lo int, n int, twice boolean")


def _ranges(hits: np.ndarray) -> list[int]:
    """Sorted starts as flat ranges: first, end, first, end."""
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) > 1)
    return np.stack([hits[np.concatenate([[0], cut + 1])], hits[np.concatenate([cut, [len(hits) - 1]])] + 1], 1).ravel().tolist()


def _fetched(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """name, c1, c2, many, bytes of the contexts wanted (rid, list of name, c1, c2, many, lo, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 64):
                out = []
                for text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = text.encode()
                    out.extend((x["name"], x["c1"], x["c2"], x["many"], data[x["lo"] : x["lo"] + x["n"] + length - 1]) for x in want)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["name", "c1", "c2", "many", "bytes"])
        tidy()

    return rows.select("rid", "text").join(wanted, "rid").select("text", "want").mapInArrow(run, "name long, c1 long, c2 long, many long, bytes binary")


def _sorted_contexts(texts: DataFrame, length: int) -> DataFrame:
    """name, c1, c2, ranges of the contexts (all of a name together in one task) with a repeating window, from suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def solve() -> pa.RecordBatch:
            out = [(*x[:3], _ranges(r)) for x, r in zip(held, repeated_starts([x[3] for x in held], length)) if len(r)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["name", "c1", "c2", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if row[0] != last and size > SYMBOLS // 4:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]) + 1, row[0]
        if held:
            yield solve()
        tidy()

    return texts.select("name", "c1", "c2", "bytes").repartition("name").sortWithinPartitions("name").mapInArrow(run, "name long, c1 long, c2 long, ranges array<int>")


def pieces_of(data: bytes, gram: int, part: int, length: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """First window, number of windows, name, digest and bytes of the pieces that a context is cut to.

    gram: the hash that named it. Windows of a piece have the same first place of that gram,
    and it stands at o // part = g of them, so all cover the bytes from o = part * g on to the end of the window
    with the greatest o; equal windows have equal o, so pieces whose covered bytes or g differ share none.
    """
    text = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(gram_hashes(text) == np.uint64(gram & 0xFFFFFFFFFFFFFFFF))
    starts = np.arange(len(text) - length + 1)
    nearest = np.searchsorted(at, starts)
    group = (at[nearest] - starts) // part
    cut = np.flatnonzero((nearest[1:] != nearest[:-1]) | (group[1:] != group[:-1])) + 1
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(starts)]):
        q, g = int(at[nearest[s]]), int(group[s])
        last = min((g + 1) * part, length - GRAM + 1) - 1
        name = hashlib.blake2b(data[q - g * part : q - last + length], digest_size=8, key=b"%d %d %d" % (gram, part, g)).digest()
        piece = data[s : e - 1 + length]
        yield s, e - s, name, hashlib.blake2b(piece, digest_size=16).digest(), piece


def _cut(crowded: DataFrame, part: int, length: int) -> DataFrame:
    """p_name, p_c1, p_c2, at, n, name, c1, c2, gram, many, bytes: the pieces of contexts (name, c1, c2, gram, many, bytes)."""
    names = "p_name p_c1 p_c2 at n name c1 c2 gram many bytes".split()
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 5 + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 5, 256, 1 << 16):
                out = []
                for name, c1, c2, gram, many, data in zip(*(some.column(i).to_pylist() for i in range(6))):
                    for at, n, new, digest, piece in pieces_of(data, gram, part, length):
                        out.append((name, c1, c2, at, n, int.from_bytes(new, "little", signed=True), *np.frombuffer(digest, np.int64).tolist(), gram, many, piece))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
        tidy()

    schema = "p_name long, p_c1 long, p_c2 long, at int, n int, name long, c1 long, c2 long, gram long, many long, bytes binary"
    return crowded.select("name", "c1", "c2", "gram", "many", "bytes").mapInArrow(run, schema)


def _verdicts(texts: DataFrame, width: int, length: int) -> DataFrame:
    """name, c1, c2, ranges (starts and ends of repeating windows; null: all) of contexts (name, c1, c2, gram, many, bytes) that have any.

    width: how many places the gram may have in a window of these contexts.
    """
    id_columns = ["name", "c1", "c2"]
    whole = texts.where("many > 1").select(*id_columns, F.lit(None).cast("array<int>").alias("ranges"))
    if width == 1:  # a context is one window: others of the name are equal to it, or there are none
        return whole
    hot = written(texts.groupBy("name").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > MOST_CONTEXTS).select("name"), "crowded-names")
    if not hot.take(1):
        return _sorted_contexts(texts, length).join(texts.where("many > 1").select(*id_columns), id_columns, "left_anti").unionByName(whole)
    some = _sorted_contexts(texts.join(hot, "name", "left_anti"), length)
    part = -(-width // CUT)
    cut = written(_cut(texts.join(hot, "name", "left_semi"), part, length), "pieces")
    same = cut.groupBy(*id_columns).agg(F.min("gram").alias("gram"), F.sum("many").alias("many"), F.min("bytes").alias("bytes"))
    found = written(_verdicts(written(same, "distinct-pieces"), part, length), "piece-verdicts")
    ranges = F.when(F.col("ranges").isNull(), F.array(F.col("at"), F.col("at") + F.col("n"))).otherwise(F.transform("ranges", lambda x: x + F.col("at")))
    up = cut.where("many = 1").drop("bytes").join(found, id_columns).groupBy(F.col("p_name").alias("name"), F.col("p_c1").alias("c1"), F.col("p_c2").alias("c2")).agg(F.flatten(F.collect_list(ranges)).alias("ranges"))
    return some.join(texts.where("many > 1").select(*id_columns), id_columns, "left_anti").unionByName(up).unionByName(whole)


def _repeating(rows: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """name, c1, c2, ranges (null: all) of the contexts with repeating windows."""
    spark = rows.sparkSession
    # 1. different contexts, with the number of their places
    distinct = parts.groupBy("name", "c1", "c2").agg(F.count(F.lit(1)).alias("many"), F.max("twice").alias("twice"), F.min(F.struct("rid", "lo", "n")).alias("at"))
    distinct = written(distinct, "contexts")
    release(spark)
    shared = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("contexts"), F.max(F.col("twice") & (F.col("many") == 1)).alias("inner")).where("contexts > 1 or inner")
    shared = written(shared.select("name"), "names")
    release(spark)
    # 2. the bytes of those that others may share in part
    want = distinct.join(shared, "name").select(F.col("at.rid").alias("rid"), F.struct("name", "c1", "c2", "many", F.col("at.lo").alias("lo"), F.col("at.n").alias("n")).alias("x"))
    want = written(want.groupBy("rid").agg(F.collect_list("x").alias("want")), "wanted")
    texts = written(_fetched(rows, want, length), "context-bytes")
    release(spark)
    partly = _verdicts(texts.withColumn("gram", F.col("name")), length - GRAM + 1, length).where("ranges IS NOT NULL")
    whole = distinct.where("many > 1").select("name", "c1", "c2", F.lit(None).cast("array<int>").alias("ranges"))
    return written(whole.unionByName(partly), "verdicts", keep=True)


def _met(rows: DataFrame, length: int) -> DataFrame:
    """The members whose windows another may repeat: their name has more members than one, or its gram may occur twice.

    Names alone are counted, combined before the shuffle; a name that many members have goes back
    to them by a join that Spark splits.
    """
    spark = rows.sparkSession
    with scratch(spark):
        each = written(members(rows, length), "members")
        met = written(each.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.max("twice").alias("inner")).where("k > 1 or inner").select("name"), "met-names")
        release(spark)
        return written(each.join(met, "name", "left_semi"), "met-members", keep=True)


def _covers(rows: DataFrame, length: int) -> DataFrame:
    """rid and cover (lo, n, ranges of the repeating windows of its contexts) of the rows (rid, text) that have any."""
    spark = rows.sparkSession
    parts = _met(rows, length)
    with scratch(spark):
        verdicts = _repeating(rows, parts, length)
    # 3. back to the documents
    each = parts.select("name", "c1", "c2", "rid", "lo", "n").join(verdicts, ["name", "c1", "c2"]).groupBy("rid").agg(F.collect_list(F.struct("lo", "n", "ranges")).alias("cover"))
    return written(each, "covers", keep=True)


def _without(data: bytes, cover: list[dict] | None, length: int) -> tuple[list[int], bytes]:
    """The ranges that a cover removes, flat, and the bytes that stay."""
    edges = np.zeros(len(data) + 1, np.int64)
    for x in cover or ():
        pairs = x["ranges"] if x["ranges"] is not None else [0, x["n"]]
        for a, b in zip(pairs[::2], pairs[1::2]):
            edges[x["lo"] + a] += 1
            edges[x["lo"] + b - 1 + length] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    flat = _ranges(np.flatnonzero(gone))
    return flat, np.frombuffer(data, np.uint8)[~gone].tobytes() if flat else data


def _covered(docs: DataFrame, length: int, carry: tuple[str, ...]) -> DataFrame:
    """rid, doc_id, text, cover and the columns in carry of docs."""
    rows = keyed(docs, *dict.fromkeys(("doc_id", "text", *carry)))
    rows = rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    with scratch(docs.sparkSession):
        each = _covers(rows.select("rid", "text"), length)
    return rows.join(each.select(F.col("rid").alias("_rid"), "cover"), F.col("rid") == F.col("_rid"), "left").select("rid", "doc_id", "text", "cover", *carry)


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row of docs (doc_id, text): rid, doc_id, text, spans (start, end in bytes of the maximal runs to remove), kept (binary).

    A byte goes if a string of `length` bytes covers it that starts anywhere else too, in
    its own document or another; overlaps count, as do all copies, the first included. Null
    texts are empty; texts shorter than `length` stay whole; repeated rows repeat each other;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, 2, 64):
                spans, kept = [], []
                for text, cover in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    flat, left = _without(text.encode(), cover, length)
                    spans.append([{"start": a, "end": b} for a, b in zip(flat[::2], flat[1::2])])
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(spans, kind), pa.array(kept, pa.binary())], names=["rid", "doc_id", "text", "spans", "kept"])
        tidy()

    rows = _covered(docs, length, ())
    return rows.mapInArrow(run, f"rid {KEY}, doc_id {dict(rows.dtypes)['doc_id']}, text string, spans array<struct<start:long,end:long>>, kept binary")


def deduplicated(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), length: int = 200) -> DataFrame:
    """docs without the repeated spans: the same rows, text what is left of it (a character that a span cuts goes too), n_chars its length.

    As repeated_spans() otherwise: null texts become empty, repeated rows lose what they share, an empty table gives no rows; columns beside the given ones go.
    """
    carry = tuple(c for c in columns if c not in ("doc_id", "text", "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 64):
                left = [_without(t.encode(), c, length)[1].decode("utf-8", "ignore") for t, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(left, pa.string()), pa.array([len(t) for t in left], pa.int64()), *part.columns[3:]], names=["doc_id", "text", "n_chars", *carry])
        tidy()

    rows = _covered(docs, length, carry).select("doc_id", "text", "cover", *carry)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, text string, n_chars long" + "".join(f", `{c}` {kinds[c]}" for c in carry)).select(*columns)
