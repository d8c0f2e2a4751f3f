"""Language-model scoring by deleted interpolation of trigrams.

P(w | u, v) mixes 1 / (V + 1) and the maximum-likelihood estimates of one, two and three words. The mixture weights
depend on how often the longest known context was seen (a bucket for each power of two); expectation-maximisation learns them on
held-out counts: every training document is scored with the counts of all the others, its own deleted.

One pass over the texts writes chunks of about a million tokens as numbers into a list of their distinct words. For
each order, a chunk asks for the totals of its distinct n-grams: sorted 64-bit hashes, packed for each range of
hashes. A range (about a million entries) adds up what all chunks say of its n-grams and answers each, so a frequent n-gram is one entry a chunk.
What comes back meets the chunk twice: to gather the held-out counts, and to score. Words and n-grams are told
apart by their 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import release, scratch, slices, small_batches, tidy, written
from adaptlm.llm.words import BLOCK, LOWER, SPACE, mixed, text_bytes, word_bounds, word_hashes

#: Tokens of a chunk, entries of a range of hashes, at most about.
CHUNK_TOKENS, RANGE_ENTRIES = 1 << 20, 1 << 20
#: Words longer than this many bytes are hashed by BLAKE2b.
LONG_WORD = 1 << 16
ORDERS = 3
#: Buckets of a kind of context (none, one word, two words), and bins of an estimate for each power of two when the weights are learned.
KIND, BINS = 32, 2
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest modulo 10; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 as a compressed block, a plane for each byte."""
    a = np.ascontiguousarray(a, np.uint64)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(block: bytes) -> np.ndarray:
    n = int.from_bytes(block[:8], "little")
    planes = pa.Codec("zstd").decompress(block[8:], decompressed_size=8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _long_word(letters: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(LOWER[letters].tobytes(), digest_size=8).digest(), "little"))


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes(), but for long words."""
    hashes, counts = word_hashes(data, offsets)
    if np.diff(offsets).max(initial=0) > LONG_WORD:
        start, length, _ = word_bounds(data, offsets)
        for i in np.flatnonzero(length > LONG_WORD):
            hashes[i] = _long_word(data[start[i] : start[i] + length[i]])
    return hashes, counts


def _long_text(data: np.ndarray) -> np.ndarray:
    """The word hashes of one text, in runs of about BLOCK bytes."""
    out, at = [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and not SPACE[data[stop]]:
            ahead = SPACE[data[stop : stop + BLOCK]]
            stop += int(ahead.argmax()) if ahead.any() else len(ahead)
        last = stop
        if stop - at > 2 * BLOCK:  # it ends with a word that is longer than a run
            before = np.flatnonzero(SPACE[data[at : at + BLOCK]])
            last = at + (int(before[-1]) + 1 if len(before) else 0)
        out.append(_hashes(data[at:last], np.array([0, last - at]))[0])
        if last < stop:
            out.append(np.array([_long_word(data[last:stop])]))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts end to end, an end after each text's words, and how many each text has."""
    data, offsets = text_bytes(column)
    if len(offsets) == 2 and len(data) > 2 * BLOCK:
        hashes = _long_text(data)
        counts = np.array([0, len(hashes)])
    else:
        hashes, counts = _hashes(data, offsets)
    n = np.diff(counts)
    out = np.empty(len(hashes) + len(n), np.uint64)
    ends = np.cumsum(n + 1) - 1
    out[ends] = _END
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = hashes
    return out, n + 1


def _shifted(a: np.ndarray, first: np.ndarray, start: int | np.uint64) -> np.ndarray:
    """What stands before each token; start at the first of a piece."""
    out = np.empty_like(a)
    out[1:] = a[:-1]
    out[first] = start
    return out


def grams(tokens: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each token; first: where pieces begin."""
    g = tokens
    for _ in range(order - 1):
        g = mixed(_shifted(g, first, _START) * _ODD + tokens)
    return g


class Chunk:
    """Tokens of pieces of documents. The first skip tokens of a piece only give context to the rest: they are the last of the piece before."""

    def __init__(self, row: dict):
        self.lens, self.skip, self.train = (np.array(row[c], np.int64) for c in ("lens", "skip", "train"))
        self.words, at = unpacked(row["words"]), unpacked(row["tokens"])
        self.tokens = self.words[at.astype(np.int64)]
        self.first = np.cumsum(self.lens) - self.lens
        self.piece = np.repeat(np.arange(len(self.lens)), self.lens)
        self.scored = np.arange(len(self.tokens)) - self.first[self.piece] >= self.skip[self.piece]
        self.weight = self.scored & (self.train[self.piece] > 0)

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(grams(self.tokens, self.first, order), return_inverse=True)

    def own(self, at: np.ndarray) -> np.ndarray:
        """How often the n-gram of each token (its number) is in its piece."""
        _, same = np.unique(self.piece * (int(at.max(initial=0)) + 1) + at, return_inverse=True)
        return np.bincount(same, self.scored).astype(np.int64)[same]


def _estimates(counts: list[np.ndarray], contexts: list) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token's context and its estimates [order, token]; 0 where a context was never seen."""
    ml = np.zeros((ORDERS, len(counts[0])))
    bucket = np.zeros(len(counts[0]), np.int64)
    for k, (c, of) in enumerate(zip(counts, contexts)):
        of = np.broadcast_to(np.asarray(of, np.int64), c.shape)
        seen = of > 0
        ml[k, seen] = c[seen] / of[seen]
        if k:
            bucket[seen] = k * KIND + np.minimum(np.frexp(of[seen].astype(float))[1] - 1, KIND - 1)
    return bucket, ml


def _even(orders: int, any_words: bool) -> np.ndarray:
    """Weights [bucket, component] before anything is known: even over what a bucket's context can give."""
    w = np.zeros((orders * KIND, orders + 1))
    for b in range(len(w)):
        w[b, : b // KIND + 2] = 1 / (b // KIND + 2)
    if not any_words:
        w[:] = np.eye(orders + 1)[0]
    return w


def learned(histogram: DataFrame, classes: int, any_words: bool, rounds: int = 30, enough: float = 1e-6) -> np.ndarray:
    """Mixture weights [bucket, component] by expectation-maximisation on a written table (bucket, ml1, ml2, ml3, n) of held-out counts.

    One even observation is added to each bucket, so a bucket without counts stays even. It ends after so many
    rounds, or when a round raises the log likelihood by less than this part.
    """
    weights, before = _even(ORDERS, any_words), None
    spark = histogram.sparkSession
    even = weights.copy()
    for _ in range(rounds if any_words else 0):
        table = spark.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], "b int, w0 double, w1 double, w2 double, w3 double")
        parts = [F.col("w0") / classes, *(F.col(f"w{k}") * F.col(f"ml{k}") for k in (1, 2, 3))]
        seen = histogram.join(F.broadcast(table), F.col("bucket") == F.col("b"))  # a row for each bucket
        seen = seen.select("b", "n", *(p.alias(f"p{k}") for k, p in enumerate(parts))).withColumn("p", F.expr("p0 + p1 + p2 + p3"))
        got = seen.groupBy("b").agg(F.sum(F.expr("n * ln(p)")).alias("ll"), F.sum("n").alias("n"), *(F.sum(F.expr(f"n * p{k} / p")).alias(f"r{k}") for k in range(4))).collect()
        weights = even.copy()
        for r in got:
            weights[r.b] = (np.array([r.r0, r.r1, r.r2, r.r3]) + even[r.b]) / (r.n + 1)
        now = sum(r.ll for r in got)
        if before is not None and now - before <= enough * abs(before):
            break
        before = now
    return weights


def scored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Tokens are the words of the whole text with A-Z in lower case, then one end; a null text is as an empty one, the
    end alone. All but the held-out documents are counted. base_score is the unigram model with 0.1 added to each
    count, score the interpolated model, both as sums of log10 over the tokens. A training document is scored with the counts
    as they are, its own included. Rows that repeat an id are documents of their own. Without training documents a score is 0. An empty table gives
    no rows; other columns are ignored. A document of more tokens than a chunk is cut into
    pieces that know the two tokens before them; what is deleted for it when weights are learned is the piece.
    """
    with scratch(docs.sparkSession):
        return _scored_texts(docs)


def _scored_texts(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (~held_out(F.col("doc_id"))).alias("train"), F.col("text").cast("string").alias("text"))
    chunk_schema = f"chunk long, docs array<long>, ids array<{kind}>, train array<boolean>, skip array<int>, lens array<int>, counted long, train_docs long, n_tokens long, words binary, tokens binary"

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, chunks, number = TaskContext.get().partitionId() << 40, 0, 0
        pieces: list[tuple] = []  # document, id, train, skip, tokens

        def chunk() -> pa.RecordBatch:
            nonlocal chunks
            words, at, often = np.unique(np.concatenate([p[4] for p in pieces]), return_inverse=True, return_counts=True)
            by = np.argsort(-often, kind="stable")  # small numbers for frequent words
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            words, at = words[by], place[at]
            lens, skip, train = (np.array(x, np.int64) for x in ([len(p[4]) for p in pieces], [p[3] for p in pieces], [p[2] for p in pieces]))
            values = [[base + chunks], [[p[0] for p in pieces]], [[p[1] for p in pieces]], [train.astype(bool)], [skip.astype(np.int32)], [lens.astype(np.int32)],
                      [int(((lens - skip) * train).sum())], [int((train * (skip == 0)).sum())], [int(lens.sum())], [packed(words)], [packed(at)]]
            chunks += 1
            pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

        waiting = 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            names = ["chunk", "docs", "ids", "train", "skip", "lens", "counted", "train_docs", "n_tokens", "words", "tokens"]
            for part in slices(batch, 2):
                tokens, lens = tokens_of(part.column(2))
                ends = np.cumsum(lens)
                for i, (doc_id, train) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    of = tokens[ends[i] - lens[i] : ends[i]]
                    for at in range(0, len(of), CHUNK_TOKENS):
                        skip = 2 if at else 0
                        pieces.append((base + number, doc_id, train, skip, of[at - skip : at + CHUNK_TOKENS]))
                        waiting += len(pieces[-1][4])
                        if waiting >= CHUNK_TOKENS:
                            yield chunk()
                            waiting = 0
                    number += 1
        if pieces:
            yield chunk()
        tidy()

    chunks = written(rows.mapInArrow(chunked, chunk_schema), "token-chunks")
    total, train_docs, n_tokens = chunks.agg(F.sum("counted"), F.sum("train_docs"), F.sum("n_tokens")).first()
    if n_tokens is None:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def totals(order: int) -> DataFrame:
        """chunk, order, part, counts: of each distinct n-gram of a chunk, in order of its hash, how often all training documents have it; the first row of a part says how many n-grams they have."""
        bits = max(0, int(n_tokens // RANGE_ENTRIES)).bit_length()

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    c = Chunk(row)
                    hashes, at = c.distinct(order)
                    counts = np.bincount(at, c.weight, len(hashes)).astype(np.int64)
                    cuts = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(hashes)])
                    for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                        if z > a:
                            steps = np.diff(hashes[a:z], prepend=np.uint64(0))
                            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([p], pa.int32()), pa.array([packed(steps)], pa.binary()), pa.array([packed(counts[a:z])], pa.binary())], names=["chunk", "part", "hashes", "counts"])
            tidy()

        def added(key: tuple, t: pa.Table) -> pa.Table:
            hashes = [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in t.column("hashes")]
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, at, np.concatenate([unpacked(x.as_py()) for x in t.column("counts")]).astype(np.int64))
            ends = np.cumsum([len(h) for h in hashes])
            out = [packed(sums[at[e - len(h) : e]]) for e, h in zip(ends, hashes)]
            seen = [int((sums > 0).sum()), *[0] * (len(out) - 1)]
            tidy()
            return pa.table({"chunk": t.column("chunk"), "ngram": pa.array([order] * len(out), pa.int32()), "part": t.column("part"), "counts": pa.array(out, pa.binary()), "seen": pa.array(seen, pa.int64())})

        asking = chunks.select("chunk", "train", "skip", "lens", "words", "tokens").mapInArrow(asked, "chunk long, part int, hashes binary, counts binary")
        return written(asking.groupBy("part").applyInArrow(added, "chunk long, ngram int, part int, counts binary, seen long"), f"totals-{order}")

    answers = None
    for order in range(1, ORDERS + 1):
        answer = totals(order)
        release(spark)
        if order == 1:
            vocabulary = answer.agg(F.sum("seen")).first()[0]
        answers = answer if answers is None else answers.unionByName(answer)
    classes = vocabulary + 1

    def laid(left: pa.Table, right: pa.Table) -> tuple[Chunk, list[np.ndarray], list[np.ndarray]]:
        """A chunk; of each of its tokens, for each order, how often training documents have its n-gram, and the number of the n-gram in the chunk."""
        c = Chunk(left.to_pylist()[0])
        order_of, part_of, blocks = right.column("ngram").to_numpy(), right.column("part").to_numpy(), right.column("counts")
        counts, numbers = [], []
        for order in range(1, ORDERS + 1):
            mine = np.flatnonzero(order_of == order)
            found = np.concatenate([unpacked(blocks[int(i)].as_py()) for i in mine[np.argsort(part_of[mine])]]).astype(np.int64)
            numbers.append(c.distinct(order)[1])
            counts.append(found[numbers[-1]])
        return c, counts, numbers

    def contexts_of(c: Chunk, counts: list[np.ndarray], use: np.ndarray, everything: int | np.ndarray, start: int) -> list:
        """How often the context of each used token is there: all tokens, the word before, the two before."""
        return [everything, *(_shifted(counts[k], c.first, start)[use] for k in range(ORDERS - 1))]

    def gathered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        c, counts, numbers = laid(left, right)
        use = c.weight
        # the counts without the document's own
        for k in range(ORDERS):
            counts[k] -= c.own(numbers[k])
            numbers[k] = None
        size = np.bincount(c.piece, c.scored).astype(np.int64)[c.piece][use]
        bucket, ml = _estimates([n[use] for n in counts], contexts_of(c, counts, use, total - size, train_docs - 1))
        keys = bucket
        for k in range(ORDERS):
            with np.errstate(divide="ignore"):
                bins = np.where(ml[k] > 0, np.clip(np.rint(-BINS * np.log2(ml[k])), 0, 1022), 1023).astype(np.int64)
            keys = keys * 1024 + bins
        keys, n = np.unique(keys, return_counts=True)
        del c, counts, bucket, ml
        tidy()
        return pa.table({"keys": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    beside = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    counted = written(beside.applyInArrow(gathered, "keys long, n long").groupBy("keys").agg(F.sum("n").alias("n")), "held-out-counts")
    release(spark)
    bins = [F.expr(f"shiftright(keys, {10 * (ORDERS - k)}) & 1023") for k in range(1, ORDERS + 1)]
    histogram = counted.select(F.expr(f"CAST(shiftright(keys, {10 * ORDERS}) AS int)").alias("bucket"), *(F.when(b < 1023, F.pow(F.lit(2.0), -b / BINS)).otherwise(0.0).alias(f"ml{k}") for k, b in enumerate(bins, 1)), "n")
    weights = learned(histogram, classes, total > 0)

    def summed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        c, counts, _ = laid(left, right)
        use = c.scored
        lens = c.lens - c.skip
        first = np.cumsum(lens) - lens
        bucket, ml = _estimates([n[use] for n in counts], contexts_of(c, counts, use, total, train_docs))
        p = weights[bucket, 0] / classes
        for k in range(ORDERS):
            p += weights[bucket, k + 1] * ml[k]
        one = counts[0][use]
        sums = [np.add.reduceat(x, first) for x in ((one > 0).astype(np.int64), np.log10((one + 0.1) / (total + 0.1 * classes)), np.log10(p))]
        docs, ids, train = (left.column(x).combine_chunks().flatten() for x in ("docs", "ids", "train"))
        del c, counts, bucket, ml, p
        tidy()
        return pa.table([docs, ids, train, pa.array(lens), *map(pa.array, sums)], names=["doc", "doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    scores = beside.applyInArrow(summed, f"doc long, doc_id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    scores = written(scores, "scores", keep=True)
    scores = scores.groupBy("doc", "doc_id", "train").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))  # the pieces of a long document
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
