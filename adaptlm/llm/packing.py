"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window is one training
sequence. In each window a source earns a quantum (window length times its
target proportion), adds it to the deficit carried from earlier windows and
sends what it may; a queue that runs dry leaves the round and the others share
its part. Run token by token this is a total order: token j of source s is due
at virtual time v_s(j), when the quanta earned by s reach j + 1/2; ties go to the
smaller source index. What source s has sent before window w is then the number
of its tokens among the first window * w of that order, so deficits at any window
follow from the totals of the sources alone. Each task enters the schedule at
its own documents' windows with the right deficits: no task waits for another,
and documents are cut where they lie, without a shuffle of tokens.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.llm.mixing import in_turn
from adaptlm.llm.shared import shared_dir, slices, tidy, written

#: Words whose ids a task remembers; they are forgotten when it ends, as a worker process outlives it.
CACHED_WORDS = 100_000
#: Longest run of white space for the rank table, whose regular expression ends with an error at about a million.
MOST_SPACE = 100_000
#: Sources of a schedule at most, and cells of a table of windows by sources.
MOST_SOURCES, CELLS = 4096, 400_000


#: Fixed value: how byte-level BPE cuts a text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level BPE vocabulary, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of a text as little-endian bytes, equal to the tokenizer's on the whole text.

    A single space between two characters that are not white space always starts a new
    pre-token of a byte-level BPE, so the text can be cut there; words seen
    before come from a bounded cache, others from a rank table where the vocabulary
    lists its merges in order of ids, else (and with very long white space) from the tokenizer itself. ordinary: the
    strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.ordinary = ordinary
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.rare = re.compile("[\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]").search
        self.cut = re.compile(r"(?<=\S) (?=\S)").split
        self.spaces = re.compile(r"\s+").findall
        spec = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.byte_level = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex") and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["normalizer"]
        self.ranked = self._ranked(spec["model"]) if self.byte_level else None

    def _ranked(self, model: dict):
        import tiktoken

        merges, vocab = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]], model["vocab"]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        to_byte = byte_alphabet()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known.clear()
        for w in words:
            self.known[w] = self._ids(" " + w)

    def _ids(self, text: str) -> bytes:
        ids = self.ranked.encode_ordinary(text) if self.ranked and not self._far(text) else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, self.dtype).tobytes()

    def _far(self, text: str) -> bool:
        """Whether white space runs on for more than the rank table takes."""
        return len(text) > MOST_SPACE and max(map(len, self.spaces(text)), default=0) > MOST_SPACE

    def _even(self, text: str) -> bool:
        """Whether each space stands alone between characters that are not white space."""
        return not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or " \t" in text or "\t " in text or self.rare(text))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.byte_level or not self.ordinary and any(x in text for x in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        words = text.split(" ") if self._even(text) else self.cut(text)
        head = self._ids(words.pop(0))
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list({w for w, f in zip(words, found) if f is None}))
            found = [f if f is not None else self.known[w] for w, f in zip(words, found)]
        return head + b"".join(found)


@functools.lru_cache(2)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One for all tasks of a worker process, which reads the vocabulary once."""
    return Encoder(path, ordinary)


class Schedule:
    """Who fills which window. totals: tokens by source; weights: target proportions, by default the totals themselves."""

    def __init__(self, totals: np.ndarray, window: int, weights: np.ndarray | None = None):
        self.totals, self.window = np.asarray(totals, np.int64), window
        w = self.totals.astype(float) if weights is None else np.asarray(weights, float)
        left, now = self.totals.astype(float), 0.0
        times, sent = [0.0], [np.zeros(len(left))]
        done = self.totals == 0
        while not done.all():
            rate = np.where(done, 0, w)
            if rate.sum() <= 0:  # only sources of weight 0 are left
                rate = np.where(done, 0, left)
            rate = rate / rate.sum()
            need = np.divide(left, rate, out=np.full(len(left), np.inf), where=rate > 0)
            step = need.min()
            ended = need <= step * (1 + 1e-12)
            now, left = now + step, np.where(ended, 0, left - rate * step)
            done |= ended
            times.append(now)
            sent.append(np.where(done, self.totals, self.totals - left))
        self.times, self.sent = np.array(times), np.array(sent)

    def due(self, s: int, j: np.ndarray) -> np.ndarray:
        """Virtual time of token j of source s."""
        return np.interp(j + 0.5, self.sent[:, s], self.times)

    def _by(self, s: int, t: np.ndarray, ties: bool) -> np.ndarray:
        """Tokens of s that are due before t, or at t too."""
        c = np.clip(np.floor(np.interp(t, self.times, self.sent[:, s]) + 0.5).astype(np.int64), 0, self.totals[s])
        for _ in range(4):
            late = (c > 0) & (self.due(s, c - 1) > t if ties else self.due(s, c - 1) >= t)
            early = (c < self.totals[s]) & (self.due(s, c) <= t if ties else self.due(s, c) < t)
            if not (late.any() or early.any()):
                break
            c = c - late + (early & ~late)
        return c

    def rank(self, s: int, j: np.ndarray) -> np.ndarray:
        """Position of token j of source s in the whole order."""
        t, out = self.due(s, j), j.copy()
        for o in range(len(self.totals)):
            if o != s and self.totals[o]:
                out += self._by(o, t, o < s)
        return out

    def sent_before(self, w: np.ndarray) -> np.ndarray:
        """[window, source]: tokens of each source in the windows before w; the deficits are the earned quanta less these."""
        goal = np.minimum(w * self.window, self.totals.sum())
        c = np.stack([self._by(s, goal.astype(float), True) for s in range(len(self.totals))], 1)
        more = goal - c.sum(1)
        while (rows := np.flatnonzero(more > 0)).size:
            nxt = np.stack([np.where(c[rows, s] < self.totals[s], self.due(s, c[rows, s]), np.inf) for s in range(c.shape[1])], 1)
            c[rows, nxt.argmin(1)] += 1
            more[rows] -= 1
        while (rows := np.flatnonzero(more < 0)).size:
            last = np.stack([np.where(c[rows, s] > 0, self.due(s, c[rows, s] - 1), -np.inf) for s in range(c.shape[1])], 1)
            c[rows, c.shape[1] - 1 - last[:, ::-1].argmax(1)] -= 1
            more[rows] += 1
        return c


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """One row per document: ids (binary), n_tokens with the end id, and its place in its task's part of its source's queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, at = encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.asarray([end_id], encode.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, 2, 1000):
                sources, ids = part.column(1).to_pylist(), [encode(t) + end for t in part.column(2).to_pylist()]
                n, starts = [len(x) // encode.dtype.itemsize for x in ids], []
                for s, k in zip(sources, n):
                    starts.append(at.get(s, 0))
                    at[s] = starts[-1] + k
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([task] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array([encode.dtype.itemsize] * len(n), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n_tokens", "task", "task_start", "id_bytes", "ids"])
        encode.known.clear()
        tidy()

    shared_dir(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, source string, n_tokens long, task int, task_start long, id_bytes int, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, weights: dict[str | None, float] | tuple[float, ...] | None = None, digests: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text, source): doc_id, source, start, length, ids (binary, uint32), doc_tokens, sequence_id, offset.

    weights: target proportion of each source, or proportions that the sources take in turn by code
    point, null last; by default every source's share of all tokens, so that all queues end together. Sequences are full but for the last.
    Null or empty texts consist of the end id alone; null sources form one queue; repeated
    rows are packed each; an empty table gives no pieces. Other columns are ignored.
    The sources' totals are collected: more than MOST_SOURCES sources are an error. Pieces of a document
    that do not add up to its tokens fail the task.
    digests: ids_crc32 (long) in place of the ids.
    """
    tokens = written(tokenised(docs, tokenizer_path, end_id), "tokens")
    by_task = written(tokens.groupBy("source", "task").agg(F.sum("n_tokens").alias("n")), "task-tokens")
    totals = sorted(((r.source, r.n) for r in by_task.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_SOURCES + 1).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = [s for s, _ in totals]
    if isinstance(weights, tuple):
        weights = in_turn(names, weights)
    index = {s: i for i, s in enumerate(names)}
    plan = Schedule(np.array([n for _, n in totals], np.int64), window, None if weights is None else np.array([weights.get(s, 0.0) for s in names]))
    before = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = written(by_task.select(F.col("source").alias("b_source"), F.col("task").alias("b_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "task-starts")
    placed = tokens.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("task") == F.col("b_task"))).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("task_start")).alias("at"), "id_bytes", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5, 1000):
                yield from cut_part(part)
        tidy()

    def cut_part(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        src = np.array([index[s] for s in part.column(1).to_pylist()])
        n, at = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64), part.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        first, last = np.empty_like(n), np.empty_like(n)
        for s in np.unique(src):
            k = src == s
            first[k], last[k] = plan.rank(s, at[k]) // window, plan.rank(s, at[k] + n[k] - 1) // window
        for some in np.array_split(np.arange(len(n)), max(1, int((last - first + 1).sum()) // max(1, CELLS // len(names)))):
            many = last[some] - first[some] + 1
            doc = np.repeat(some, many)
            w = np.repeat(first[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wins, at_win = np.unique(np.concatenate([w, w + 1]), return_inverse=True)
            sent = plan.sent_before(wins)
            a, b = sent[at_win[: len(w)]], sent[at_win[len(w) :]]
            s, row = src[doc], np.arange(len(w))
            lead = np.cumsum(b - a, 1)[row, s] - (b - a)[row, s]
            lo, hi = np.maximum(at[doc], a[row, s]), np.minimum(at[doc] + n[doc], b[row, s])
            full = np.flatnonzero(hi > lo)
            if (np.bincount(doc[full], (hi - lo)[full], len(n))[some] != n[some]).any():
                raise RuntimeError("the pieces of a document do not add up")
            doc, w, start, length, offset = doc[full], w[full], (lo - at[doc])[full], (hi - lo)[full], (lead + lo - a[row, s])[full]
            ids = {d: np.frombuffer(part.column(5)[int(d)].as_py(), "<u2" if part.column(4)[int(d)].as_py() == 2 else "<u4").astype("<u4") for d in some}
            cuts = [ids[d][x : x + k].tobytes() for d, x, k in zip(doc, start, length)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(cuts, pa.binary()), pa.array(n[doc]), pa.array(w), pa.array(offset)], names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            yield part.set_column(4, "ids_crc32", pa.array([zlib.crc32(x) for x in part.column(4).to_pylist()], pa.int64()))

    if digests:
        return placed.mapInArrow(digest, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_digests(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """pack() with a CRC-32 of each piece's ids in their place."""
    return pack(docs, tokenizer_path, digests=True, **options)
