"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned at quantiles. Boosting goes round the features, each
round adding a shallow tree of one feature's bins to that feature's table; then the pairs that
explain most of what is left get tables of two features from trees that split on both.
A score is the logistic of sums of table entries, taken for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adaptlm.llm.shared import slices, small_batches, tidy
from adaptlm.llm.words import SPACE, mixed, shingle_hashes, text_bytes, word_bounds, word_hashes

FEATURES = ("words", "word_length", "longest_word", "symbols", "bars", "exclamations", "capitals", "capital_words", "digits", "stops", "other_marks", "high_bytes", "lines", "line_length", "same_line", "same_word", "distinct_words", "commonest_word", "repeated_shingles")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOLS, _BARS, _EXCLAIM, _DIGITS, _STOPS = _class(b"#*$%&<>@^~\\{}[]_="), _class(b"|"), _class(b"!"), _class(b"0123456789"), _class(b".,;:?")
_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_OTHER = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum())) - _SYMBOLS - _BARS - _EXCLAIM - _STOPS
_HIGH = (np.arange(256) >= 128).astype(np.int64)
_NEWLINE = _class(b"\n")


_LINE_VALUES = mixed(np.arange(64 * 256, dtype=np.uint64)).reshape(64, 256)


def _since(data: np.ndarray) -> np.ndarray:
    """For each byte the place of the last line break before it."""
    breaks = np.where(np.concatenate([[False], data[:-1] == 10]) if len(data) else np.empty(0, bool), np.arange(len(data)), 0)
    return np.maximum.accumulate(breaks) if len(data) else breaks


def features(column: pa.Array) -> np.ndarray:
    """[text, feature] of whole texts; a null text is as an empty one, all zeros."""
    data, offsets = text_bytes(column)
    n_texts = len(offsets) - 1

    def count(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[data])])
        return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)

    words, counts = word_hashes(data, offsets)
    shingles, ends = shingle_hashes(words, counts)
    n = np.diff(counts).astype(float)
    per = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper, lower = count(_UPPER), count(_LOWER)
    spaces = count(SPACE.astype(np.int64))
    starts, lengths, _ = word_bounds(data, offsets)
    caps = np.concatenate([[0], np.cumsum(_UPPER[data[starts]])])
    longest, same_line, line_length, same_word, distinct, commonest, repeated = (np.zeros(n_texts) for _ in range(7))
    line_start = np.flatnonzero(_NEWLINE[data]) + 1
    running = np.concatenate([[np.uint64(0)], np.cumsum(_LINE_VALUES[(np.arange(len(data)) - _since(data)) & 63, data], dtype=np.uint64)])
    for i in range(n_texts):
        a, b = counts[i], counts[i + 1]
        if a == b:
            continue
        w = words[a:b]
        if b - a > 1:
            same_word[i] = (w[1:] == w[:-1]).mean()
        _, k = np.unique(w, return_counts=True)
        distinct[i], commonest[i] = len(k) / (b - a) ** 0.75, k.max() / (b - a)
        s = shingles[ends[i] : ends[i + 1]]
        repeated[i] = 1 - len(np.unique(s)) / len(s)
        lo, hi = offsets[i], offsets[i + 1]
        cuts = np.concatenate([[lo], line_start[np.searchsorted(line_start, lo, "right") : np.searchsorted(line_start, hi, "right")], [hi]])
        sizes = np.diff(cuts)
        ids = (running[cuts[1:]] - running[cuts[:-1]]) * np.uint64(31) + sizes.astype(np.uint64)
        ids = ids[sizes > 1]
        if len(ids):
            same_line[i], line_length[i] = 1 - len(np.unique(ids)) / len(ids), np.log1p(sizes.mean())
    if len(starts):
        longest[n > 0] = np.log1p(np.maximum.reduceat(lengths, counts[:-1][n > 0]))
    return np.stack([
        np.log1p(n), (size - spaces) / per * (n > 0), longest, count(_SYMBOLS) / per, count(_BARS) / per, count(_EXCLAIM) / per,
        upper / np.maximum(upper + lower, 1), (caps[counts[1:]] - caps[counts[:-1]]) / per, count(_DIGITS) / size, count(_STOPS) / per, count(_OTHER) / per, count(_HIGH) / size,
        count(_NEWLINE) / per, line_length, same_line, same_word, distinct, commonest, repeated,
    ], 1)


@dataclass
class AdditiveModel:
    """Tables by feature and by pair of features, over the bins that edges make."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float = 0.0
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for i, t in enumerate(self.tables):
            out += t[bins[:, i]]
        for (i, j), t in self.pairs.items():
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of bins with gradient sums g and curvature sums h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> float:
    return float(g.sum() / (h.sum() + ridge))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A tree of at most three leaves over the bins of a feature."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = max(((*_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        gain, k, a, b = best
        parts = [p for p in parts if p != (a, b)] + [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b], h[a:b], ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that splits on one feature of a pair, then each side on the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, k = _cut(a.sum(1), b.sum(1), ridge)
        if not k:
            continue
        out, gain = np.zeros_like(a), -float(a.sum() ** 2 / (b.sum() + ridge))
        for rows in (slice(0, k), slice(k, len(a))):
            ga, hb = a[rows].sum(0), b[rows].sum(0)
            m = _cut(ga, hb, ridge)[1]
            for cols in (slice(0, m), slice(m, len(ga))):
                if ga[cols].size:
                    out[rows, cols] = _leaf(ga[cols], hb[cols], ridge)
                    gain += float(ga[cols].sum() ** 2 / (hb[cols].sum() + ridge))
        if gain > best[0]:
            best = (gain, out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 40, most_pairs: int = 8, rate: float = 0.1, ridge: float = 1.0) -> AdditiveModel:
    """A model of y (0 or 1) from x. Without rows, or with one class only, the score is the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    at = model.bins(x)
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[:, i], g, len(t)), np.bincount(at[:, i], h, len(t)), ridge)
            t += step
            logit += step[at[:, i]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(model.tables[i]), len(model.tables[j])
        return np.bincount(at[:, i] * shape[1] + at[:, j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {(i, j): _pair_tree(grid(i, j, g), grid(i, j, h), ridge)[0] for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:most_pairs]
    model.pairs = {(i, j): np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in chosen}
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h), ridge)[1]
            t += step
            logit += step[at[:, i], at[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> AdditiveModel:
    """Fit on documents with a label quality of 0 or 1 that are not held out, at most max_rows of them by a hash of the id.

    Rows with a null id or another label are left out; an id with several labels gives a row for each.
    """
    kept = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = kept.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("l_id"), "l_id", "quality").limit(max_rows)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "quality")  # max_rows bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(features(part.column(1)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])
        tidy()

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = joined.mapInArrow(run, f"doc_id {kind}, quality int, x array<double>").orderBy("doc_id", "quality", "x").limit(2 * max_rows).collect()
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], float), **options)


def scored(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """docs (with doc_id, text) with their columns kept under their names, and held_out, score, predicted appended.

    Null and empty texts get the score of all-zero features. Columns of docs named as
    an appended one are replaced. An empty table gives no rows.
    """
    docs = docs.drop("held_out", "score", "predicted")
    names, at = docs.columns, [c.lower() for c in docs.columns].index("text")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                text = part.column(at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(text)))], names=[*names, "score"])
        tidy()

    small_batches(docs.sparkSession)
    out = docs.mapInArrow(run, schema)
    return out.select(*(F.col(f"`{n}`") for n in names), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
