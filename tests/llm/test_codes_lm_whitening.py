import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from adaptlm.llm import codes, interpolation, whitening
from tests.llm.common import awkward_rows, documents, words

VECTORS = "vec_id long, embedding array<float>, label int, component int, n double"


def awkward_vectors(rng, n, width):
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 2 : n // 2 + n // 4] = x[3]  # copies
    rows = [(i, v.tolist(), int(rng.integers(4)) if i % 7 else None, 1, 0.5) for i, v in enumerate(x)]
    bad = [None, [float("nan")] * width, [1.0, None] * (width // 2), [float("inf")] * width]
    return rows + [(1000 + i, b, 1, 1, 0.1) for i, b in enumerate(bad)] + [(None, x[0].tolist(), 2, 1, 0.1), (2000, [], 2, 1, 0.1), (2001, [1.5], None, 1, 0.1), (5, x[5].tolist(), 1, 1, 0.1), (2002, [0.0] * width, 9, 1, 0.1)]


def _good(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


def plain_codes(rows, width, parts=8, entries=16, rounds=6):
    rows = sorted(_good(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    x = [[math.floor(4096 * float(v)) for v in r[1]] + [0] * (width - len(r[1])) for r in rows]
    cut = [[v[p * w : (p + 1) * w] for v in x] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]

    def best(v, book):
        far = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            at = [best(v, books[p])[0] for v in cut[p]]
            for i in range(len(books[p])):
                mine = [v for v, a in zip(cut[p], at) if a == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    ends = [[best(v, books[p]) for v in cut[p]] for p in range(parts)]
    error = [sum(ends[p][i][1] for p in range(parts)) for i in range(len(rows))]
    by = collections.Counter()
    for r, e in zip(rows, error):
        by[r[2]] += e
    import hashlib

    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{ends[p][i][0]:02x}" for p in range(parts)), error[i], by[r[2]], sha)) for i, r in enumerate(rows))


@pytest.mark.parametrize("n", [60, 7])
def test_codes(spark, n):
    rows = awkward_vectors(np.random.default_rng(n), n, 16)
    got = codes.code_digests(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == plain_codes(rows, 16)


def test_codes_of_large_numbers(spark):
    rows = [(i, [1e30 * (i + 1), -2.0**40] + [float(i)] * 6, i % 2, 1, 0.0) for i in range(20)]
    got = {r.vec_id: r for r in codes.code_digests(spark.createDataFrame(rows, VECTORS)).collect()}
    want = plain_codes([(i, np.array(v, np.float32).tolist(), *r) for i, v, *r in rows], 8)
    for w in want:
        i, code, error, by, sha = eval(w)
        fits = lambda v: v if v < 1 << 63 else None
        assert (got[i].code, got[i].codebooks_sha256, got[i].error) == (code, sha, fits(error))


def test_codes_without_rows(spark):
    empty = spark.createDataFrame([(1, None, 1, 1, 0.5)], VECTORS)
    assert codes.code_digests(empty).count() == 0 and codes.code_digests(empty.limit(0)).count() == 0
    only = codes.code_digests(spark.createDataFrame([(1, [1.0] * 8)], "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in only] == [(1, "00" * 8, 0, 0)]


def test_whitening(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(20, 20))
    rows = awkward_vectors(rng, 300, 20)
    rows = [(i, (np.array(v) @ mix).tolist() if v and len(v) == 20 and all(c is not None and math.isfinite(c) for c in v) else v, *r) for i, v, *r in rows]
    rows.append((3000, [1e20] * 20, 1, 1, 0.5))  # no exact x
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    kept = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] + [1_000_000] * (20 - len(r[1]))) for r in _good(rows) if r[1] and max(map(abs, r[1])) < 1e19]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    by = collections.defaultdict(dict)
    for r in got:
        by[(r.vec_id, r.deviation)][r.component] = r
    signs = None
    for i, x in kept:
        mine = by[(i, sum((n * int(c) - int(t)) ** 2 for c, t in zip(x, s)))]
        want = (np.array(x) - s / n) @ vectors[:, :16] / np.sqrt(values[:16])
        have = np.array([mine[k].whitened for k in range(1, 17)])
        if signs is None:
            signs = np.sign(have * want)
        assert np.allclose(have * signs, want, atol=1e-8)
        assert np.allclose([mine[k].explained for k in range(1, 17)], values[:16] / np.trace(v), rtol=1e-9)


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whitened(same).collect()) == [(i, k, 1, 0, None, None, None) for i in range(3) for k in (1, 2)]
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whitened(flat).collect()}
    assert abs(got[(2, 1)].whitened - 1.5**0.5) < 1e-12 and got[(2, 2)].whitened is None and got[(0, 1)].explained == 1 and got[(0, 2)].explained == 0
    assert whitening.whitened(same.limit(0)).count() == 0
    wide = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=30).tolist()) for i in range(90)], "vec_id long, embedding array<double>")
    assert whitening.whitened(wide, components=3).first().identity_error < 1e-9  # more pairs than one aggregation takes


def plain_scores(rows):
    """Counts in dictionaries, weights by expectation-maximisation over every held-out token."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [[w.translate(low) for w in words(r[1])] + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]

    def counted(texts):
        c = [collections.Counter() for _ in range(3)]
        for t in texts:
            p = ["<s>", "<s>", *t]
            for i in range(2, len(p)):
                for k in range(3):
                    c[k][tuple(p[i - k : i + 1])] += 1
        return c, sum(map(len, texts)), len(texts)

    full, total, n_docs = counted([t for t, h in zip(texts, held) if not h])
    classes = len(full[0]) + 1

    def estimates(t, c, total, n_docs):
        p = ["<s>", "<s>", *t]
        for i in range(2, len(p)):
            of = [total, n_docs if p[i - 1] == "<s>" else c[0][(p[i - 1],)], n_docs if p[i - 1] == "<s>" else c[1][tuple(p[i - 2 : i])]]
            ml = [c[k][tuple(p[i - k : i + 1])] / of[k] if of[k] > 0 else 0.0 for k in range(3)]
            bucket = max(k * 32 + int(math.log2(of[k])) if of[k] > 0 and k else 0 for k in range(3))
            yield bucket, ml

    binned = lambda v: 2.0 ** -(np.rint(-interpolation.BINS * np.log2(v)) / interpolation.BINS) if v > 0 else 0.0
    seen = collections.Counter()
    for t, h in zip(texts, held):
        if not h:
            own = counted([t])[0]
            rest = [full[k] - own[k] for k in range(3)]
            seen.update((b, *map(binned, ml)) for b, ml in estimates(t, rest, total - len(t), n_docs - 1))
    even = interpolation._even(3, total > 0)
    weights, before = even, None
    for _ in range(30 if total else 0):
        sums, n, now = even.copy(), np.ones(len(even)), 0.0
        for (b, *ml), k in seen.items():
            p = weights[b] * np.array([1 / classes, *ml])
            sums[b] += k * p / p.sum()
            n[b] += k
            now += k * math.log(p.sum())
        weights = sums / n[:, None]
        if before is not None and now - before <= 1e-6 * abs(before):
            break
        before = now
    out = []
    for r, t, h in zip(rows, texts, held):
        c1 = [full[0][(w,)] for w in t]
        base = sum(math.log10((c + 0.1) / (total + 0.1 * classes)) for c in c1)
        score = sum(math.log10(weights[b] @ np.array([1 / classes, *ml])) for b, ml in estimates(t, full, total, n_docs))
        out.append((r[0], h, len(t), sum(c > 0 for c in c1), total, base, score))
    return out


def _same_scores(got, want):
    key = lambda r: (str(r[0]), *r[1:5], round(r[5], 4), round(r[6], 4))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7) for x, y in zip(got, want) for a, b in zip(x[5:], y[5:]))


@pytest.mark.parametrize("small", [False, True])
def test_scored_texts(spark, monkeypatch, small):
    if small:  # several chunks and ranges of hashes; no document is cut
        monkeypatch.setattr(interpolation, "RANGE_ENTRIES", 3000)
    rows = awkward_rows(4) + [(2000 + i, f"the cat number {i % 7} sat on the Mat {i}", "en", "s", 1, 1, 1, "h", 0.1) for i in range(60)]
    got = interpolation.scored_texts(documents(spark, rows).repartition(4 if small else 1)).collect()
    want = plain_scores(rows)
    _same_scores(got, want)
    held = [r for r in got if r.held_out and r.n_tokens < 20 and r.doc_id >= 2000]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scored_texts_cut_a_long_document(spark, monkeypatch):
    """What is counted and known does not depend on where documents are cut; only what is deleted for the weights does."""
    monkeypatch.setattr(interpolation, "learned", lambda histogram, classes, any_words: interpolation._even(3, any_words))
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(3000)), "en", "s", 1, 1, 1, "h", 0.1) for i in range(1, 13)]
    whole = {r.doc_id: r for r in interpolation.scored_texts(documents(spark, rows)).collect()}
    monkeypatch.setattr(interpolation, "CHUNK_TOKENS", 700)
    cut = {r.doc_id: r for r in interpolation.scored_texts(documents(spark, rows)).collect()}
    assert len(cut) == 12 and all(whole[i][:5] == cut[i][:5] and math.isclose(whole[i].base_score, cut[i].base_score, rel_tol=1e-9) and math.isclose(whole[i].score, cut[i].score, rel_tol=1e-9) for i in whole)


def test_scored_texts_edges(spark):
    assert interpolation.scored_texts(documents(spark, [])).count() == 0
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = interpolation.scored_texts(documents(spark, [(only, "a b", None, None, None, None, None, None, None)])).collect()
    assert [tuple(r) for r in got] == [(only, True, 3, 0, 0, 0.0, 0.0)]


def test_tokens_of_long_texts():
    """A text is hashed alike in runs and at once, with words longer than a run too."""
    text = ("Word é " * 5 + "x" * (1 << 16) + "y\t") * 3 + "Z" * (3 << 20) + " end " + "q" * 70_000
    alone, n = interpolation.tokens_of(pa.array([text * 2]))
    again = [interpolation.tokens_of(pa.array([w, "a"]))[0][0] for w in words(text)]
    assert n.tolist() == [2 * len(words(text)) - 1 + 1] or n.tolist() == [len(words(text * 2)) + 1]
    want = [interpolation.tokens_of(pa.array([w, "a"]))[0][0] for w in words(text * 2)]
    assert alone[:-1].tolist() == want and len(again) == len(words(text))
    assert interpolation.tokens_of(pa.array(["AB", "ab", None, ""]))[0].tolist()[0] == interpolation.tokens_of(pa.array(["ab"]))[0][0]
    a = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (interpolation.unpacked(interpolation.packed(a)) == a).all() and len(interpolation.unpacked(interpolation.packed(a[:0]))) == 0
