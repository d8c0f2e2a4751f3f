import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from adaptlm.llm import mixing, neardup, packing, quality, rules, suffixes, words
from tests.llm.common import awkward_rows, documents
from tests.llm.common import words as split_words

TOKENIZER = __import__("public_tokenizers").path("byte_bpe_50k.json")


def shingles(text):
    w = split_words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_word_hashes_agree_with_words():
    texts = [r[1] for r in awkward_rows()]
    data, offsets = words.text_bytes(pa.array(texts, pa.string()))
    h, counts = words.word_hashes(data, offsets, lower=False)
    names = {}
    for t, a, b in zip(texts, counts[:-1], counts[1:]):
        w = split_words(t)
        assert len(w) == b - a
        for x, y in zip(w, h[a:b]):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("seed", range(20))
def test_suffix_ranks(seed):
    rng = np.random.default_rng(seed)
    t, depth = rng.integers(1, 4, rng.integers(1, 70)), int(rng.choice([3, 9, 20, 100]))
    r, s = suffixes.suffix_ranks(t, depth), t.tolist()
    for i in range(len(s)):
        for j in range(i):
            a, b = s[i : i + depth], s[j : j + depth]
            assert a == b if r[i] == r[j] else a == b or (r[i] < r[j]) == (a < b)


@pytest.mark.parametrize("most", [200, 1])
def test_repeated_spans(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    rows = [r for r in awkward_rows() if len(r[1] or "") < 50_000]
    texts = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = collections.Counter()
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(r[0], int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = suffixes.repeated_spans(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    assert suffixes.repeated_spans(documents(spark, [])).count() == 0


def test_near_duplicates(spark):
    rows = awkward_rows()
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    want = collections.Counter()
    for i, r in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        component = min(ids) if ids and sets[i] else r[0]
        want[(r[0], len(sets[i]), component, r[0] == component)] += 1
    got = neardup.near_duplicates(documents(spark)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    once = neardup.one_of_each(documents(spark)).collect()
    assert len(once) == len({find(i) for i in range(len(rows))})


def test_near_duplicates_in_one_bucket_with_an_unlike_centre(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([f"v{k}x{i}" if i % 9 == 0 and i < 9 * 7 * (k % 5) else w for i, w in enumerate(base)]) for k in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, [(i, t, "en", "s", 1, 1, 1, "h", 0.1) for i, t in enumerate(texts)])).collect()}
    sets = [shingles(t) for t in texts]
    for i in range(40):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                assert got[i] == got[j]


def test_near_duplicates_among_many_unlike_sets_of_a_bucket(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    base = [f"w{i}" for i in range(900)]
    texts = []
    for k in range(60):  # letters of one form: two of a kind are alike, those of two kinds are not
        at = r.sample(range(0, 900, 5), 28)
        for side in range(2):
            own = {at[j]: f"k{k}x{j}" for j in range(4)} | {at[j]: f"k{k}s{side}x{j}" for j in range(4 + 12 * side, 16 + 12 * side)}
            texts.append(" ".join(own.get(i, w) for i, w in enumerate(base)))
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want, before = list(range(120)), None
    while want != before:
        before = list(want)
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert len(near) >= 60 and len(set(want)) > 50
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(documents(spark, [(i, t, "en", "s", 1, 1, 1, "h", 0.1) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(120)] == want


def test_bitmaps_drop_no_alike_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = []
    for k in range(120):  # sizes from 60 to 900, so that bitmaps of several lengths meet
        size = int(rng.integers(60, 900))
        sets.append(np.unique(np.concatenate([base[:size], rng.integers(0, 2**63, int(rng.integers(0, size // 4 + 1)), dtype=np.uint64)])))
    n, root, side = np.array([len(s) for s in sets]), np.arange(120) // 2, np.arange(120) % 2
    for two in (False, True):
        i, j, _ = neardup.maybe_alike(n, root, side, two, [neardup.bitmap(s) for s in sets], 75)
        got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        assert len(got) == len(i)
        alike = set()
        for a in range(120):
            for b in range(a + 1, 120):
                c = len(np.intersect1d(sets[a], sets[b]))
                if root[a] != root[b] and not (two and side[a] == side[b]) and 100 * c >= 75 * (n[a] + n[b] - c):
                    alike.add((a, b))
        assert alike and alike <= got


def test_signature_of_small_sets_agrees():
    rng = np.random.default_rng(0)
    same = 0.0
    for _ in range(300):
        a = rng.integers(0, 2**63, 40, dtype=np.uint64)
        b = np.unique(np.concatenate([a[:34], rng.integers(0, 2**63, 6, dtype=np.uint64)]))
        same += (neardup.signature(np.unique(a)) == neardup.signature(b)).mean() / 300
    assert abs(same - 34 / 46) < 0.05


def test_rules(spark):
    rows = awkward_rows() + [(2000 + i, "shared line of nine words is here again today\n" + " ".join(f"u{i}x{k}" for k in range(30)), "en", "big", 1, 1, 1, "h", 0.1) for i in range(30)]
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = split_words(t)
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {p for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if split_words(x)]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)] += 1
    got = rules.quality_rules(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    shared = [r for r in got if r.doc_id is not None and r.doc_id >= 2000]
    assert all(r.n_removed_lines == 1 and r.n_kept_words == 30 and r.kept for r in shared)
    strict = {r.doc_id: r.kept for r in rules.quality_rules(documents(spark, rows), max_lost=0.2).collect()}
    assert not strict[2000]
    assert rules.quality_rules(documents(spark, [])).count() == 0


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}, {"a": 5, "b": 2, None: 1}, 300, 3) == {"a": 187.5, "b": 75.0, None: 37.5}
    t = mixing.targets({"a": 10, "b": 200, "c": 90}, {"a": 5, "b": 2, "c": 1}, 300, 3)
    assert t["a"] == 30 and t["b"] == 180 and t["c"] == 90


def es_keys(rows, weight, seed=7):
    """Exponential keys of rows (doc_id, text) by brute force."""
    import xxhash

    out = []
    for (i, t), w in zip(rows, weight):
        h = xxhash.xxh64(np.int32(seed).tobytes(), seed=42).intdigest()
        for v in (i, xxhash.xxh64((t or "").encode(), seed=42).intdigest()):
            h = h if v is None else xxhash.xxh64(np.array([v], np.uint64 if v >= 0 else np.int64).tobytes(), seed=h).intdigest()
        out.append(-np.log(((h >> 11) + 0.5) / 2**53) / w)
    return out


class _ByLength:
    """A stand-in for the quality model that takes no word twice."""

    def score(self, x):
        return 1 / (1 + x[:, 0])


@pytest.mark.parametrize("model", [None, _ByLength()])
def test_mix(spark, monkeypatch, model):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    docs, rows = documents(spark), awkward_rows()
    m = mixing.mix(docs, model).collect()
    again = mixing.mix(docs.repartition(3), model).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, m)) == sorted(map(key, again)) and len(m) == len(rows)
    sizes = [len(split_words(r[1])) for r in rows]
    weight = np.ones(len(rows)) if model is None else np.maximum(model.score(quality.features(pa.array([r[1] for r in rows], pa.string()))), 0.01)
    keys = es_keys([r[:2] for r in rows], weight)
    total = collections.Counter()
    for r, n in zip(rows, sizes):
        total[r[3]] += n
    goal = mixing.targets(total, mixing.in_turn(list(total)), sum(sizes), 3.0)
    want = collections.Counter()
    for source, size in total.items():
        epochs = int(goal[source] // size) if size else 0
        left = round(goal[source]) - epochs * size
        for k in sorted((k for k in range(len(rows)) if rows[k][3] == source), key=lambda k: (keys[k], rows[k][0] is not None, rows[k][0] or 0)):
            rest = min(sizes[k], max(0, left))
            left -= sizes[k]
            want[(rows[k][0], source, sizes[k], size, epochs * sizes[k] + rest)] += 1
    assert collections.Counter((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in m) == want
    assert all(abs(r.target - goal[r.source]) < 1e-6 and r.taken <= 3 * r.size for r in m)
    texts = mixing.mixed_documents(docs, ("doc_id", "text", "source", "n_chars"), model).collect()
    assert sum(len(split_words(r.text)) for r in texts) == sum(r.taken for r in m) and all(r.n_chars == len(r.text) for r in texts)
    known = collections.defaultdict(set)
    for r in rows:
        known[r[0]].add(r[1] or "")
    assert all(any(t.startswith(r.text) for t in known[r.doc_id]) for r in texts)  # whole or cut at the end, line breaks kept
    cut = [r for r in texts if r.text not in known[r.doc_id]]
    assert len(cut) <= len(total) and len(texts) > 0
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mixed_documents(documents(spark, [])).count() == 0


def plain_round_robin(totals, window, weights):
    """Tokens of each source in each window: a round-robin that carries each source's deficit, and gives what rounding leaves to the largest deficits."""
    left, deficit, out = np.array(totals, float), np.zeros(len(totals)), []
    while left.sum() > 0:
        room, sent = min(window, left.sum()), np.zeros(len(totals))
        while room > sent.sum():
            active = left > sent
            rate = np.where(active, weights, 0.0)
            rate = rate / rate.sum() if rate.sum() > 0 else active * left / (active * left).sum()
            deficit += rate * (room - sent.sum())
            give = np.minimum(np.floor(np.maximum(deficit, 0) + 1e-9), left - sent)
            if not give.any():
                give[np.flatnonzero(active)[np.argmax(deficit[active])]] = 1
            for s in np.argsort(-deficit):
                give[s] = min(give[s], room - sent.sum() - give[np.argsort(-deficit)[: list(np.argsort(-deficit)).index(s)]].sum())
            give = np.maximum(give, 0)
            sent, deficit = sent + give, deficit - give
            deficit = np.where(left > sent, deficit, 0)
        left -= sent
        out.append(sent)
    return np.array(out)


@pytest.mark.parametrize("weights", [None, [1, 5, 1, 1, 0.5, 2.0]])
def test_schedule_is_near_a_plain_deficit_round_robin(weights):
    totals = np.array([4000, 300, 1, 0, 77, 900])
    s = packing.Schedule(totals, 64, None if weights is None else np.array(weights, float))
    plain = np.cumsum(plain_round_robin(totals, 64, totals.astype(float) if weights is None else np.array(weights, float)), 0)
    mine = s.sent_before(np.arange(1, len(plain) + 1))
    assert (mine[-1] == totals).all() and (plain[-1] == totals).all()
    assert np.abs(mine - plain).max() <= len(totals)


@pytest.mark.parametrize("weights", [None, [1, 5, 1, 1, 0, 2.0]])
def test_schedule_is_deficit_round_robin(weights):
    totals = np.array([40_00, 300, 1, 0, 77, 900])
    s = packing.Schedule(totals, 64, None if weights is None else np.array(weights, float))
    order = [k for _, k, _ in sorted((float(s.due(k, np.array([j]))[0]), k, j) for k in range(6) for j in range(totals[k]))]
    w = np.arange(0, len(order) // 64 + 2)
    for i, c in zip(w, s.sent_before(w)):
        assert (c == np.bincount(order[: 64 * i], minlength=6)).all()
    if weights is None:  # what a source has been sent is within one token of its quanta, but for others' rounding
        c = s.sent_before(w[:-2])
        assert np.abs(c - np.outer(w[:-2] * 64, totals / totals.sum())).max() <= 3


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    rows = awkward_rows()
    want = collections.defaultdict(list)
    for r in rows:
        want[r[0]].append([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1])
    pieces = packing.pack(documents(spark), TOKENIZER, window=256).collect()
    crcs = {(r.doc_id, r.sequence_id, r.offset): r.ids_crc32 for r in packing.pack_digests(documents(spark), TOKENIZER, window=256).collect()}
    seqs, docs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == crcs[p.doc_id, p.sequence_id, p.offset] and len(p.ids) == 4 * p.length
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
    for i in seqs:
        assert [o for o, _ in sorted(seqs[i])] == np.cumsum([0, *(n for _, n in sorted(seqs[i]))])[:-1].tolist()
    full = [sum(n for _, n in seqs[i]) for i in sorted(seqs)]
    assert sorted(seqs) == list(range(len(seqs))) and set(full[:-1]) <= {256} and sum(full) == sum(len(x) for v in want.values() for x in v)
    for i, texts in want.items():
        if len(texts) == 1:
            parts = sorted(docs[i], key=lambda p: p.start)
            assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == texts[0] and parts[0].doc_tokens == len(texts[0])
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0


def test_more_rows_than_the_bound_are_not_sent(spark, tmp_path, monkeypatch):
    from adaptlm.llm import shared

    path = f"file://{tmp_path}/keys"
    spark.range(50).selectExpr("struct(id as f, id as r) as rid").write.parquet(path)
    keys = spark.read.parquet(path)
    rows = spark.range(200).selectExpr("struct(id as f, id as r) as rid", "id")
    for most, how in ((50, "BroadcastHashJoin"), (49, "SortMergeJoin")):
        monkeypatch.setattr(shared, "MOST_SENT", most)
        for kind, n in (("inner", 50), ("left_anti", 150)):
            joined = rows.join(shared.sent(keys), "rid", kind)
            assert joined.count() == n and how in joined._jdf.queryExecution().executedPlan().toString()


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, e = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    for t in [*(r[1] or "" for r in awkward_rows()), "a  b", " a", "a ", "a \n b", "x\n\n y", "don't 've", "é　 a", "\x1c a b", "a\x85 b", "1 2 3   \t 4"]:
        assert np.frombuffer(e(t), e.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_encoder_takes_a_million_spaces():
    from tokenizers import Tokenizer

    r = np.random.default_rng(3)
    tok, e = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    # no 200 of them repeat in the second, so that the stage repeated_passages would leave it
    for t in ("a b" + " " * 1_100_000 + "c d", "a b" + "".join(np.array(list(" \t\n\r"))[r.integers(0, 4, 1_100_000)]) + "c d"):
        assert np.frombuffer(e(t), e.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_quality(spark):
    import random

    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    good = [(i, prose(r.randint(20, 200)), "en", "s", 1, 1, 1, "h", 0.1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + r.choice(["###", "$$$"]) for w in prose(80).split()), "en", "s", 1, 1, 1, "h", 0.1) for i in range(100)]
    docs = documents(spark, good + bad + awkward_rows()[:-1])
    labels = spark.createDataFrame([(x[0], 1) for x in good] + [(x[0], 0) for x in bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.scored(docs, model)
    assert out.columns[-3:] == ["held_out", "score", "predicted"] and out.count() == docs.count()
    rows = out.collect()
    for x in rows:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    held = {x.doc_id: x.predicted for x in rows if x.held_out}
    bad_ids = {b[0] for b in bad}
    assert all(held[i] == 0 for i in held if i in bad_ids)
    assert quality.scored(documents(spark, []), model).count() == 0
    none = quality.train(docs, labels.where("false"))
    assert none.score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5


def test_pair_interaction_is_learned():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_separator_scan(spark, tmp_path, block):
    from adaptlm.llm import separators

    rng = np.random.default_rng(2)
    want = set()
    for f, end in (("a", True), ("b", False), ("c", True)):
        lengths = [int(x) for x in rng.integers(0, 12, 9)] if f != "c" else [0, 0]
        ids = np.concatenate([np.append(rng.integers(0, 5, n), 9) for n in lengths] + ([] if end else [rng.integers(0, 5, 4)])).astype("<u2")
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes())
        want |= {(f"{f}.bin", i, n, True) for i, n in enumerate(lengths)} | (set() if end else {(f"{f}.bin", len(lengths), 4, False)})
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.bin").write_bytes(np.array([1, 9], "<u2").tobytes())
    want.add(("sub/a.bin", 0, 1, True))
    got = separators.scan(spark, f"file://{tmp_path}", 9, 2, block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_token_counts(spark):
    from tokenizers import Tokenizer

    from adaptlm.llm import separators

    tok = Tokenizer.from_file(TOKENIZER)
    tok.encode_special_tokens = True
    want = collections.Counter((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward_rows())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in separators.token_counts(documents(spark), TOKENIZER, 50256).collect()) == want
    assert separators.token_counts(documents(spark, []), TOKENIZER, 50256).count() == 0


def test_many_copies_of_one_text_that_are_unlike_each_other(spark):
    import random

    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base)]
    for k in range(60):
        copy = list(base)
        for _ in range(10):
            copy[r.randint(0, 399)] = f"c{k}x{r.random()}"
        texts.append(" ".join(copy))
    rows = [(i, t, "en", "s", 1, 1, 1, "h", 0.1) for i, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    alike = [100 * len(sets[0] & s) >= 75 * len(sets[0] | s) for s in sets]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(documents(spark, rows)).collect()}
    assert sum(alike) > 40 and all(got[i] == 0 for i, a in enumerate(alike) if a)


@pytest.mark.parametrize("pairs", [150, 1000])
def test_near_duplicates_of_a_shared_form(spark, pairs):
    # 850 words of all texts, 20 of a pair, 130 of its own, in runs: pairs are alike at 0.769, all others at 0.738
    form = " ".join(f"w{i}" for i in range(850))
    texts = [form + " " + " ".join(f"p{k // 2}x{i}" for i in range(20)) + " " + " ".join(f"t{k}x{i}" for i in range(130)) for k in range(2 * pairs)]
    a, b, c = (shingles(texts[k]) for k in (0, 1, 2))
    assert 100 * len(a & b) >= 75 * len(a | b) and 100 * len(a & c) < 75 * len(a | c)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(documents(spark, [(i, t, "en", "s", 1, 1, 1, "h", 0.1) for i, t in enumerate(texts)])).collect()}
    assert got == {i: i - i % 2 for i in range(2 * pairs)}


def test_row_keys_do_not_hang_on_how_files_are_cut(spark, tmp_path):
    from adaptlm.llm.shared import keyed

    path = f"file://{tmp_path}/t"
    spark.range(0, 4000, 1, 6).selectExpr("id AS doc_id", "repeat('w', 50) AS text").write.parquet(path)
    df, was = spark.read.parquet(path), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        one = {r.rid: r.doc_id for r in keyed(df, "doc_id").collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "12")
        two = {r.rid: r.doc_id for r in keyed(df.where("doc_id >= 0").select("doc_id"), "doc_id").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert one == two and len(one) == 4000
    # rows that an operator repeats or joins are written first
    assert len({r.rid for r in keyed(df.unionByName(df), "doc_id").collect()}) == 8000


def test_one_of_each(spark):
    rows = [r for r in awkward_rows() if r[0] is None or r[0] < 12]
    got = collections.Counter((r.doc_id, r.text) for r in neardup.one_of_each(documents(spark, rows), ("doc_id", "text")).collect())
    labels = collections.defaultdict(list)
    for r in neardup.near_duplicates(documents(spark, rows)).collect():
        labels[r.root].append(r.doc_id)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    want = collections.Counter()
    for ids in labels.values():
        first = min((i for i in ids if i is not None), default=None)
        want[(first, texts.get(first))] += 1
    assert got == want and sum(got.values()) == len(labels)


def _kept(texts, length=200):
    """Brute force of suffix-array dedup: n_removed, n_spans and what stays of each text."""
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize("most", [200, 3, 1])
def test_passages_that_many_documents_share_in_part(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage = prose(120)
    texts = []
    for k in range(400):  # parts of one passage, some with a letter changed, between words of their own
        a, b = sorted((r.randint(0, len(passage) - 1), r.randint(0, len(passage))))
        part = passage[a:b]
        if part and k % 3 == 0:
            i = r.randrange(len(part))
            part = part[:i] + "Z" + part[i + 1 :]
        texts.append(prose(6) + part + prose(5) + (part if k % 7 == 0 else ""))
    texts += ["ab" * 300, "ab" * 250 + "c", "x" * 900, "x" * 199, "x" * 200]
    got = {x.doc_id: x for x in suffixes.repeated_spans(documents(spark, [(i, t, "en", "s", 1, 1, 1, "h", 0.1) for i, t in enumerate(texts)])).collect()}
    for i, (n, spans, kept) in enumerate(_kept([t.encode() for t in texts])):
        assert (sum(s.end - s.start for s in got[i].spans), len(got[i].spans), got[i].kept) == (n, spans, kept)


def test_deduplicated(spark):
    rows = [r for r in awkward_rows() if len(r[1] or "") < 50_000]
    got = suffixes.deduplicated(documents(spark, rows), ("doc_id", "text", "source", "n_chars")).collect()
    want = [(r[0], kept.decode("utf-8", "ignore"), r[3]) for r, (_, _, kept) in zip(rows, _kept([(r[1] or "").encode() for r in rows]))]
    assert collections.Counter((r.doc_id, r.text, r.source, r.n_chars) for r in got) == collections.Counter((*w, len(w[1])) for w in want)
    assert suffixes.deduplicated(documents(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    line = "a line of more than nine words that many hold is here"
    body = lambda i: line + "\n" + " ".join(f"u{i}x{k}" for k in range(30))
    few = [(1, body(1), "en", "s", 1, 1, 1, "h", 0.1)] * 40 + [(i, body(i), "en", "s", 1, 1, 1, "h", 0.1) for i in range(2, 15)]
    got = rules.quality_rules(documents(spark, few)).collect()
    assert len(got) == len(few) and all(r.n_removed_lines == 0 and r.kept for r in got)
    many = few + [(None, body(i), "en", "s", 1, 1, 1, "h", 0.1) for i in range(20)]
    got = rules.quality_rules(documents(spark, many)).collect()
    assert len(got) == len(many) and all(r.n_removed_lines == 1 and r.n_kept_words == 30 for r in got)


def test_clean_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b\nC  1\nd",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(rules.clean_text(F.col("text"), F.array(rules.line_hash(F.lit("c 7"))))).collect()]
    assert got == ["a b\nd", None, ""]


def best_cut(g, h, ridge):
    """Every split of the bins, by brute force."""
    whole = g.sum() ** 2 / (h.sum() + ridge)
    gains = [(g[:k].sum() ** 2 / (h[:k].sum() + ridge) + g[k:].sum() ** 2 / (h[k:].sum() + ridge) - whole, -k) for k in range(1, len(g))]
    return max(gains) if gains else (0.0, 0)


@pytest.mark.parametrize("seed", range(10))
def test_trees_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, ridge = int(rng.integers(2, 12)), 1.0
    g, h = rng.normal(size=n), rng.random(n) + 0.1
    gain, k = quality._cut(g, h, ridge)
    want = best_cut(g, h, ridge)
    assert abs(gain - want[0]) < 1e-9 and k == -want[1]
    parts = [(0, n)]
    for _ in range(2):
        best = max(((*best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] > 1e-9:
            _, k, a, b = best
            parts.remove((a, b))
            parts += [(a, a - k), (a - k, b)]
    tree = quality._tree(g, h, ridge)
    for a, b in parts:
        assert np.allclose(tree[a:b], g[a:b].sum() / (h[a:b].sum() + ridge))


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((300, 4))
    m = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.7).astype(float), rounds=10, pair_rounds=5)
    for row, s in zip(x, m.score(x)):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges)]
        z = m.intercept + sum(t[i] for t, i in zip(m.tables, at)) + sum(t[at[i], at[j]] for (i, j), t in m.pairs.items())
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-12


def test_only_members_with_a_name_that_no_other_has_go_before_the_shuffle(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, own = text(400), text(300)
    texts = [text(900) + passage, passage + text(700), text(2000), text(500) + own + text(50) + own, "x" * 1500, "", None, text(199), text(200)]
    rows = spark.createDataFrame([(k, t or "") for k, t in enumerate(texts)], "k long, text string").select(F.struct(F.lit(0).cast("long").alias("f"), F.col("k").alias("r")).alias("rid"), "text")
    plain = lambda df: sorted((x.rid.r, x.lo, x.n, x.name, x.twice) for x in df.collect())
    every = plain(suffixes.members(rows, 200))
    many = collections.Counter(x[3] for x in every)
    want = [x for x in every if many[x[3]] > 1 or any(y[4] for y in every if y[3] == x[3])]
    assert plain(suffixes._met(rows, 200)) == want and 0 < len(want) < len(every)
    assert {x[0] for x in want} >= {0, 1, 3, 4} and 2 not in {x[0] for x in want}
    assert suffixes._met(rows.limit(0), 200).count() == 0


def test_values_of_rows_are_sent_as_bits(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from adaptlm.llm import shared

    path = f"file://{tmp_path}/rows"
    spark.range(200_000).selectExpr("id", "concat('t', id) as text").repartition(3).write.parquet(path)
    rows = shared.keyed(spark.read.parquet(path), "id", "text")
    value = "CASE WHEN id % 7 = 0 THEN id % 6 WHEN id IN (0, 63, 64, 65535, 65536, 199999) THEN 1 ELSE 0 END"
    with shared.scratch(spark):
        keys = shared.written(rows.selectExpr("rid", f"{value} AS v", "rid.f % 100 AS file").where("v > 0 OR id % 5 = 0"), "keys", keep=True)
        for most, how in ((1 << 20, "BroadcastHashJoin"), (10, "SortMergeJoin")):
            monkeypatch.setattr(shared, "MOST_MARKS", most)
            found = shared.marked(rows, keys, "v", "file")
            assert found.where(f"v <> {value}").count() == 0 and found.count() == 200_000 and how in found._jdf.queryExecution().executedPlan().toString()
            assert found.where("v > 0").where(F.col("file") != F.col("rid.f") % 100).count() == 0
        assert shared.marked(rows, keys.limit(0), "v").agg(F.sum("v")).first()[0] == 0


def test_texts_of_near_copies_and_of_the_mix_are_not_shuffled(spark, tmp_path, monkeypatch):
    from adaptlm.llm import shared

    monkeypatch.setattr(shared, "MOST_SENT", 5)
    path = f"file://{tmp_path}/docs"
    documents(spark, [(i, f"{'same words of a copy' if i % 2 else 'own ' + str(i)} and more words to be shingles of {i // 4 if i % 2 else i}", "en", f"s{i % 3}", 9, 0, 0, "h", 0.5) for i in range(60)]).write.parquet(path)
    docs = spark.read.parquet(path)
    for made in (neardup.one_of_each(docs), mixing.mixed_documents(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert 0 < made.count() and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert neardup.one_of_each(docs).count() == 31  # the odd ones differ in the last word alone
