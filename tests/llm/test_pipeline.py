"""corpus_pipeline.run() on a small folder, stage by stage against brute force."""

import collections
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from adaptlm.llm import mixing, quality  # noqa: E402
from tests.llm.common import awkward_rows, words  # noqa: E402
from tests.llm.test_text_operators import _kept, shingles  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    passage = prose(70)
    rows = [(x[0], x[1], x[2], x[3], x[4]) for x in awkward_rows() if len(x[1] or "") < 50_000]
    good = [(2000 + i, prose(r.randint(30, 90)) + (" " + passage if i % 9 == 0 else ""), "en", r.choice(["s1", "s2", "s3"]), 1) for i in range(120)]
    near = [(4000 + i, t[1] + " more", *t[2:]) for i, t in enumerate(good[:30])]
    bad = [(6000 + i, " ".join(w + r.choice(["###", "$$$"]) for w in prose(60).split()), "en", "s1", 1) for i in range(60)]
    rows += good + near + bad
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(x[0], 1) for x in good] + [(x[0], 0) for x in bad] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(path + "/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    rows = lambda df: collections.Counter(tuple(r) for r in df.select(*columns).collect())
    before = rows(docs)
    # quality: those that the model does not reject
    model = quality.train(docs, spark.read.parquet(folder + "/labels.parquet"))
    kept = corpus_pipeline.written(named["quality"](spark, docs, folder), "t")
    verdict = {(r.doc_id, r.text): r.predicted for r in quality.scored(docs, model).collect()}
    assert kept.columns == columns and rows(kept) == collections.Counter({k: n for k, n in before.items() if verdict[k[0], k[1]] == 1})
    assert not any(r[0] is not None and 6000 <= r[0] for r in rows(kept)) and sum(r[0] is not None and 2000 <= r[0] < 2120 for r in rows(kept)) >= 118
    # near-duplicates: one of each component
    all_rows = sorted(rows(kept).elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingles(r[1]) for r in all_rows]
    group = list(range(len(all_rows)))
    for _ in range(4):
        for i in range(len(sets)):
            for j in range(i):
                c = len(sets[i] & sets[j])
                if c and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                    group[i] = group[j] = min(group[i], group[j])
    once = corpus_pipeline.written(named["near_duplicates"](spark, kept, folder), "t")
    assert once.columns == columns and rows(once) == collections.Counter(all_rows[i] for i in range(len(all_rows)) if group[i] == i)
    # repeated passages
    some = list(rows(once).elements())
    want = collections.Counter((r[0], (t := left.decode("utf-8", "ignore")), r[2], r[3], len(t)) for r, (_, _, left) in zip(some, _kept([(r[1] or "").encode() for r in some])))
    clean = corpus_pipeline.written(named["repeated_passages"](spark, once, folder), "t")
    assert clean.columns == columns and rows(clean) == want and sum(r[4] for r in want) < sum(len(r[1] or "") for r in some)
    # mixture: targets met to a word, no document above three times
    mixed = corpus_pipeline.written(named["mixture"](spark, clean, folder), "t")
    sizes, took, most = collections.Counter(), collections.Counter(), collections.Counter()
    for r in want.elements():
        sizes[r[3]] += len(words(r[1]))
    for r in rows(mixed).elements():
        took[r[3]] += len(words(r[1]))
        most[r[0]] += 1
    goal = mixing.targets(sizes, mixing.in_turn(list(sizes)), sum(sizes.values()), 3.0)
    assert mixed.columns == columns and all(abs(took[s] - goal[s]) <= 1 for s in sizes) and max(most.values()) <= 4
    # packing: every token once, sequences full
    pieces = named["packing"](spark, mixed, folder).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    tokens = collections.Counter()
    for r in rows(mixed).elements():
        tokens[r[0]] += len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1
    got, full = collections.Counter(), collections.Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        full[p.sequence_id] += p.length
    assert got == tokens and sorted(full) == list(range(len(full))) and all(full[s] == 2048 for s in range(len(full) - 1))
    # the whole run gives the same pieces
    assert sum(p.length for p in corpus_pipeline.run(spark, folder).collect()) == sum(p.length for p in pieces)


def test_stages_of_empty_tables(spark, folder):
    docs = spark.createDataFrame([], SCHEMA + ", rid long, size long, component_id long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
