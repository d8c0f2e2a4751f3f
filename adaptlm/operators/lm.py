"""Term counts and sparse vectors as rows (key, term, weight), and the language-model algebra on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.functions.porter import stemmed
from adaptlm.functions.text import is_ascii, plain_tokens
from adaptlm.sources.tables import MOST_SENT, checkpointed, sent

#: Pairs of a query and a document that one task adds up (about 400 bytes each with their sort).
TASK_PAIRS = 500_000
#: Keys of a block of pair_cosines(), about, and blocks that few keys are cut to; a task holds the pairs of two blocks.
BLOCK_KEYS, LEAST_BLOCKS = 2000, 8
#: A term is a column of a matrix if at least one of so many pairs of two blocks shares it; columns of a matrix and products that are made at once.
DENSE, COLUMNS, PRODUCTS = 64, 512, 2_000_000
#: Keys in the array of a term at most.
MOST_ARRAY = 64


def first_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def term_counts(texts: DataFrame, key: str, text: str = "text", stem: bool = False, vocabulary: DataFrame | None = None) -> DataFrame:
    """key, term, tf; tokens with non-ASCII characters are skipped; vocabulary (term) closes the set of terms."""
    each = texts.select(key, F.explode(plain_tokens(F.col(text))).alias("term"))
    counts = each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    if stem:
        counts = stemmed(counts).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return counts if vocabulary is None else counts.join(vocabulary.select("term").distinct(), "term", "left_semi")


def index(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term_counts() of printable ASCII texts only, and of one text for each key, the first by its text."""
    plain = texts.where(is_ascii(F.col(text))).groupBy(key).agg(F.min(text).alias(text))
    return term_counts(plain, key, text)


def lengths(counts: DataFrame, key: str, weight: str = "tf") -> DataFrame:
    """key, length: the sum of a text's weights."""
    return counts.groupBy(key).agg(F.sum(weight).alias("length"))


def term_probs(by_term: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, count, prob) with one count added to each term (term, count), and (default_prob), one row, for terms not in the collection."""
    totals = by_term.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("unique"))
    probs = by_term.crossJoin(F.broadcast(totals)).select("term", "count", ((F.col("count") + 1) / (F.col("total") + F.col("unique"))).alias("prob"))  # totals is one row
    return probs, totals.select((1 / (F.col("total") + F.col("unique"))).alias("default_prob"))


def collection_probs(counts: DataFrame, weight: str = "tf") -> tuple[DataFrame, DataFrame]:
    """term_probs() of term counts (term, weight)."""
    return term_probs(counts.groupBy("term").agg(F.sum(weight).alias("count")))


def with_background(rows: DataFrame, probs: DataFrame, default: DataFrame, name: str = "p") -> DataFrame:
    """rows with the background probability of their term, the default where there is none."""
    return _background_of(rows.join(probs.select("term", F.col("prob").alias("_known")), "term", "left"), default, name)


def _background_of(rows: DataFrame, default: DataFrame, name: str) -> DataFrame:
    return rows.crossJoin(F.broadcast(default)).withColumn(name, F.coalesce("_known", "default_prob")).drop("_known", "default_prob")


def commonest(terms: DataFrame, size: Column | None = None, most: int | None = None, most_size: int = 2_000_000) -> DataFrame:
    """The terms (term, prob) that are likeliest, by quarters of powers of two: at most MOST_SENT, and of at most so much size in all."""
    size = F.lit(1) if size is None else size
    step = F.floor(F.log2("prob") * 4)
    bins = terms.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).orderBy(F.desc("step")).collect()  # a row for each quarter of a power of two
    n, total, least = 0, 0, None
    for b in bins:
        n, total = n + b["n"], total + b["size"]
        if b["step"] is None or n > (MOST_SENT if most is None else most) or total > most_size:
            break
        least = b["step"]
    return terms.where(F.lit(False) if least is None else step >= least)


def with_background_of_all(rows: DataFrame, probs: DataFrame, default: DataFrame, name: str = "p", most: int | None = None) -> DataFrame:
    """with_background() of many rows: the commonest terms of probs go to all tasks, and only the rows of the others are shuffled by their term."""
    head, _ = sent(commonest(probs, most=most).select("term", F.col("prob").alias("_known")), most)
    rare = rows.join(head, "term", "left_anti").join(probs.select("term", F.col("prob").alias("_known")), "term", "left")
    return _background_of(rows.join(head, "term").unionByName(rare), default, name)


def normalised(rows: DataFrame, key: str, weight: str = "weight", squared: bool = False) -> DataFrame:
    """Weights divided by their sum (or the root of the sum of squares) within a key; unchanged where that is not above 0."""
    w = F.col(weight)
    size = F.sum(w * w if squared else w).over(Window.partitionBy(key))
    return rows.withColumn("_s", F.sqrt(size) if squared else size).withColumn(weight, F.when(F.col("_s") > 0, w / F.col("_s")).otherwise(w.cast("double"))).drop("_s")


def truncated(rows: DataFrame, key: str, weight: str = "prob", most: int = 20, least: float = 0.001, mass: float = 1.0) -> DataFrame:
    """The heaviest terms of a key: at most `most`, none below `least`, none after the mass is reached (the one that crosses it stays). Weights equal to twelve digits are ties, by term."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round(weight, 12)), "term")
    before = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = rows.withColumns({"_rank": F.row_number().over(order), "_before": before})
    return ranked.where((F.col("_rank") <= most) & (F.col(weight) >= least) & (F.col("_before") < mass)).drop("_rank", "_before")


def interpolated(a: DataFrame, b: DataFrame, key: str, share: float, weight: str = "weight", b_once: bool = False) -> DataFrame:
    """key, term, share * a + (1 - share) * b.

    b_once: b has each key and term once. If a then has few keys, the rows of all other keys stay where they are, and only those of a's keys are added up.
    """
    a, b = a.select(key, "term", (F.col(weight) * share).alias(weight)), b.select(key, "term", (F.col(weight) * (1 - share)).alias(weight))
    added = lambda x: x.groupBy(key, "term").agg(F.sum(weight).alias(weight))
    if not b_once:
        return added(a.unionByName(b))
    keys, few = sent(a.select(F.col(key).alias("_key")).distinct())
    if not few:
        return added(a.unionByName(b))
    here = F.col(key).eqNullSafe(F.col("_key"))
    return added(a.unionByName(b.join(keys, here, "left_semi"))).unionByName(b.join(keys, here, "left_anti"))


def cosines(a: DataFrame, b: DataFrame, a_key: str, b_key: str, weight: str = "weight") -> DataFrame:
    """a_key, b_key, cosine of all pairs that share a term; others have 0 and no row."""
    left = a.select(F.col(a_key), "term", F.col(weight).alias("_a"))
    right = b.select(F.col(b_key), "term", F.col(weight).alias("_b"))
    dots = left.join(right, "term").groupBy(a_key, b_key).agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    na = left.groupBy(a_key).agg(F.sum(F.col("_a") * F.col("_a")).alias("_na"))
    nb = right.groupBy(b_key).agg(F.sum(F.col("_b") * F.col("_b")).alias("_nb"))
    return dots.join(na, a_key).join(nb, b_key).where("_na > 0 and _nb > 0").select(a_key, b_key, (F.col("_dot") / F.sqrt(F.col("_na") * F.col("_nb"))).alias("cosine"))


def mixture_cosines(rows: DataFrame, b: DataFrame, probs: DataFrame, default: DataFrame, a_key: str, b_key: str, share: float = 0.9, freq: str = "f", weight: str = "weight", most: int | None = None) -> DataFrame:
    """cosines() of the mixture() models of rows (a_key, term, freq) with b (b_key, term, weight).

    What b's keys have of a term is one array with a place for each key. Those of the commonest terms go to all tasks; the rows of other terms get
    theirs with their background, before the shuffle by a_key that the models take. So products are made and added up where a model is, and none
    of them is a row. With more than MOST_ARRAY keys in b the arrays would be long, and the two sides are joined by term.
    """
    weights = b.where(F.col(b_key).isNotNull()).select(b_key, "term", F.col(weight).cast("double").alias("_b"))
    norms, few = sent(weights.groupBy(b_key).agg(F.sqrt(F.sum(F.col("_b") * F.col("_b"))).alias("_nb")).where("_nb > 0"), MOST_ARRAY)
    if not few:
        model = mixture(with_background_of_all(rows, probs, default, most=most), a_key, freq, share=share).where("prob > 0")
        return cosines(model.withColumnRenamed("prob", "_b"), weights, a_key, b_key, "_b")
    places = norms.select(b_key, "_nb", (F.row_number().over(Window.orderBy(b_key)) - 1).alias("_i"))  # a row for each key, of which there are few
    places, _ = sent(places, MOST_ARRAY)
    n = max(1, places.count())
    # null where a key lacks the term, so that pairs that share no term have no sum
    of_term = weights.join(places, b_key).groupBy("term").agg(F.array(*(F.sum(F.when(F.col("_i") == i, F.col("_b") / F.col("_nb"))) for i in range(n))).alias("_of"))
    facts = checkpointed(probs.select("term", "prob").join(of_term, "term", "full"))
    head, _ = sent(commonest(facts.where("prob > 0"), F.lit(n), most), most)
    known = F.col("prob").alias("_known")
    rows = rows.select(a_key, "term", freq)
    common = rows.join(head.select("term", known), "term").select(a_key, "term", freq, "_known", F.lit(None).cast("array<double>").alias("_of"))
    rare = rows.join(head.select("term"), "term", "left_anti").join(facts, "term", "left").select(a_key, "term", freq, known, "_of")
    model = mixture(_background_of(common.unionByName(rare), default, "p"), a_key, freq, share=share, also=("_of",)).where("prob > 0")
    found = model.join(head.select("term", F.col("_of").alias("_head")), "term", "left").withColumn("_of", F.coalesce("_of", "_head"))
    sums = [F.sum(F.col("prob") * F.get("_of", F.lit(i))).alias(f"_{i}") for i in range(n)]
    dots = found.groupBy(a_key).agg(F.sum(F.col("prob") * F.col("prob")).alias("_na"), *sums)
    each = dots.select(a_key, "_na", F.posexplode(F.array(*(f"_{i}" for i in range(n)))).alias("_i", "_dot")).where("_dot IS NOT NULL")
    return each.join(places, "_i").select(a_key, b_key, (F.col("_dot") / F.sqrt("_na")).alias("cosine"))


def _dots(x: tuple, y: tuple, terms: int) -> np.ndarray:
    """[key of x, key of y]: sums of products of weights by term; x, y: number of keys, place of the key, term and weight of each entry.

    Terms that many keys have are products of narrow matrices, the entries of the others are multiplied one by one, a bounded number at a time.
    """
    (n, x_key, x_term, x_w), (m, y_key, y_term, y_w) = x, y
    out = np.zeros((n, m))
    x_many, y_many = np.bincount(x_term, minlength=terms), np.bincount(y_term, minlength=terms)
    pairs = x_many * y_many
    common = np.flatnonzero(pairs * DENSE >= n * m)
    for some in np.array_split(common, max(1, -(-len(common) // COLUMNS))):
        place = np.full(terms, -1)
        place[some] = np.arange(len(some))
        flat = lambda k, t, w, size: np.bincount((k * len(some) + place[t])[place[t] >= 0], w[place[t] >= 0], size * len(some)).reshape(size, len(some))
        if len(some):
            out += flat(x_key, x_term, x_w, n) @ flat(y_key, y_term, y_w, m).T
    rare = pairs > 0
    rare[common] = False
    kx, ky = np.flatnonzero(rare[x_term]), np.flatnonzero(rare[y_term])
    ky = ky[np.argsort(y_term[ky], kind="stable")]
    start = np.searchsorted(y_term[ky], np.arange(terms))
    many = y_many[x_term[kx]]
    ends = np.cumsum(many)
    for some in np.split(kx, np.searchsorted(ends, np.arange(PRODUCTS, ends[-1] if len(ends) else 0, PRODUCTS))):
        each = y_many[x_term[some]]
        left = np.repeat(some, each)
        right = ky[np.repeat(start[x_term[some]], each) + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)]
        np.add.at(out.reshape(-1), x_key[left] * m + y_key[right], x_w[left] * y_w[right])
    return out


def _block_pairs(rows: DataFrame, key: str, weight: str, block: int | None, found: Callable, names: tuple[str, str]) -> DataFrame:
    """What found makes of the cosines of each pair of blocks of keys, as rows (two keys, named so, and cosine).

    found(x, y, cosine, shared, same): keys of two blocks, [x, y] their cosines and whether they share a term, and whether both are one block.
    A key with its vector is one row, shuffled once for each block; a pair of blocks is one task's work.
    """
    kind = dict(rows.dtypes)[key]
    w = F.col(weight).cast("double")
    x = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.sqrt(F.sum(w * w)).alias("n"), F.collect_list(F.struct("term", w.alias("w"))).alias("v"))
    x = checkpointed(x.select("k", "n", F.col("v.term").alias("terms"), F.col("v.w").alias("w")))
    n = x.count()
    blocks = max(1, -(-n // (block or BLOCK_KEYS)), 0 if block else min(LEAST_BLOCKS, -(-n // 250)))
    mine, others = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"), F.sequence(F.lit(0), F.lit(blocks - 1))
    x = x.select("*", mine.alias("_m"), F.explode(others).alias("_o"))
    dealt = x.select(F.least("_m", "_o").alias("i"), F.greatest("_m", "_o").alias("j"), (F.col("_m") > F.col("_o")).cast("int").alias("side"), "k", "n", "terms", "w")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, blocks * (blocks + 1) // 2)
    dealt = dealt.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "side")

    def entries(t: pa.Table, terms: np.ndarray, lo: int, hi: int, ends: np.ndarray, w: np.ndarray) -> tuple:
        a, b = ends[lo], ends[hi]
        return hi - lo, np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), terms[a:b], w[a:b]

    def of_pair(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(group).combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(t.column("terms")).to_numpy())])
        coded = pc.dictionary_encode(pc.list_flatten(t.column("terms")).combine_chunks(), null_encoding="encode")
        codes, w = coded.indices.to_numpy().astype(np.int64), pc.list_flatten(t.column("w")).to_numpy()
        same = t.column("i")[0] == t.column("j")[0]
        cut = t.num_rows if same else int((t.column("side").to_numpy() == 0).sum())
        lo = (0, cut), (0, cut) if same else (cut, t.num_rows)
        if 0 in (lo[0][1] - lo[0][0], lo[1][1] - lo[1][0]):
            return
        x, y = (entries(t, codes, *e, ends, w) for e in lo)
        dots, size = _dots(x, y, len(coded.dictionary)), t.column("n").to_numpy()
        ones = lambda e: (*e[:3], np.ones(len(e[3])))
        shared = dots > 0 if (w > 0).all() else _dots(ones(x), ones(y), len(coded.dictionary)) > 0
        dots /= size[lo[0][0] : lo[0][1], None] * size[None, lo[1][0] : lo[1][1]]
        keys = t.column("k").combine_chunks()
        yield from (pa.RecordBatch.from_arrays(list(c), names=[*names, "cosine"]) for c in found(keys[lo[0][0] : lo[0][1]], keys[lo[1][0] : lo[1][1]], dots, shared, same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = np.stack([batch.column(k).to_numpy() for k in range(2)], 1)
            cuts = [0, *(np.flatnonzero((here[1:] != here[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if group and at != here[a].tolist():
                    yield from of_pair(group)
                    group = []
                at = here[a].tolist()
                group.append(batch.slice(a, b - a))
        if group:
            yield from of_pair(group)

    return dealt.mapInArrow(run, f"{names[0]} {kind}, {names[1]} {kind}, cosine double")


def pair_cosines(rows: DataFrame, key: str, weight: str = "weight", block: int | None = None) -> DataFrame:
    """a, b, cosine of all pairs a < b of keys that share a term.

    Keys are dealt to blocks; a pair of blocks is one task's work, so pairs are made, added up and divided where they are, and what is shuffled
    are the keys' vectors, once for each block. The result grows with the square of the keys, what a task holds does not.
    """

    def found(x: pa.Array, y: pa.Array, cosine: np.ndarray, shared: np.ndarray, same: bool) -> Iterator[tuple]:
        for lo in range(0, len(x), 64):
            i, j = np.nonzero(np.triu(shared[lo : lo + 64], lo + 1) if same else shared[lo : lo + 64])
            yield x.take(pa.array(i + lo)), y.take(pa.array(j)), pa.array(cosine[i + lo, j])

    return _block_pairs(rows, key, weight, block, found, ("k1", "k2")).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "cosine")


def pair_cosines_within(rows: DataFrame, group: str, key: str, weight: str = "weight") -> DataFrame:
    """group, a, b, cosine of the pairs a < b of keys of one group that share a term: rows (group, key, term, weight) meet by group and term, so no pair of two groups is made."""
    w = F.col(weight).cast("double")
    norm = rows.groupBy(group, key).agg(F.sqrt(F.sum(w * w)).alias("_n"))
    x = rows.join(norm, [group, key]).select(group, "term", F.col(key).alias("a"), w.alias("_a"), F.col("_n").alias("_na"))
    x = checkpointed(x)
    y = x.select(group, "term", F.col("a").alias("b"), F.col("_a").alias("_b"), F.col("_na").alias("_nb"))
    dots = x.join(y, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"), F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))
    return dots.select(group, "a", "b", (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("cosine"))


def _millionths(v: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in millionths, halves up, as round() to six digits gives them: by their decimal digits where those are near a half."""
    out = np.floor(v * 1e6 + 0.5)
    for at in zip(*np.nonzero(np.abs(v * 1e6 + 0.5 - np.rint(v * 1e6 + 0.5)) < 1e-6)):
        out[at] = int(Decimal(repr(float(v[at]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out.astype(np.int64)


def likest(rows: DataFrame, key: str, other: str, most: int, least: float, weight: str = "weight", block: int | None = None) -> DataFrame:
    """key, other, cosine (to six digits): of each key the others of the highest such cosines, ties by the smaller other, none below least.

    These are at most `most` for each pair of a key and a block (see pair_cosines()), among which the key's own `most` are, so all pairs are looked at and few become rows. Weights are above 0.
    """
    def best(x: pa.Array, y: pa.Array, near: np.ndarray) -> tuple:
        rank = np.empty(len(y), np.int64)
        rank[pc.sort_indices(y).to_numpy()] = np.arange(len(y))
        turn = np.where(near >= max(least * 1e6, 0), near * len(y) + (len(y) - 1 - rank), -1)
        top = np.argpartition(turn, len(y) - most, 1)[:, len(y) - most :] if most < len(y) else np.broadcast_to(np.arange(len(y)), turn.shape)
        i, k = np.nonzero(np.take_along_axis(turn, top, 1) >= 0)
        j = top[i, k]
        return x.take(pa.array(i)), y.take(pa.array(j)), pa.array(near[i, j] / 1e6)

    def found(x: pa.Array, y: pa.Array, cosine: np.ndarray, shared: np.ndarray, same: bool) -> Iterator[tuple]:
        near = _millionths(cosine)
        near[~shared] = -1
        if same:
            np.fill_diagonal(near, -1)
        yield best(x, y, near)
        if not same:
            yield best(y, x, near.T)

    return _block_pairs(rows, key, weight, block, found, (key, other))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is empty or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def mixture(rows: DataFrame, key: str, freq: str = "f", background: str = "p", share: float = 0.9, also: tuple[str, ...] = ()) -> DataFrame:
    """key, term, prob (and columns to be kept): the model that with the background (of the given share) makes the frequencies likeliest.

    In closed form: by rising background/frequency ratio, terms are taken while their
    ratio is below what the terms so far support; the rest get 0.
    """
    ratio = (1 - share) / share
    r = rows.where(F.col(freq) > 0).withColumn("_r", F.col(background) / F.col(freq))
    order = Window.partitionBy(key).orderBy("_r", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumns({"_f": F.sum(freq).over(order), "_p": F.sum(background).over(order)})
    stop = F.when(F.lit(ratio) + F.col("_p") <= F.col("_f") * F.col("_r"), 1).otherwise(0)
    r = r.withColumn("_stop", F.max(stop).over(order))
    whole = Window.partitionBy(key)
    kept = F.col("_stop") == 0
    scale = F.sum(F.when(kept, F.col(freq))).over(whole) / (1 + F.sum(F.when(kept, F.col(background))).over(whole) / ratio)
    r = r.withColumn("_scale", scale)
    q = F.when(kept, F.col(freq) / F.col("_scale") - F.col(background) / ratio).otherwise(0.0)
    return r.select(key, "term", q.alias("prob"), *also)


def kl_scores(query: DataFrame, docs: DataFrame, probs: DataFrame, default: DataFrame, q_key: str, d_key: str, prior: float, q_weight: str = "weight", d_weight: str = "tf", d_lengths: DataFrame | None = None, most_sent: int | None = None) -> DataFrame:
    """q_key, d_key, score of documents that share a term with the query: log likelihood under Dirichlet smoothing, per query term.

    d_lengths (d_key, length): the sums of the documents' weights, where they are known. Queries within the bound of sent rows go to all tasks: then only the rows of
    terms that a query has are shuffled, once and by document, and pairs of a query and a document are made and added up where the document is.
    """
    q, few = sent(with_background(query.select(q_key, "term", F.col(q_weight).alias("_w")), probs, default, "_p"), most_sent)
    q_facts = q.groupBy(q_key).agg(F.sum("_w").alias("_qlen"), F.sum(F.col("_w") * F.ln("_p")).alias("_base"))
    d_len = (lengths(docs, d_key, d_weight) if d_lengths is None else d_lengths).select(d_key, F.col("length").alias("_dlen"))
    rows = docs.select(d_key, "term", F.col(d_weight).alias("_tf"))
    gain = F.sum(F.col("_w") * F.ln(1 + F.col("_tf") / prior / F.col("_p"))).alias("_gain")
    score = (F.col("_gain") + F.col("_base")) / F.col("_qlen") + F.ln(F.lit(prior) / (F.col("_dlen") + prior))
    if not few:
        overlap = q.join(rows, "term").groupBy(q_key, d_key).agg(gain)
        return overlap.where("_gain > 0").join(q_facts, q_key).join(d_len, d_key).select(q_key, d_key, score.alias("score"))
    # a merge by document, which leaves the rows dealt by document, so that adding up a document's pairs needs no shuffle of them; the parts do not grow with the table
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-d_len.count() * q_facts.count() // TASK_PAIRS))
    here = rows.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").repartition(parts, d_key).join(d_len.hint("merge"), d_key)
    overlap = here.join(q, "term").groupBy(d_key, "_dlen", q_key).agg(gain).where("_gain > 0")
    return overlap.join(F.broadcast(q_facts), q_key).select(q_key, d_key, score.alias("score"))


def top(rows: DataFrame, key: str, tie: str, most: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The best rows of a key with their rank; scores equal to so many digits are ties, by the tie column."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score, digits)), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
