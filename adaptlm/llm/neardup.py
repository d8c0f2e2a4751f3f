"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

A text's distinct shingle hashes are dealt to bins by their top bits and each bin
keeps its least hash; an empty bin borrows from a bin that its own fixed random
sequence visits first. Bands of bins are buckets. Equal sets are one set from the
start. In a bucket every set is compared with the bucket's centre alone, so a bucket of n
gives n - 1 pairs. As two alike sets may both be unlike a centre, later rounds take
other centres for the buckets that still hold several components: once the set with the
most links, else by chance. Where a bucket holds several components even then, every set outside its
largest component is compared with all others of another component, block by block, on bitmaps of the sets: the
bits that differ bound the unlike shingles from below, so no alike pair is dropped. All pairs are
confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adaptlm.llm.components import components
from adaptlm.llm.shared import keyed, marked, release, scratch, sent, slices, tidy, written
from adaptlm.llm.words import mixed, shingle_hashes, text_bytes, word_hashes

BINS, ROWS = 128, 4
#: Bits of a set's id that are the row's number in its file.
FILE_BITS = 40
_TRIES = 64
#: For each bin the bins that it asks in turn when it is empty.
_ASKED = (mixed(np.arange(BINS * _TRIES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, _TRIES)


def signature(distinct: np.ndarray) -> np.ndarray:
    """BINS values of a set given as sorted distinct 64-bit hashes, not empty."""
    bins = (distinct >> np.uint64(57)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = distinct[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        hits = full[_ASKED[empty]]
        donor = _ASKED[empty, hits.argmax(1)]
        none = ~hits.any(1)
        if none.any():  # very few full bins: the next full one in a circle
            at = np.flatnonzero(full)
            donor[none] = at[np.searchsorted(at, empty[none]) % len(at)]
        out[empty] = out[donor]
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each band of ROWS bins."""
    rows = sig.reshape(-1, ROWS)
    h = np.arange(len(rows), dtype=np.uint64)
    for k in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def signed(rows: DataFrame, width: int) -> DataFrame:
    """rid, doc_id, n_shingles, fp1, fp2 (128-bit fingerprint of the set), bands (array<long>) of rows rid, doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                data, offsets = text_bytes(part.column(2))
                h, ends = shingle_hashes(*word_hashes(data, offsets), width)
                n, fp, bands = [], [], []
                for a, b in zip(ends[:-1], ends[1:]):
                    if a == b:
                        n.append(0), fp.append((0, 0)), bands.append(None)
                        continue
                    s = np.unique(h[a:b])
                    n.append(len(s)), bands.append(band_hashes(signature(s)).view(np.int64))
                    x = mixed(s + np.uint64(len(s)))
                    fp.append((int(mixed(x.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]), int(np.bitwise_xor.reduce(mixed(x * np.uint64(0xD6E8FEB86659FD93))).view(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([x for x, _ in fp], pa.int64()), pa.array([x for _, x in fp], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["rid", "doc_id", "n_shingles", "fp1", "fp2", "bands"])
        tidy()

    return rows.mapInArrow(run, "rid struct<f:long,r:long>, doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def confirmed(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b: set ids) whose full sets have 100 * common >= percent * united. hashes: sid, set (sorted 64-bit hashes)."""
    left = pairs.join(hashes.select(F.col("sid").alias("b"), F.col("set").alias("b_set")), "b")
    both = left.join(hashes.select(F.col("sid").alias("a"), F.col("set").alias("a_set")), "a").select("a", "b", "a_set", "b_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            keep = []
            for k, a in enumerate(batch.column(0).to_pylist()):
                if a != at:
                    at, centre = a, np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                other = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                both_sizes = len(centre) + len(other)
                common = 0 if (100 + percent) * min(len(centre), len(other)) < percent * both_sizes else both_sizes - len(np.union1d(centre, other))
                keep.append(100 * common >= percent * (both_sizes - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidy()

    return both.mapInArrow(run, "a long, b long")


#: Sets of a crowded bucket in a block: about so many are compared with as many others at once.
BLOCK_SETS = 512


def bitmap(distinct: np.ndarray) -> bytes:
    """A bit for each of a set's hashes by its low bits: four to eight bits a hash, 512 to 65,536 in all, a power of two."""
    bits = 1 << min(max((4 * len(distinct) - 1).bit_length(), 9), 16)
    out = np.zeros(bits, bool)
    out[(distinct & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def hashed(texts: DataFrame, width: int) -> DataFrame:
    """sid, n (size of the set), set (its sorted 64-bit hashes), bits (its bitmap) of rows sid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                h, ends = shingle_hashes(*word_hashes(*text_bytes(part.column(1))), width)
                sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary())], names=["sid", "n", "set", "bits"])
        tidy()

    return texts.mapInArrow(run, "sid long, n long, set binary, bits binary")


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps [set, 64-bit word] at fewer words: the parts of a longer one are united, as its low bits are those of the shorter one."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), 1)


def maybe_alike(n: np.ndarray, root: np.ndarray, side: np.ndarray, two: bool, bits: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j of all pairs of two roots (if two, of side 0 with side 1) that sizes and bitmaps let reach percent, and how many bits differ in 1000 shingles.

    Sets of united size s (counted twice where common) reach percent only if at most s * (100 - percent) / (100 + percent) shingles are in one of them alone.
    """
    width = np.array([len(b) // 8 for b in bits])
    kinds = {w: np.flatnonzero(width == w) for w in sorted(set(width.tolist()))}
    maps = {w: np.frombuffer(b"".join(bits[k] for k in at), np.uint64).reshape(len(at), w) for w, at in kinds.items()}
    left, right, far = [], [], []
    for w, at in kinds.items():
        for v, others in kinds.items():
            if not two and v < w or 100 * n[at].max() < percent * n[others].min() or 100 * n[others].max() < percent * n[at].min():
                continue
            own_maps, other_maps = folded(maps[w], min(v, w)), folded(maps[v], min(v, w))
            for k in np.flatnonzero(side[at] == 0) if two else range(len(at)):
                i, start = at[k], k + 1 if v == w and not two else 0
                js = others[start:]
                fit = (root[js] != root[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))
                if two:
                    fit &= side[js] == 1
                fit = np.flatnonzero(fit)
                if not len(fit):
                    continue
                differ = np.bitwise_count(other_maps[start + fit] ^ own_maps[k]).sum(1, dtype=np.int64)
                united = n[js[fit]] + n[i]
                keep = (100 + percent) * differ <= (100 - percent) * united
                if keep.any():
                    right.append(js[fit[keep]]), left.append(np.full(len(right[-1]), i)), far.append(1000 * differ[keep] // united[keep])
    if not left:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(far)


def crowd(members: DataFrame) -> DataFrame:
    """bucket, sid, root, main, own, others of the buckets (bucket, sid, root) with more than two sets and several roots.

    main: whether a set is of the bucket's most frequent root. Its sets and the rest are cut into blocks, numbered
    together, the rest's first; own is a set's block, others the blocks that it must meet: a main set
    those of the rest, another one all. Buckets with equal sets are one.
    """
    by_root = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("s"))
    held = by_root.groupBy("bucket").agg(F.sum("k").alias("n"), F.max(F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("s").alias("s")).where("roots > 1 AND n > 2")
    held = held.groupBy("n", "s").agg(F.min(F.struct("bucket", "main")).alias("x")).select("x.bucket", F.col("x.main.root").alias("main_root"), F.ceil((F.col("n") - F.col("x.main.k")) / BLOCK_SETS).alias("rest"), F.ceil(F.col("x.main.k") / BLOCK_SETS).alias("most"))
    main = F.col("root") == F.col("main_root")
    own = F.when(main, F.col("rest") + F.pmod(F.xxhash64("sid"), "most")).otherwise(F.pmod(F.xxhash64("sid"), "rest"))
    return members.join(written(held, "held"), "bucket").select("bucket", "sid", "root", own.alias("own"), F.when(main, F.col("rest")).otherwise(F.col("rest") + F.col("most")).alias("others"))


def crowded_pairs(members: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """a, b (a < b), far: pairs of two roots in a bucket that may be alike. members: as crowd() gives them; maps: sid, n, bits.

    Two blocks meet in a group of their own, so a bucket's work is spread over tasks.
    """
    own, other = F.col("own"), F.col("other")
    dealt = members.join(maps, "sid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    dealt = dealt.select("bucket", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), (own > other).cast("long").alias("side"), "sid", "root", "n", "bits")
    dealt = dealt.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def pairs(group: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(group)
        x, y, side, sid, root, n = (t.column(k).to_numpy() for k in ("x", "y", "side", "sid", "root", "n"))
        i, j, far = maybe_alike(n, root, side, x[0] != y[0], t.column("bits").to_pylist(), percent)
        return np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j]), far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                here = tuple(key[a].tolist())
                if here != at:
                    if group:
                        found.append(pairs(group))
                    group, at = [], here
                group.append(batch.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], names=["a", "b", "far"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs(group)], names=["a", "b", "far"])
        tidy()

    return dealt.mapInArrow(run, "a long, b long, far long").groupBy("a", "b").agg(F.min("far").alias("far"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, rounds: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text): rid, doc_id, n_shingles, component_id, kept, root (struct, what rows of one component share).

    Words are lower-cased (A-Z) runs without white space; a text with fewer than width
    words is one shingle; one without words or a null text links with nothing and is its
    own component. component_id is the smallest doc_id of the component, kept whether it
    is the row's own, so rows that repeat an id are kept or not together. Null ids take
    no part in the minimum. An empty table gives no rows; other columns are ignored.
    rounds: choices of centres in each bucket, before the buckets that still hold several components
    are compared in full; a pair of alike sets is missed only if it shares no band (odds under 1e-5 at 0.75).
    """
    return _near_rows(keyed(docs, "doc_id", "text"), width, percent, rounds)


def _near_rows(rows: DataFrame, width: int = 5, percent: int = 75, rounds: int = 3) -> DataFrame:
    """near_duplicates() of rows that have their key rid."""
    with scratch(rows.sparkSession):
        return _linked(rows, width, percent, rounds)


def _linked(rows: DataFrame, width: int, percent: int, rounds: int) -> DataFrame:
    rows = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = written(signed(rows, width), "signatures", keep=True)
    # a set's id is the place of its first row: the number of the file and the row's in it
    files = written(facts.select(F.col("rid.f").alias("file")).distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")).cast("long")), "files")  # a row for each file
    firsts = facts.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min(F.struct("rid", "bands")).alias("x"), F.min("doc_id").alias("doc_id")).join(sent(files), F.col("x.rid.f") == F.col("file"))
    place = F.shiftleft("file_no", FILE_BITS).bitwiseOR(F.col("x.rid.r"))
    sets = written(firsts.select("fp1", "fp2", F.col("x.rid").alias("rid"), F.col("x.bands").alias("bands"), "doc_id", "file_no", place.alias("sid")), "sets")
    members = sets.select("sid", F.explode("bands").alias("bucket"))
    # tables that go back to the members of a bucket are written first, so that the join's skew can be split
    crowded = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "buckets")
    members = written(members.join(crowded, "bucket"), "members")
    release(rows.sparkSession)
    some = written(sets.join(members.select("sid").distinct(), "sid").select("rid", "file_no", F.lit(1).cast("long").alias("mark")), "bucketed-sets")
    texts = marked(rows.select("rid", "text"), some, "mark", "file_no").where("mark > 0")
    hashes = written(hashed(texts.select(F.shiftleft("file_no", FILE_BITS).bitwiseOR(F.col("rid.r")).alias("sid"), "text"), width), "hashes")
    release(rows.sparkSession)
    links = roots = tried = None

    def rooted_members() -> DataFrame:
        return members.join(roots, F.col("sid") == F.col("node"), "left").select("bucket", "sid", F.coalesce("root", "sid").alias("root"))

    def untried(pairs: DataFrame) -> DataFrame:
        return pairs if tried is None else pairs.join(tried, (F.least("a", "b") == F.col("t1")) & (F.greatest("a", "b") == F.col("t2")), "left_anti")

    def link(pairs: DataFrame) -> None:
        """Confirm written pairs and find the components anew."""
        nonlocal links, tried, roots
        found = written(confirmed(pairs, hashes, percent), "links")
        links = found if links is None else links.unionByName(found)
        release(rows.sparkSession)
        these = pairs.select(F.least("a", "b").alias("t1"), F.greatest("a", "b").alias("t2"))
        tried = these if tried is None else tried.unionByName(these)
        # what is linked already is a star of each component
        old = [roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))] if roots is not None else []
        edges = found
        for x in old:
            edges = edges.unionByName(x)
        roots = written(components(edges, "a", "b"), "roots")

    for r in range(rounds):
        now = members if roots is None else rooted_members()
        lead = [F.xxhash64(F.lit(r), "bucket", "sid").alias("p")]
        if r == 1:  # the set with the most links so far: a text that others were made from
            degree = links.select(F.explode(F.array("a", "b")).alias("d_sid")).groupBy("d_sid").agg(F.count(F.lit(1)).alias("d"))
            now = now.join(degree, F.col("sid") == F.col("d_sid"), "left").select("bucket", "sid", "root", (-F.coalesce("d", F.lit(0))).alias("d"))
            lead = [F.col("d"), *lead]
        of = F.struct(*lead, F.col("sid"), *([F.col("root")] if roots is not None else []))
        centre = now.groupBy("bucket").agg(F.min(of).alias("c"), *([F.min("root").alias("lo"), F.max("root").alias("hi")] if roots is not None else []))
        if roots is not None:
            centre = centre.where("lo < hi")
        centre = written(centre, "centres")
        pairs = now.join(centre, "bucket").where(F.col("sid") != F.col("c.sid") if roots is None else F.col("root") != F.col("c.root"))
        # the centre is a, so that a centre's set is read once for many members
        pairs = written(untried(pairs.select(F.col("c.sid").alias("a"), F.col("sid").alias("b")).distinct()), "pairs")
        if pairs.take(1):
            link(pairs)
        elif roots is None:  # no bucket has two sets
            break
    if roots is not None:
        # a bucket of two sets was compared in full by its first centre
        full = written(crowd(rooted_members()), "crowded")
        if full.take(1):
            left = written(untried(crowded_pairs(full, hashes.select("sid", "n", "bits"), percent)), "candidates")
            for best in (True, False):  # first the likest pair of each two components, as it mostly joins them, then all pairs that are still of two
                if not left.take(1):
                    break
                x, y = (roots.select(F.col("node").alias(f"{k}_node"), F.col("root").alias(f"{k}_root")) for k in "ab")
                both = left.join(x, F.col("a") == F.col("a_node"), "left").join(y, F.col("b") == F.col("b_node"), "left")
                both = both.select("a", "b", "far", F.coalesce("a_root", "a").alias("ra"), F.coalesce("b_root", "b").alias("rb")).where("ra <> rb")
                pairs = both.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b") if best else both.select("a", "b")
                pairs = written(untried(pairs), "pairs")
                if pairs.take(1):
                    link(pairs)
    if roots is None:
        labels = sets.select("fp1", "fp2", F.col("doc_id").alias("component"), F.col("sid").alias("root"))
    else:
        rooted = sets.join(roots, F.col("sid") == F.col("node"), "left").select("fp1", "fp2", "doc_id", F.coalesce("root", "sid").alias("root"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component"))
        labels = rooted.join(least, "root").select("fp1", "fp2", "component", "root")
    labels = written(labels.withColumnsRenamed({"fp1": "l1", "fp2": "l2"}), "labels", keep=True)
    joined = facts.drop("bands").join(labels, (F.col("fp1") == F.col("l1")) & (F.col("fp2") == F.col("l2")) & (F.col("n_shingles") > 0), "left")
    own = F.coalesce(F.col("component"), F.col("doc_id"))
    shared = F.when(F.col("root").isNotNull(), F.struct(F.lit(None).cast("long").alias("f"), F.col("root").alias("r"))).otherwise(F.col("rid"))
    return joined.select("rid", "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), shared.alias("root"))


def one_of_each(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), **options) -> DataFrame:
    """The rows of docs of which each component keeps one: that with the smallest doc_id (null last), then the earliest.

    Rows without words are components of their own and stay, so do rows with a null id that are alike to nothing;
    of repeated rows one stays. An empty table gives no rows; columns beside the given ones go.
    """
    rows = keyed(docs, *dict.fromkeys(("doc_id", "text", *columns)))
    with scratch(docs.sparkSession):
        found = written(_near_rows(rows, **options).select("rid", "doc_id", "root"), "components")
        first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("x")).select(F.col("x.rid").alias("rid"))
        gone = written(found.join(first, "rid", "left_anti").select("rid", F.lit(1).cast("long").alias("_gone")), "near-copies", keep=True)
    return marked(rows, gone, "_gone").where("_gone = 0").select(*columns)
