"""Near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of 4/5 or more link.

Candidates are texts that agree on a band of minhashes (two texts of similarity 0.8 miss all `BANDS` bands with
probability 6e-5, of 0.85 with 3e-7), as 64-bit fingerprints alone find few of the pairs near 0.8; every link is
verified on the whole shingle sets. Linking goes in rounds. The first takes the components of the SimHash trie
self-join over five-word shingles and compares each text with its component's first, which joins most of a group of
copies. In a star round, each text is compared with the leader of one of its bands' buckets; a large group takes as
many comparisons as it has texts. The last round compares all candidates that no link has joined yet: pairs from small
buckets, and large buckets whole, blocks of them against each other. Sizes and one-bit minhashes only rule pairs out:
sizes never a link, the bits one with probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import components, let_go, materialize, mix, row_key, scratch, shingle_hashes, text_slices
from .simhash_dedup import STEP_BYTES, simhash_components

#: Texts link whose shingle sets have a similarity of ABOVE / BELOW or more.
ABOVE, BELOW = 4, 5
#: Words of a shingle; a text of fewer words is one shingle.
SHINGLE_WORDS = 5
BANDS, BAND_ROWS = 32, 6
#: One-bit minhashes that may differ of BANDS * BAND_ROWS: five deviations above the 19 of similarity 0.8.
BITS_APART = 40
STAR_ROUNDS = 1
#: Texts that one task compares with a leader without a break.
STAR_ROWS = 1000
#: Buckets of more texts are compared whole, in pairs of blocks of about BLOCK_ROWS texts.
PAIR_ROWS, BLOCK_ROWS = 16, 1000
_SEED = 42
_rng = np.random.default_rng(_SEED)
_FLIP = _rng.integers(0, 2**64, (BANDS * BAND_ROWS, 1), dtype=np.uint64)
_TIMES = _rng.integers(0, 2**64, (BANDS * BAND_ROWS, 1), dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 2**64, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct hashes of its word shingles) for each text."""
    let_go()
    for i, j, data, off in text_slices(column, STEP_BYTES):
        raw, cut = data.tobytes(), off.tolist()
        hashes, count = shingle_hashes([raw[cut[r] : cut[r + 1]] for r in range(j - i)], SHINGLE_WORDS, _SEED)
        ends = np.cumsum(count)
        for r in range(j - i):
            yield i + r, np.unique(hashes[ends[r] - count[r] : ends[r]])


def minhashes(hashes: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 128):
            np.minimum(low, ((hashes[i : i + 128] ^ _FLIP) * _TIMES).min(axis=1), out=low)
    return low


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * BELOW >= ABOVE * (len(a) + len(b) - both)


def _signed():
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("bits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def lists(rows: np.ndarray) -> pa.Array:
        flat = np.ascontiguousarray(rows).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, rows.shape[1], dtype=np.int32)), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int32)
            low = np.empty((batch.num_rows, BANDS * BAND_ROWS), np.uint64)
            for r, found in shingle_sets(batch.column("text")):
                n[r], low[r] = len(found), minhashes(found)
            low = mix(low)
            bits = np.packbits((low & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64)
            with np.errstate(over="ignore"):
                bands = mix((low.reshape(-1, BANDS, BAND_ROWS) * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n), lists(bits), lists(bands)], schema=schema)

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: a leader's own text (null u), then the texts to compare with it."""
    leader = mine = None
    for batch in batches:
        lead, other = batch.column("v").to_pylist(), batch.column("u").to_pylist()
        u, v, ok = [], [], []
        for r, found in shingle_sets(batch.column("text")):
            if other[r] is None:
                leader, mine = lead[r], found
            else:
                assert leader == lead[r]
                u.append(other[r]), v.append(lead[r]), ok.append(similar(found, mine))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])


def _bucket_links(sets: list[np.ndarray], comp: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (positions) of similar sets that join all components of `comp` which similar sets connect."""
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    comp = np.unique(comp, return_inverse=True)[1]
    main = int(np.argmax(np.bincount(comp)))
    has, out = np.zeros(int(flat.max()) + 1, np.int32), []
    for a in np.flatnonzero(comp != main).tolist():  # pairs within the main component need no link
        if comp[a] == main:
            continue
        mine = flat[starts[a] : starts[a] + sizes[a]]
        has[mine] = 1
        both = np.add.reduceat(has[flat], starts)
        has[mine] = 0
        for b in np.flatnonzero(both * BELOW >= ABOVE * (sizes + sizes[a] - both)).tolist():
            if comp[a] != comp[b]:
                out.append((a, b))
                old, new = (comp[a], comp[b]) if comp[b] == main else (comp[b], comp[a])
                comp[comp == old] = new
    return out


def _blocks_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, lo, hi), which name a group; gives links (u, v)."""
    group, sets, nodes, roots = None, [], [], []

    def solved() -> pa.RecordBatch:
        found = _bucket_links(sets, np.array(roots)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k, _ in found], pa.int64()), pa.array([nodes[k] for _, k in found], pa.int64())], names=["u", "v"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True))
        node, root = batch.column("node").to_pylist(), batch.column("root").to_pylist()
        for r, found in shingle_sets(batch.column("text")):
            if keys[r] != group:
                if sets:
                    yield solved()
                group, sets, nodes, roots = keys[r], [], [], []
            sets.append(found)
            nodes.append(node[r]), roots.append(root[r])
    if sets:
        yield solved()


def _block_links(at: DataFrame, large: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) links within the buckets `large` (key, size)."""
    rows = at.join(large.select("key", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("blocks")), "key")
    rows = rows.select("key", "a.node", "a.root", F.pmod(F.xxhash64(F.lit(3), "a.node"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "root").join(texts, "node")
    rows = rows.select("key", "lo", "hi", "node", "root", "text").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return materialize(rows.mapInArrow(_blocks_compared, "u long, v long"), "near-links")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, ok) for distinct pairs of nodes: whether their whole shingle sets are similar."""
    pairs = materialize(pairs, "near-pairs")
    many = pairs.groupBy("v").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    stars = pairs.join(many, "v").select("u", "v", F.pmod(F.xxhash64("u"), "parts").alias("part"))
    heads = many.select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = stars.select("v", "part", "u", F.col("u").alias("node")).unionByName(heads.select("v", "part", F.lit(None).cast("long").alias("u"), F.col("v").alias("node")))
    rows = both.join(texts, "node").select("v", "part", "u", "text").repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return materialize(rows.select("v", "u", "text").mapInArrow(_compared, "u long, v long, ok boolean"), "near-compared")


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(BANDS * BAND_ROWS // 64)), F.lit(0))


def _possible(a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (n * BELOW >= m * ABOVE) & (m * BELOW >= n * ABOVE) & (_apart(a, b) <= BITS_APART)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, node (of equal texts), root (the least node of the component), k_id, k_hash.

    Texts without words (null and empty ones too) are one node. Ids may be null or repeat; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    node = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.lit(7), text)).otherwise(F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node.alias("node"), text.alias("text"), *row_key(id_col, text_col))
    one = rows.where("node <> 0").select("node", "text")
    signed = materialize(one.mapInArrow(_signed(), "node long, n int, bits array<long>, bands array<long>"), "near-signed")
    within = W.partitionBy("key")
    dealt = signed.select("node", F.explode("bands").alias("key"))
    met = dealt.withColumn("low", F.min("node").over(within)).withColumn("high", F.max("node").over(within))
    met = materialize(met.where("low <> high").select("key", "node").distinct(), "near-met")
    marks = materialize(signed.join(met.select("node").distinct(), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node"]), "near-marks")
    texts = materialize(one.join(marks.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    first = simhash_components(one, "node", shingle_words=SHINGLE_WORDS).where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).distinct()
    some = marks.select("node")
    first = first.join(some, first["u"] == some["node"], "left_semi").join(some, first["v"] == some["node"], "left_semi")
    tested = _verified(first, texts)
    links = tested.where("ok").select("u", "v")
    roots = components(links, "near")
    for turn in range(STAR_ROUNDS + 1):
        at = met.join(marks, "node")
        at = at.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        at = at.select("key", F.struct("node", "n", "bits", "root").alias("a"))
        mixed = F.min("a.root") != F.max("a.root")
        leads = at.groupBy("key").agg(F.min_by("a", F.xxhash64(F.lit(turn), "a.node")).alias("b"), F.count("*").alias("size"), mixed.alias("mixed")).where("mixed")
        others = at.join(leads, "key").where("a.root <> b.root")
        if turn < STAR_ROUNDS:
            pairs = others.where(_possible("a", "b")).select("a.node", F.struct(_apart("a", "b").alias("apart"), F.col("b.node").alias("v")).alias("to"))
            pairs = pairs.select(F.col("node").alias("u"), F.col("to.v").alias("v"), F.col("to.apart").alias("apart"))
        else:  # all that are left: those outside the leader's component against all of their bucket
            once = "a.root <> c.root and (c.root = b.root or a.node < c.node)"
            links = links.unionByName(_block_links(at, leads.where(F.col("size") > PAIR_ROWS), texts))
            pairs = others.where(F.col("size") <= PAIR_ROWS).join(at.select("key", F.col("a").alias("c")), "key").where(F.expr(once) & _possible("a", "c"))
            pairs = pairs.select(F.col("a.node").alias("u"), F.col("c.node").alias("v"))
        gone = tested.select("u", "v").union(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = pairs.join(gone, ["u", "v"], "left_anti")
        if turn < STAR_ROUNDS:
            pairs = pairs.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("to")).select("u", "to.v")
        else:
            pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        found = _verified(pairs, texts)
        tested = tested.unionByName(found)
        links = links.unionByName(found.where("ok").select("u", "v"))
        roots = components(links, "near")
    named = rows.drop("text").join(roots, "node", "left")
    return named.select("doc_id", "node", F.coalesce("root", "node").alias("root"), "k_id", "k_hash")


def keep_one_of_each_near(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is their component's smallest (null only where all are), with all their columns."""
    one = F.row_number().over(W.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "k_hash"))
    with scratch() as keep:
        kept = keep(materialize(near_components(docs).withColumn("nth", one).where("nth = 1").select("k_id", "k_hash"), "near-kept"))
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    first = F.row_number().over(W.partitionBy("k_id", "k_hash").orderBy(F.lit(1)))
    return rows.join(kept, ["k_id", "k_hash"]).withColumn("nth", first).where("nth = 1").select("row.*")
