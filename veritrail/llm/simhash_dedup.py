"""SimHash near-duplicates by a binary trie self-join.

Fingerprints (64 bits) of distinct documents form a binary trie. The self-join walks pairs of nodes at the
same depth together, adds one to a pair's error count whenever its two sides take different branches, and
drops the pair when the count passes the budget; pairs of small nodes are finished by comparing their leaves.

The trie is dealt out by blocks of bits: with a budget of e, two linked fingerprints agree on at least one of
e + 1 blocks, so for each block every fingerprint goes to the node that this block's bits lead to, and the
walk from that node finds the link. A node with more than `NODE_ROWS` fingerprints is split again by blocks
of its other bits, until it is small enough; no pair is lost. A node returns a spanning forest of its links
(as many links as it has fingerprints, at most), which keeps components whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import components, let_go, materialize, row_key, scratch, shingle_hashes, table, text_slices

BITS = 64
#: Differing bits at which fingerprints link.
BUDGET = 4
#: Words of a shingle.
SHINGLE_WORDS = 4
#: Fingerprints that one trie walk takes.
NODE_ROWS = 4096
#: Rows of small nodes that are walked at once.
WALK_ROWS = 20_000
#: Node pairs with at most so many leaf pairs are finished by comparing these.
LEAF_PAIRS = 16
#: Bytes of text whose shingles are hashed together.
STEP_BYTES = 1 << 18
_SEED = 42


def fingerprints_of(texts: list[bytes], shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text's word shingles, as an unsigned number; 0 for no words."""
    hashes, count = shingle_hashes(texts, shingle_words, _SEED)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        ones = np.zeros((len(some), BITS), np.int64)
        for k, (s, n) in enumerate(zip((np.cumsum(count) - count)[some].tolist(), count[some].tolist(), strict=True)):
            for i in range(s, s + n, 1 << 16):  # a long text's bits, some at a time
                bits = np.unpackbits(hashes[i : min(i + (1 << 16), s + n)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[k] += bits.sum(axis=0, dtype=np.uint32)
        out[some] = np.packbits(2 * ones > count[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _prints(shingle_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("k_id", pa.int64()), ("k_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for i, j, data, off in text_slices(batch.column("text"), STEP_BYTES):
                raw, cut = data.tobytes(), off.tolist()
                out[i:j] = fingerprints_of([raw[cut[r] : cut[r + 1]] for r in range(j - i)], shingle_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64)), batch.column("k_id"), batch.column("k_hash")], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), k_id, k_hash: one row per row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", *row_key())
    return rows.mapInArrow(_prints(shingle_words), "doc_id long, fp long, k_id long, k_hash long")


# ----------------------------------------------------------------------------- the walk


def _finish(fp: np.ndarray, lo_a, n_a, lo_b, n_b, same, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked leaves under node pairs, by comparing them."""
    size = n_a * n_b
    pair = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i = lo_a[pair] + nth // n_b[pair]
    j = lo_b[pair] + nth % n_b[pair]
    keep = (~same[pair] | (i < j)) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
    return i[keep], j[keep]


def trie_links(fp: np.ndarray, roots: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions) within each run of fp between consecutive `roots`.

    fp: unsigned, ascending within each run. Walks all runs' tries at once, breadth first.
    """
    lo, hi = roots[:-1], roots[1:]
    a0, a1, b0, b1 = lo, hi, lo.copy(), hi.copy()
    err = np.zeros(len(lo), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(BITS - 1, -2, -1):
        same = a0 == b0
        n_a, n_b = a1 - a0, b1 - b0
        small = (n_a * n_b <= LEAF_PAIRS) | (bit < 0)
        for at in np.array_split(np.flatnonzero(small & ~(same & (n_a == 1))), max(1, int(small.sum()) // 500_000)):
            if len(at):
                found.append(_finish(fp, a0[at], n_a[at], b0[at], n_b[at], same[at], budget))
        if small.all():
            break
        a0, a1, b0, b1, err, same = (x[~small] for x in (a0, a1, b0, b1, err, same))
        ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        other = ~same  # a pair of one node with itself has its crossing once
        parts.append((am[other], a1[other], b0[other], bm[other], err[other] + 1))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (err <= budget)
        a0, a1, b0, b1, err = (x[keep] for x in (a0, a1, b0, b1, err))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each component of the links that has other members."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(up := root[root], root):
            root = up
        rest = root[i] != root[j]
        i, j = i[rest], j[rest]
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _walk(budget: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def solve(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, node))
        node, fp = node[order], fp[order]
        roots = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]))
        member, root = spanning(len(fp), *trie_links(fp, roots, budget))
        return pa.RecordBatch.from_arrays([pa.array(fp[member].view(np.int64)), pa.array(fp[root].view(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # sorted by node
            node = np.concatenate((node, batch.column("node").to_numpy()))
            fp = np.concatenate((fp, batch.column("fp").to_numpy().view(np.uint64)))
            if len(node) >= WALK_ROWS and (cut := int(np.searchsorted(node, node[-1], "left"))):
                yield solve(node[:cut], fp[:cut])
                node, fp = node[cut:], fp[cut:]
        if len(node):
            yield solve(node, fp)

    return run


def _parts(free: int, n: int) -> list[int]:
    """The set bits of `free`, dealt into n masks of consecutive bits."""
    bits = [b for b in range(BITS) if free >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt_nodes(prints: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(node, fp) for distinct fp: each pair within the budget meets in a node; no node is too large to walk."""
    paths = _parts((1 << BITS) - 1, budget + 1)
    deal = F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(paths)])).alias("to")
    at = prints.select("fp", deal).select("fp", "to.path", F.xxhash64(F.lit(0), "to.path", F.col("fp").bitwiseAND(F.col("to.mask"))).alias("node"))
    done, level = None, 0
    while True:
        level += 1
        at = materialize(at, "simhash-nodes")
        hot = materialize(at.groupBy("node").count().where(F.col("count") > node_rows).select("node"), "simhash-hot")
        splittable = all(BITS - used.bit_count() > budget for used in paths)  # else a node has few fingerprints anyway
        if not splittable or not hot.limit(1).count():
            return (done.unionByName(at) if done is not None else at).select("node", "fp")
        cold = at.join(hot, "node", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        nexts = [[used | m for m in _parts((1 << BITS) - 1 & ~used, budget + 1)] for used in paths]
        masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in nexts])
        at = (
            at.join(hot, "node", "left_semi")
            .select("fp", "path", "node", F.posexplode(masks[F.col("path")]).alias("k", "mask"))
            .select("fp", (F.col("path") * (budget + 1) + F.col("k")).alias("path"), F.xxhash64(F.lit(level), "node", "k", F.col("fp").bitwiseAND(F.col("mask"))).alias("node"))
        )
        paths = [m for ms in nexts for m in ms]


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, shingle_words: int = SHINGLE_WORDS, node_rows: int = NODE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), root (the component's least fp), component_id, k_id, k_hash.

    Texts without words (null and empty ones too) have fingerprint 0 and link like any other. component_id is
    the smallest id of the component (null if it has null ids only). Copies share a fingerprint and are not
    paired; an empty table gives an empty result; other columns are not read.
    """
    with scratch() as keep:
        prints = keep(materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints"))
        distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
        nodes = dealt_nodes(distinct, budget, node_rows).repartition("node").sortWithinPartitions("node")
        links = materialize(nodes.mapInArrow(_walk(budget), "u long, v long").distinct(), "simhash-links")
        roots = components(links, "simhash")
        named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("low").alias("component_id"))
        named = keep(materialize(named.join(least, "root").select("fp", "root", "component_id"), "simhash-named"))
    return prints.join(named, "fp").select("doc_id", "fp", "root", "component_id", "k_id", "k_hash")


def keep_one_of_each_component(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs whose id is their component's smallest, with all their columns (one row of repeats)."""
    found = simhash_components(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = F.row_number().over(W.partitionBy("root").orderBy("k_hash"))
    kept = materialize(found.withColumn("nth", one).where("nth = 1").select("k_id", "k_hash"), "simhash-kept")
    rows = docs.select(F.struct("*").alias("row"), *row_key())
    first = F.row_number().over(W.partitionBy("k_id", "k_hash").orderBy(F.lit(1)))
    return rows.join(kept, ["k_id", "k_hash"]).withColumn("nth", first).where("nth = 1").select("row.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
