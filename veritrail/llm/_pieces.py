"""Repeated windows of long texts: the part that substring and suffix-array dedup share.

A window is a run of `width` units (words, or bytes) of one text. The unit run with the least hash among those in
a window is its anchor; consecutive windows with one anchor form a piece, and equal windows have equal anchors at
equal places. So a first pass sends only (row, place, anchor hash) of each piece; pieces whose anchor is met once
hold no repeated window. The others' texts are then cut out and sent to the bucket of their anchor, equal
pieces as one, where windows are compared exactly. A bucket with too many pieces is cut: its windows are split in
two halves by their distance from the anchor, and each half goes by the units that all its windows share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, mix, release, row_key, text_slices

#: Different pieces of one bucket that a task compares.
BUCKET_PIECES = 4000
#: An anchor with over this share of all pieces is hot, so hot ones are fewer than HOT_SHARE; each is dealt in SALTS parts.
HOT_SHARE = 1024
SALTS = 64

#: n_rel: the piece's windows times 1024, plus its first window's distance from the anchor.
PIECE = "k_id long, k_hash long, doc_id long, at long, n_rel int, key long"
TEXT_PIECE = "k_id long, k_hash long, doc_id long, at long, n int, key long, rel int, lo int, hi int, piece binary"


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its least one (the leftmost of equals)."""
    n = len(h) - width + 1
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << 24) - 1)
    out = np.empty(n, np.int64)
    step = (1 << 24) - width
    for i in range(0, n, step):  # places must fit into the low bits
        m = min(step, n - i)
        part = (h[i : i + m + width - 1] & ~low) | (place[: m + width - 1])
        pad = -len(part) % width
        grid = np.concatenate((part, np.full(pad, np.uint64(2**64 - 1)))).reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        out[i : i + m] = (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64) + i
    return out


def runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of each run of windows with one anchor."""
    start = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    return start, np.diff(np.concatenate((start, [len(anchor)])))


def source_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", "text", *row_key())


def scan_pieces(rows: DataFrame, find: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """PIECE rows. find(bytes, offsets) -> (row, at, n, rel, key) of the pieces of a slice of texts."""
    schema = pa.schema([("k_id", pa.int64()), ("k_hash", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_rel", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in text_slices(batch.column("text")):
                row, at, n, rel, key = find(data, off)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("k_id", "k_hash", "doc_id")), pa.array(at), pa.array((n * 1024 + rel).astype(np.int32)), pa.array(key.view(np.int64))], schema=schema)

    return rows.mapInArrow(run, PIECE)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows: what is made of them as Python objects stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _cut_text(cut: Callable[[bytes, list[int], list[int]], list[bytes]], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out: list[tuple] = []
            size = 0
            for k_id, k_hash, doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("k_id", "k_hash", "doc_id", "text", "found")), strict=True):
                found = sorted({(f["at"], f["n_rel"], f["key"]) for f in found})
                for (at, n_rel, key), piece in zip(found, cut(text.encode(), [f[0] for f in found], [f[1] // 1024 for f in found]), strict=True):
                    out.append((k_id, k_hash, doc_id, at, n_rel // 1024, key, n_rel % 1024, 0, top, piece))
                    size += len(piece)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return run


_TEXT_SCHEMA = pa.schema(
    [("k_id", pa.int64()), ("k_hash", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("rel", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("piece", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _TEXT_SCHEMA, strict=True)], schema=_TEXT_SCHEMA)


def _halve(sub: Callable[[bytes, int, int], bytes], width: int):
    """Splits pieces by the distance (rel) of a window's start from the anchor: [lo, mid) and [mid, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out: list[tuple] = []
            for k_id, k_hash, doc_id, at, n, key, rel, lo, hi, piece in zip(*(batch.column(c).to_pylist() for c in _TEXT_SCHEMA.names), strict=True):
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid, hi)):
                    # window i starts rel - i units before the anchor
                    first, last = max(0, rel - b + 1), min(n - 1, rel - a)
                    if first > last:
                        continue
                    shared = sub(piece, rel - a, width - (b - 1 - a))  # what all windows of [a, b) share; it lies in each of them
                    new = xxhash.xxh64_intdigest(b"%d,%d,%d," % (key, a, b) + shared)
                    out.append((k_id, k_hash, doc_id, at + first, last - first + 1, new - (1 << 64) if new >> 63 else new, rel - first, a, b, sub(piece, first, width + last - first)))
            if out:
                yield _batch(out)

    return run


def _with_repeated_keys(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """The pieces whose key is in counts (key, count), which is written. A hot key's pieces go to SALTS tasks."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    counts = counts.withColumn("is_hot", F.col("count") > total // HOT_SHARE)
    hot = counts.where("is_hot").select("key", F.lit(True).alias("is_hot"))
    salted = pieces.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("k_id", "k_hash", "at"), F.lit(SALTS)).cast("int")).otherwise(0))
    keys = counts.select("key", F.explode(F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return salted.join(keys, ["key", "salt"], "left_semi").drop("salt", "is_hot")


def repeated_pieces(rows: DataFrame, pieces: DataFrame, cut, sub, width: int, top: int, name: str, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """TEXT_PIECE rows plus h1, h2 (the piece's address), written: all pieces whose anchor is met more than once,
    in buckets (key) of at most bucket_pieces different ones."""
    pieces = materialize(pieces, f"{name}-pieces")
    met = _with_repeated_keys(pieces, materialize(pieces.groupBy("key").count().where("count > 1"), f"{name}-counts"))
    found = met.groupBy("k_id", "k_hash").agg(F.collect_list(F.struct("at", "n_rel", "key")).alias("found"))
    found = materialize(found, f"{name}-found")  # a group is one text's pieces
    release(pieces)
    texts = rows.join(found, ["k_id", "k_hash"]).select("k_id", "k_hash", "doc_id", "text", "found")
    address = (F.xxhash64(F.lit(3), "piece").alias("h1"), F.xxhash64(F.lit(4), "piece").alias("h2"))
    at = materialize(texts.mapInArrow(_cut_text(cut, top), TEXT_PIECE).select("*", *address), f"{name}-texts")
    release(found)
    done = None
    while True:
        kinds = at.groupBy("key", "h1", "h2").agg(F.max(F.col("hi") - F.col("lo")).alias("span")).groupBy("key").agg(F.count("*").alias("kinds"), F.max("span").alias("span"))
        hot = materialize(kinds.where((F.col("kinds") > bucket_pieces) & (F.col("span") > 1)).select("key"), f"{name}-hot")
        if not hot.limit(1).count():
            return at if done is None else done.unionByName(at)
        cold = at.join(hot, "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        at = materialize(at.join(hot, "key", "left_semi").select(*_TEXT_SCHEMA.names).mapInArrow(_halve(sub, width), TEXT_PIECE).select("*", *address), f"{name}-split")


def solve_buckets(kinds: DataFrame, solve: Callable[[list[tuple]], list[tuple]], columns: list[str], schema: pa.Schema, ddl: str, batch_bytes: int = 2 << 20) -> DataFrame:
    """Runs solve over whole buckets: kinds' rows are dealt by key, sorted, and handed over some buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows and (out := solve(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in in_parts(batches, 2000):
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if held and row[0] != held[-1][0]:
                    if size > batch_bytes:
                        yield from flush(held)
                        held, size = [], 0
                held.append(row)
                size += len(row[-1])
        yield from flush(held)

    return kinds.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(run, ddl)


__all__ = ["in_parts", "mix", "repeated_pieces", "runs", "scan_pieces", "solve_buckets", "source_rows", "window_anchors"]
