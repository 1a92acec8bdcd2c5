"""Shared helpers: table access, tables in the shared folder, Arrow text access, components."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles (a longer document is a step of its own).
SLICE_BYTES = 1 << 20
#: How tables between steps are written to folders of the local file system: as plain files. Without its native library Hadoop
#: starts a `chmod` for each file, checksum file and folder, and until that process is `chmod` it shares all memory of the JVM:
#: an executor that is measured in this moment seems to have twice its size. Other file systems ignore these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_RUN = f"veritrail-{uuid.uuid4().hex}"
_folders: dict[str, SparkSession] = {}
_scopes: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _base(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'veritrail-shared')}"
    folder = f"{base.rstrip('/')}/{_RUN}"
    if not _folders:
        atexit.register(_remove_all)
    _folders[folder] = spark
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for folder, spark in _folders.items():
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, folder)
            except Exception:  # noqa: BLE001, S112  the JVM may be gone at exit; the folder is then left
                continue


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and return a reader of it.

    Cuts the lineage: an executor that is lost later costs a re-read, not a recomputation. The shuffle
    files of the writing job are dropped when it ends, so they do not pile up over many steps. On a local file
    system the tables have no checksum files.
    """
    spark = df.sparkSession
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        writer = df.write.mode("overwrite").options(**PLAIN_FILES)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veritrail_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that `materialize` writes in the block are deleted at its end, but for those handed to the function that
    the block gets: these are left to the block around it, if there is one."""
    own: list[DataFrame] = []
    _scopes.append(own)

    def keep(t: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not t]
        if len(_scopes) > 1:
            _scopes[-2].append(t)
        return t

    try:
        yield keep
    finally:
        _scopes.pop()
        release(*own)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_veritrail_path", None)):
            t._veritrail_path = None
            _delete(t.sparkSession, path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that identify a row by its content, alike in every scan: rows that agree on both id
    and text are repeats of one row. A null id or text has a key of its own."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k_id"),
        F.xxhash64(F.lit(11), F.col(doc_id), F.col(text)).alias("k_hash"),
    ]


def bounded_sample(rows: DataFrame, seed: int, most_rows: int, most_bytes: int, window: int, known: DataFrame | None = None) -> pa.Table:
    """rows: id, text, others. A sample for the driver, in the order of the hashes: the rows with the smallest hashes of id and text (repeats of a
    row count once), most_rows at most, as many as have most_bytes of text together. Of a text of more than `window`
    characters the sample has a window, at a place that the hash gives. known: id, others, to which rows are limited."""
    h = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "text"))
    met = (lambda t: t.join(known, "id")) if known is not None else (lambda t: t)
    small = met(h.select("id", "h", F.least(F.octet_length("text"), F.lit(4 * window)).alias("size"))).select("h", "size")
    most, total = None, 0
    for k in sorted({tuple(r) for r in small.orderBy("h").limit(most_rows).collect()}):
        total += k[1]
        if total > most_bytes:
            break
        most = k[0]
    long = F.char_length("text") - window
    cut = F.when(long > 0, F.substring("text", F.pmod(F.col("h"), F.greatest(long, F.lit(1))).cast("int") + 1, F.lit(window))).otherwise(F.col("text"))
    picked = h.where(F.col("h") <= most) if most is not None else h.where("false")
    return met(picked).dropDuplicates(["h"]).withColumn("text", cut).toArrow().sort_by("h")


def equal(left: DataFrame, right: DataFrame, *names: str) -> Column:
    cond = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return cond


# ----------------------------------------------------------------------------- a worker's memory

_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task. It keeps one thing only: workers are used again by other steps."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Frees what an earlier step has left in this worker process."""
    _held.clear()
    give_back()


def give_back() -> None:
    """Returns memory of batches that are done to the system; Arrow's pool keeps it else."""
    pa.default_memory_pool().release_unused()


# ----------------------------------------------------------------------------- Arrow text access


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about `limit` bytes."""
    data, off = text_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word `[^\\x20\\x09-\\x0D]+`, and the row it is in."""
    word = ~_SPACE[data]
    inner = off[1:-1][off[1:-1] < len(data)]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = inner[inner > 0] - 1
    last[before] = word[before]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(n, r, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, stems: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes wherever they stand.

    stems: one column more for each length of a word's leading bytes (a shorter word stands for its stem).
    """
    out = np.empty((len(start), 1 + len(stems)), np.uint64)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + SLICE_BYTES, "right")))
        part = data[base : int(end[j - 1])]
        p, q = _power(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
            s, e = start[i:j] - base, end[i:j] - base
            for k, size in enumerate((None, *stems)):
                to = e if size is None else np.minimum(e, s + size)
                out[i:j, k] = (total[to] - total[s]) * q[s] + (to - s).astype(np.uint64)
        i = j
    return mix(out) if stems else mix(out[:, 0])


# ----------------------------------------------------------------------------- XXH64

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: the hash's primes


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(acc + word * _P2, 31) * _P1


def words_from(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a little-endian number; the last 7 places have none."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for r in range(8):
        part = data[r : r + (len(data) - r) // 8 * 8]
        out[r::8] = np.ascontiguousarray(part).view("<u8")
    return out


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:end] for each pair of places: all spans take each step of the hash together."""
    words = words_from(np.concatenate((data, np.zeros(8, np.uint8))))
    size, seed_ = end - start, np.uint64(seed)
    at, h = start.copy(), np.full(len(start), seed_ + _P5, np.uint64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), v, np.uint64) for v in (seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1)]
            go = np.arange(len(long))
            while len(go):
                for k in range(4):
                    lanes[k][go] = _lane(lanes[k][go], words[at[long[go]] + 8 * k])
                at[long[go]] += 32
                go = go[end[long[go]] - at[long[go]] >= 32]
            acc = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for lane in lanes:
                acc = (acc ^ _lane(np.zeros(len(long), np.uint64), lane)) * _P1 + _P4
            h[long] = acc
        h += size.astype(np.uint64)
        for _ in range(3):
            go = np.flatnonzero(end - at >= 8)
            if not len(go):
                break
            h[go] = _rotated(h[go] ^ _lane(np.zeros(len(go), np.uint64), words[at[go]]), 27) * _P1 + _P4
            at[go] += 8
        go = np.flatnonzero(end - at >= 4)
        h[go] = _rotated(h[go] ^ ((words[at[go]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[go] += 4
        for _ in range(3):
            go = np.flatnonzero(end > at)
            if not len(go):
                break
            h[go] = _rotated(h[go] ^ ((words[at[go]] & np.uint64(0xFF)) * _P5), 11) * _P1
            at[go] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def shingle_hashes(texts: list[bytes], words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, their number in each text): XXH64 of each run of `words` words, A-Z lowered and joined by one space; a
    text of fewer words has one, a text without words none."""
    found = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space only
    n = np.fromiter(map(len, found), np.int64, len(found))
    joined = np.frombuffer(b" ".join(b" ".join(w) for w in found if w), np.uint8)
    if not len(joined):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.append(np.flatnonzero(joined == 32), len(joined))
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    first = np.cumsum(n) - n
    a = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
    b = a + np.repeat(np.minimum(n, words), count) - 1
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), 1 << 16):  # a long text takes several steps
        s, e = starts[a[i : i + (1 << 16)]], ends[b[i : i + (1 << 16)]]
        out[i : i + (1 << 16)] = xxh64(joined[s[0] : e[-1]], s - s[0], e - s[0], seed)
    return out, count


# ----------------------------------------------------------------------------- components


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node that each node of (u long, v long) links reaches.

    Alternates large-star and small-star steps, which shorten every path to the smallest neighbour;
    each step is two aggregates and two joins on nodes, and is written before the next one.
    """
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    mark = lambda t: tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low2")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), f"{name}-edges")
        release(e, low, large, low2)
        e, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
