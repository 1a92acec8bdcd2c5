"""Suffix-array dedup: removes bytes covered by a string of 400 bytes that also starts elsewhere.

Candidate passages meet in buckets (see `_pieces`); there a suffix array of a bucket's passages is built by
two-stage sorting: only suffixes smaller than their successors are sorted directly, all others are induced by
scanning the array's buckets in order; adjacent suffixes that share 400 bytes mark the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, mix, scratch, table, words_from
from ._pieces import BUCKET_PIECES, in_parts, repeated_pieces, runs, scan_pieces, solve_buckets, source_rows, window_anchors

#: Bytes of a string, and of the anchors by which passages find their bucket.
WINDOW_BYTES = 400
ANCHOR_BYTES = 32


def _find(width: int, m: int):
    def find(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, np.int64)
        if len(data) < width:
            return none, none, none, none, np.zeros(0, np.uint64)
        w = words_from(data)
        n = len(data) - m + 1
        g = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(0, m, 8):
                g = (g ^ w[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
                g ^= g >> np.uint64(29)
        g = mix(g)
        anchor = window_anchors(g, width - m + 1)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        whole = np.flatnonzero(row[: len(anchor)] == row[width - 1 :])
        if not len(whole):
            return none, none, none, none, np.zeros(0, np.uint64)
        first, count = runs(anchor[whole])
        at, anchors = whole[first], anchor[whole][first]
        return row[at], at - off[row[at]], count, anchors - at, g[anchors]

    return find


def _cut(width: int):
    def cut(text: bytes, at: list[int], n: list[int]) -> list[bytes]:
        return [text[a : a + k + width - 1] for a, k in zip(at, n, strict=True)]

    return cut


def _sub(piece: bytes, start: int, count: int) -> bytes:
    return piece[start : start + count]


# ----------------------------------------------------------------------------- two-stage suffix sorting


def direct_sort(words: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """pos sorted by the first `depth` bytes from each place; eight bytes a round, groups of equals only."""
    k = words[pos]
    order = np.argsort(k, kind="stable")
    out, k = pos[order], k[order]
    new = np.ones(len(out), bool)
    new[1:] = k[1:] != k[:-1]
    slot = np.arange(len(out))
    for r in range(8, depth, 8):
        last = np.concatenate((new[1:], [True]))
        keep = ~(new & last)
        slot, new = slot[keep], new[keep]
        if not len(slot):
            break
        w = words[out[slot] + r]
        step = (w[1:] != w[:-1]) & ~new[1:]
        if not step.any():
            continue
        group = np.cumsum(new)
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][step]] = True
        m = np.flatnonzero(mixed[group])
        o = np.lexsort((w[m], group[m]))
        out[slot[m]] = out[slot[m]][o]
        w[m] = w[m][o]
        new[1:] |= w[1:] != w[:-1]
    return out


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one at the next; the last one is."""
    n = len(t)
    step = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(step, np.arange(n - 1))
    small = np.ones(n, bool)
    ended = at < len(step)
    small[:-1][ended] = t[step[at[ended]]] < t[step[at[ended]] + 1]
    small[:-1][~ended] = False  # equal to the end: the longer one is larger
    return small


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of t in the order of at least the first `depth` bytes of their suffixes. t ends in a 0."""
    words = words_from(np.concatenate((t, np.zeros(depth + 16, np.uint8)))).byteswap()
    small = smaller_than_next(t)
    direct = direct_sort(words, np.flatnonzero(small), depth)
    heads = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        parts = []
        while len(wave):  # larger ones of this bucket come from its own larger ones, too
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~small[before]]
        parts.append(direct[heads[c] : heads[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            order = np.argsort(t[before], kind="stable")
            before = before[order]
            cuts = np.flatnonzero(np.diff(t[before])) + 1
            for part in np.split(before, cuts):
                waiting[t[part[0]]].append(part)
        waiting[c] = []
    return np.concatenate(out)


def equal_neighbours(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For consecutive places of `order`, whether their first `depth` bytes are alike."""
    words = words_from(np.concatenate((t, np.zeros(8, np.uint8))))
    alike = np.arange(len(order) - 1)
    for r in (*range(0, depth - 7, 8), depth - 8):
        alike = alike[words[order[alike] + r] == words[order[alike + 1] + r]]
    out = np.zeros(max(len(order) - 1, 0), bool)
    out[alike] = True
    return out


def repeated_windows(pieces: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """For each piece, which of its windows' strings are also elsewhere in the pieces."""
    sizes = np.array([len(p) + 1 for p in pieces])
    starts = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)  # 255 is in no UTF-8 text: the ends become 0
    is_window = np.zeros(len(t), bool)
    for s, n in zip(starts, counts, strict=True):
        is_window[s : s + n] = True
    order = suffix_array(t, width)
    order = order[is_window[order]]
    alike = equal_neighbours(t, order, width)
    flag = np.zeros(len(t), bool)
    flag[order[:-1][alike]] = True
    flag[order[1:][alike]] = True
    return [flag[s : s + n] for s, n in zip(starts, counts, strict=True)]


_COLUMNS = ["key", "h1", "h2", "n", "piece"]
_FLAGGED = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _solve(width: int):
    def solve(rows: list[tuple]) -> list[tuple]:
        keys = [r[0] for r in rows]
        rows = [r for k, r in enumerate(rows) if (k and keys[k - 1] == r[0]) or (k + 1 < len(keys) and keys[k + 1] == r[0])]
        if not rows:
            return []
        out = []
        for r, flag in zip(rows, repeated_windows([r[4] for r in rows], [r[3] for r in rows], width), strict=True):
            edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
            out += [(r[0], r[1], r[2], int(a), int(b)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        return out

    return solve


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        total, removed, runs_, sha = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            total.append(len(raw))
            merged: list[list[int]] = []
            for s, e in sorted((s["s"], s["e"]) for s in spans or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            removed.append(sum(e - s for s, e in merged))
            runs_.append(len(merged))
            sha.append(kept.hexdigest())
        cols = [batch.column("doc_id"), batch.column("k_id"), batch.column("k_hash"), *(pa.array(x, pa.int64()) for x in (total, removed, runs_)), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k_id", "k_hash", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_BYTES, anchor: int = ANCHOR_BYTES, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """(k_id, k_hash, spans): for each text with such bytes, spans [s, e) covered by a string that also starts
    elsewhere. width and anchor are multiples of 8."""
    rows = source_rows(docs, id_col, text_col)
    top = 1 << (width - anchor).bit_length()
    at = repeated_pieces(rows, scan_pieces(rows, _find(width, anchor)), _cut(width), _sub, width, top, "suffix", bucket_pieces)
    kinds = at.groupBy("key", "h1", "h2", "piece").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    kinds = materialize(kinds, "suffix-kinds")
    ranges = solve_buckets(kinds, _solve(width), _COLUMNS, _FLAGGED, "key long, h1 long, h2 long, a int, b int")
    whole = kinds.where("times > 1").select("key", "h1", "h2", F.lit(0).alias("a"), F.col("n").alias("b"))
    found = materialize(ranges.unionByName(whole), "suffix-ranges")
    met = at.select("k_id", "k_hash", "at", "key", "h1", "h2").join(found, ["key", "h1", "h2"])
    spans = met.select("k_id", "k_hash", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("b") + (width - 1)).alias("e"))
    return spans.groupBy("k_id", "k_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per row of docs: doc_id, k_id, k_hash, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Strings are judged on the input and never cross texts. Rows that repeat both id and
    text are different places. Texts shorter than the string are kept whole. An empty table gives an empty
    result; other columns are not read.
    """
    with scratch() as keep:
        spans = keep(materialize(repeated_bytes(docs, id_col, text_col, **options), "suffix-spans"))
    rows = source_rows(docs, id_col, text_col).join(spans, ["k_id", "k_hash"], "left").select("doc_id", "k_id", "k_hash", "text", "spans")
    return rows.mapInArrow(_apply, "doc_id long, k_id long, k_hash long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = r"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  win AS MATERIALIZED (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d)),
  met AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
  runs AS (SELECT doc_id, min(i) AS s, max(i) + 400 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, (i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 400)::INT AS new FROM met)) GROUP BY doc_id, run),
  kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS x FROM (
    SELECT doc_id, e AS a, lead(s, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY s) AS b FROM runs UNION ALL SELECT doc_id, 0, min(s) FROM runs GROUP BY 1) JOIN d USING (doc_id) GROUP BY 1)
  SELECT doc_id, len(d.x) // 2 AS n_bytes, coalesce(r.n, 0)::BIGINT AS n_removed, coalesce(r.k, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
  FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - s) AS n, count(*) AS k FROM runs GROUP BY 1) r USING (doc_id)"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("k_id", "k_hash")
