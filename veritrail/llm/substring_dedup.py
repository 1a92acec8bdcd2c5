"""Substring dedup: removes words covered by a window of consecutive words that was there before.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed string to the
minimiser's bucket, where windows are sorted and counted exactly. See `_pieces` for what is sent when.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, mix, scratch, table, word_hashes, word_spans
from ._pieces import BUCKET_PIECES, in_parts, repeated_pieces, runs, scan_pieces, solve_buckets, source_rows, window_anchors

#: Words of a window, and of a minimiser.
WINDOW_WORDS = 20
MINIMISER_WORDS = 4


def _find(width: int, m: int):
    def find(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        start, end, row = word_spans(data, off)
        none = np.zeros(0, np.int64)
        if len(start) < width:
            return none, none, none, none, np.zeros(0, np.uint64)
        h = word_hashes(data, start, end)
        n = len(h) - m + 1
        g = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(m):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        g = mix(g)
        anchor = window_anchors(g, width - m + 1)
        whole = np.flatnonzero(row[: len(anchor)] == row[width - 1 :])  # windows within one text
        if not len(whole):
            return none, none, none, none, np.zeros(0, np.uint64)
        first, count = runs(anchor[whole])
        at, anchors = whole[first], anchor[whole][first]
        return row[at], at - np.searchsorted(row, row[at], "left"), count, anchors - at, g[anchors]

    return find


def _cut(width: int):
    def cut(text: bytes, at: list[int], n: list[int]) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[a : a + k + width - 1]) for a, k in zip(at, n, strict=True)]

    return cut


def _sub(piece: bytes, start: int, count: int) -> bytes:
    return b" ".join(piece.split(b" ")[start : start + count])


_COLUMNS = ["key", "h1", "h2", "n", "f_id", "f_at", "f_hash", "piece"]
_FLAGGED = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("f_id", pa.int64()), ("f_at", pa.int64()), ("f_hash", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _solve(width: int):
    def solve(rows: list[tuple]) -> list[tuple]:
        """For each piece, runs of windows [a, b) that are also in a piece which stands earlier."""
        out, i = [], 0
        while i < len(rows):
            j = i + 1
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            if j - i > 1:
                windows = []
                for p in range(i, j):
                    _, _, _, n, f_id, f_at, f_hash, piece = rows[p]
                    ends = [k for k, c in enumerate(piece) if c == 32] + [len(piece)]
                    starts = [0] + [e + 1 for e in ends[:-1]]
                    windows += [(piece[starts[k] : ends[k + width - 1]], f_id, f_at + k, f_hash, p, k) for k in range(n)]
                windows.sort()
                late = sorted((b[4], b[5]) for a, b in zip(windows, windows[1:], strict=False) if a[0] == b[0])
                k = 0
                while k < len(late):
                    e = k + 1
                    while e < len(late) and late[e][0] == late[k][0] and late[e][1] == late[e - 1][1] + 1:
                        e += 1
                    r = rows[late[k][0]]
                    out.append((r[0], r[1], r[2], r[4], r[5], r[6], late[k][1], late[e - 1][1] + 1))
                    k = e
            i = j
        return out

    return solve


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches):
        total, removed, sha = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            total.append(len(words))
            if spans:
                step = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    step[s["s"]] += 1
                    step[s["e"]] -= 1
                kept = [w for w, c in zip(words, np.cumsum(step).tolist(), strict=False) if not c]
            else:
                kept = words
            removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        cols = [batch.column("doc_id"), batch.column("k_id"), batch.column("k_hash"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k_id", "k_hash", "n_words", "n_removed", "kept_sha256"])


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_WORDS, minimiser: int = MINIMISER_WORDS, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """(k_id, k_hash, spans): for each text with such words, spans [s, e) of words that a window covers which also
    starts earlier, by smaller id (null first), then earlier start."""
    rows = source_rows(docs, id_col, text_col)
    top = 1 << (width - minimiser).bit_length()
    at = repeated_pieces(rows, scan_pieces(rows, _find(width, minimiser)), _cut(width), _sub, width, top, "substring", bucket_pieces)
    kinds = at.groupBy("key", "h1", "h2", "piece").agg(F.min(F.struct("k_id", "at", "k_hash")).alias("first"), F.max("n").alias("n"), F.count("*").alias("times"))
    first = [F.col("first.k_id").alias("f_id"), F.col("first.at").alias("f_at"), F.col("first.k_hash").alias("f_hash")]
    kinds = materialize(kinds.select("key", "h1", "h2", "piece", "n", "times", *first), "substring-kinds")
    late = solve_buckets(kinds, _solve(width), _COLUMNS, _FLAGGED, "key long, h1 long, h2 long, f_id long, f_at long, f_hash long, a int, b int")
    late = materialize(late, "substring-late")
    is_first = (F.col("k_id") == F.col("f_id")) & (F.col("at") == F.col("f_at")) & (F.col("k_hash") == F.col("f_hash"))
    places = at.select("k_id", "k_hash", "at", "n", "key", "h1", "h2")
    again = places.join(kinds.where("times > 1").select("key", "h1", "h2", "f_id", "f_at", "f_hash"), ["key", "h1", "h2"]).where(~is_first)
    again = again.select("k_id", "k_hash", F.col("at").alias("s"), (F.col("at") + F.col("n") + (width - 1)).alias("e"))
    part = places.join(late, ["key", "h1", "h2"]).where(is_first).select("k_id", "k_hash", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("b") + (width - 1)).alias("e"))
    return again.unionByName(part).groupBy("k_id", "k_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per row of docs: doc_id, k_id, k_hash, n_words, n_removed, kept_sha256.

    A null text has no words. Windows are judged on the input. Rows that repeat both id and text are one row to
    this operator: none is earlier than the other. Texts with fewer words than a window are kept whole. An empty
    table gives an empty result; other columns are not read.
    """
    with scratch() as keep:
        spans = keep(materialize(repeated_words(docs, id_col, text_col, **options), "substring-spans"))
    rows = source_rows(docs, id_col, text_col).join(spans, ["k_id", "k_hash"], "left").select("doc_id", "k_id", "k_hash", "text", "spans")
    return rows.mapInArrow(_apply, "doc_id long, k_id long, k_hash long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
  late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
  gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]), ' '), '') END) AS kept_sha256
  FROM d LEFT JOIN gone USING (doc_id)"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents")).drop("k_id", "k_hash")
