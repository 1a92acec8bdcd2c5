"""Language identification by hierarchical discrimination.

Languages are grouped into families by the likeness of their mean feature vectors. A text's family is predicted
first, by one linear support vector machine for each family against the rest; then one-versus-one machines
separate the languages within that family by votes. Features are the square roots of the relative frequencies of
hashed byte trigrams of the lowered text, white space and punctuation as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_sample, row_key, table, text_slices

#: Labelled rows that training takes at most, their bytes of text, and characters of a text (see `bounded_sample`).
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 30_000_000
SAMPLE_WINDOW = 1 << 17
FEATURES = 1 << 13
EPOCHS = 12
LAMBDA = 1e-4
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _k in range(26):
    _FOLD[65 + _k] = _FOLD[97 + _k] = 97 + _k


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) of unit length (0 for a text without letters)."""
    low = _FOLD[data].astype(np.uint32)
    # the second byte of a two-byte capital folds too: C3 80-9E to C3 A0-BE
    cap = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    low[cap] += 32
    blank = low == 32
    squeeze = blank.copy()
    squeeze[1:] &= blank[:-1]
    squeeze[:1] = False
    at = np.flatnonzero(~squeeze)
    low, cuts = low[at], np.searchsorted(at, off)
    out = np.zeros((len(off) - 1, FEATURES), np.float32)
    if len(low) >= 3:
        tri = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        tri = ((tri * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
        for r in range(len(off) - 1):
            if cuts[r + 1] - cuts[r] >= 3:
                out[r] = np.bincount(tri[cuts[r] : cuts[r + 1] - 2], minlength=FEATURES)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit_svm(x: np.ndarray, used: np.ndarray, y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Fits on the rows `used` of x. Weights and bias (last) of a linear machine, y in {-1, 1}: averaged subgradient steps on the hinge loss."""
    rng = np.random.default_rng(seed)
    w, total, n = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 0
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    steps = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(used))
        for rows in np.array_split(order, max(1, len(used) // 64)):
            steps += 1
            rate = 1.0 / (LAMBDA * (steps + 1000))
            part = x[used[rows]]
            miss = y[rows] * (part @ w[:-1] + w[-1]) < 1
            grad = (y[rows] * weight[rows] * miss) / len(rows)
            w[:-1] += rate * (grad @ part - LAMBDA * w[:-1])
            w[-1] += 0.1 * rate * grad.sum()
            if epoch >= EPOCHS // 2:
                total += w
                n += 1
    return (total / max(n, 1)).astype(np.float32)


def families(means: np.ndarray) -> list[list[int]]:
    """Groups of alike languages: average linkage on cosines, until half as many groups as languages are left."""
    groups = [[k] for k in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    near = unit @ unit.T
    while len(groups) > max(1, (len(means) + 1) // 2):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: (np.mean([near[i, j] for i in groups[p[0]] for j in groups[p[1]]]), -p[0], -p[1]))
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


@dataclass
class Hierarchy:
    languages: list[str]
    groups: list[list[int]]
    family: np.ndarray  # (groups, FEATURES + 1)
    pairs: dict[tuple[int, int], np.ndarray]


def fit(x: np.ndarray, lang: list[str]) -> Hierarchy:
    names = sorted(set(lang))
    y = np.array([names.index(v) for v in lang], np.int64)
    means = np.stack([np.mean(x, axis=0, where=(y == k)[:, None]) for k in range(len(names))]) if names else np.zeros((0, FEATURES))
    groups = families(means)
    of = np.zeros(len(names), np.int64)
    for g, members in enumerate(groups):
        of[members] = g
    family = [fit_svm(x, np.arange(len(x)), np.where(of[y] == g, 1.0, -1.0)) for g in range(len(groups))] if len(groups) > 1 else [np.zeros(FEATURES + 1, np.float32)] * len(groups)
    pairs = {}
    for members in groups:
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((y == a) | (y == b))
            pairs[a, b] = fit_svm(x, rows, np.where(y[rows] == a, 1.0, -1.0))
    return Hierarchy(names, groups, np.stack(family) if family else np.zeros((0, FEATURES + 1), np.float32), pairs)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def predict(x: np.ndarray, model: Hierarchy) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, score) of each row: family by the largest margin, language by votes, then margins."""
    n = len(model.languages)
    margin = x @ model.family[:, :-1].T + model.family[:, -1]
    group = margin.argmax(axis=1)
    sure = _sigmoid(2 * margin.max(axis=1)) if len(model.groups) > 1 else np.ones(len(x))
    best, score = np.zeros(len(x), np.int64), sure.copy()
    for g, members in enumerate(model.groups):
        rows = np.flatnonzero(group == g)
        votes, sums = np.zeros((len(rows), n)), np.zeros((len(rows), n))
        votes[:, members] += 1e-9
        for a, b in combinations(members, 2):
            w = model.pairs[a, b]
            z = x[rows] @ w[:-1] + w[-1]
            votes[:, a] += z >= 0
            votes[:, b] += z < 0
            sums[:, a] += z
            sums[:, b] -= z
        rank = votes * 1e6 + np.tanh(sums)
        rank[:, [k for k in range(n) if k not in members]] = -np.inf
        best[rows] = rank.argmax(axis=1)
        if len(members) > 1:
            score[rows] *= _sigmoid(2 * sums[np.arange(len(rows)), best[rows]] / (len(members) - 1))
    return best, score


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is in the fold that languages are not learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """Fits on a bounded sample of the rows with a language that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    picked = bounded_sample(rows, 2, SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_WINDOW)
    x = np.zeros((picked.num_rows, FEATURES), np.float32)
    for i, j, data, off in text_slices(picked.column("text"), 1 << 19):
        x[i:j] = features(data, off)
    return fit(x, picked.column("lang").to_pylist())


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Hierarchy | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, k_id, k_hash.

    `und` with score 0 for a text that is null or has no letter, or where nothing was learned. Rows may repeat;
    an empty table gives an empty result; columns but the named ones are not read.
    """
    model = model or train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers for each family and pair of languages
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("k_id", pa.int64()), ("k_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            if m.languages:
                for i, j, data, off in text_slices(batch.column("text"), 1 << 19):
                    best, s = predict(features(data, off), m)
                    ok = letters[i:j]
                    lang[i:j] = np.where(ok, np.array(m.languages, object)[best], UNKNOWN)
                    score[i:j] = np.where(ok, s, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), batch.column("k_id"), batch.column("k_hash")], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", held_out("doc_id").alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), *row_key())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, k_id long, k_hash long")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
