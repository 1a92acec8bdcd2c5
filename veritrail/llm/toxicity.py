"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed into a table of embeddings; filters of several widths slide over a text's words, each filter's
strongest response over the whole text is kept (max pooling), and a logistic layer on these gives the logit.
Training takes a bounded sample of labelled rows. The logit's threshold is calibrated for each language on
training rows that the fit did not see, and is moved to a score of 0.5. At scoring, the language is guessed from the
text's own words (naive Bayes on hashed words), so that text is a score's only input.

A table of word responses is computed once per model: filter responses are sums of rows of it, so scoring a
text is gathering, adding and taking maxima.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_sample, let_go, row_key, table, text_slices, word_hashes, word_spans

#: Labelled rows that training takes at most, their bytes of text, and characters of a text (see `bounded_sample`).
SAMPLE_ROWS = 8000
SAMPLE_BYTES = 30_000_000
SAMPLE_WINDOW = 1 << 17
#: Hash space of words and stems. Those that at least RARE sampled rows have get an embedding, all others share
#: a zero one, so that words that training never saw say nothing.
BUCKETS = 1 << 22
RARE = 3
DIMS = 12
#: Bytes of the leading parts of a word that the filters of width one also see, as inflected forms share them.
STEMS = (4, 5, 6)
#: (width, filters) of the convolutions.
FILTERS = ((1, 16), (2, 8), (3, 8))
EPOCHS = 4
#: Toxic rows at which a threshold counts half: a language's against that of all languages, and that against 0.
HALF_ROWS = 10
#: Words of training rows that one optimiser step takes.
STEP_WORDS = 6000
#: Bytes of text that are scored at once.
SCORE_BYTES = 1 << 18


@dataclass
class Cnn:
    lookup: np.ndarray  # of each bucket, its row in embed; 0: none
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    lang_words: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def responses(self) -> list[np.ndarray]:
        """For each kernel, (width, buckets, filters): what a word adds at each place of the window."""
        return [np.einsum("vd,kdf->kvf", self.embed, w).astype(np.float32) for w in self.kernels]


def text_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word and its stems, and word counts by row.

    Words are runs of letters, digits and non-ASCII bytes, ASCII letters lowered. A word shorter than a stem
    stands for it.
    """
    low = data.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    letter = ((low >= 97) & (low <= 122)) | (low >= 128) | ((low >= 48) & (low <= 57))
    low[~letter] = 32
    start, end, row = word_spans(low, off)
    return (word_hashes(low, start, end, STEMS) & np.uint64(BUCKETS - 1)).astype(np.int32), np.bincount(row, minlength=len(off) - 1)


def _pooled(ids: np.ndarray, counts: np.ndarray, tables: list[np.ndarray], model: Cnn, want_places: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Max-pooled responses by row (rows without a window: 0) and the word at which each maximum's window starts."""
    ends = np.cumsum(counts)
    starts = ends - counts
    pooled, places = [], []
    for tab, bias in zip(tables, model.biases, strict=True):
        width = len(tab)
        have = np.flatnonzero(counts >= width)
        res = np.zeros((len(counts), tab.shape[2]), np.float32)
        place = np.full((len(counts), tab.shape[2]), -1, np.int64)
        if len(have):
            n = len(ids) - width + 1
            if width == 1:
                conv = tab[0][ids[:, 0]]
                for k in range(1, ids.shape[1]):
                    np.maximum(conv, tab[0][ids[:, k]], out=conv)
            else:
                conv = tab[0][ids[:n, 0]]
                for k in range(1, width):
                    conv += tab[k][ids[k : k + n, 0]]
            # windows that cross into the next row never win
            for back in range(1, width):
                at = ends[counts > 0] - back
                conv[at[(at >= 0) & (at < n)]] = -np.inf
            rows = np.flatnonzero((counts > 0) & (starts < n))
            res_rows = np.maximum.reduceat(conv, starts[rows], axis=0)
            ok = counts[rows] >= width
            res[rows[ok]] = np.maximum(res_rows[ok] + bias, 0)
            if want_places:
                for r, top in zip(rows[ok], res_rows[ok], strict=True):
                    place[r] = starts[r] + (conv[starts[r] : ends[r] - width + 1] >= top).argmax(axis=0)
        pooled.append(res)
        places.append(place)
    return pooled, places


def logits(ids: np.ndarray, counts: np.ndarray, model: Cnn, tables: list[np.ndarray]) -> np.ndarray:
    pooled, _ = _pooled(ids, counts, tables, model)
    return np.concatenate(pooled, axis=1) @ model.out + model.out_bias


def _batches(order: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows with about STEP_WORDS words, 64 rows at most."""
    i = 0
    while i < len(order):
        total, j = 0, i
        while j < len(order) and j - i < 64 and (j == i or total + counts[order[j]] <= STEP_WORDS):
            total += counts[order[j]]
            j += 1
        yield order[i:j]
        i = j


def frequent(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of the buckets that enough rows have; 0 for all others."""
    seen = np.zeros(BUCKETS, np.int32)
    for part in np.split(ids, np.cumsum(counts)[:-1]):
        seen[np.unique(part)] += 1
    lookup = np.zeros(BUCKETS, np.int32)
    kept = np.flatnonzero(seen >= RARE)
    lookup[kept] = np.arange(1, len(kept) + 1)
    return lookup


def fit(ids: np.ndarray, counts: np.ndarray, label: np.ndarray, lookup: np.ndarray, seed: int = 3) -> Cnn:
    """Adagrad on the logistic loss, classes weighted alike; max pooling sends gradients to the winning windows."""
    rng = np.random.default_rng(seed)
    embed = rng.standard_normal((int(lookup.max()) + 1, DIMS)) * 0.02
    embed[0] = 0
    model = Cnn(
        lookup, embed.astype(np.float32), [(rng.standard_normal((w, DIMS, f)) * (0.6 / np.sqrt(w))).astype(np.float32) for w, f in FILTERS],
        [np.zeros(f, np.float32) for _, f in FILTERS], (rng.standard_normal(sum(f for _, f in FILTERS)) * 0.2).astype(np.float32), 0.0,
    )
    if not len(label) or label.min() == label.max():
        model.out[:] = 0
        model.out_bias = 4.0 if len(label) and label[0] else -4.0
        return model
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-6), 0.5 / max(1 - label.mean(), 1e-6))
    memory = {k: 1e-3 * np.ones_like(v) for k, v in [("e", model.embed), ("o", model.out), *((f"k{i}", k) for i, k in enumerate(model.kernels)), *((f"b{i}", b) for i, b in enumerate(model.biases))]}
    memory["ob"] = np.full(1, 1e-3)
    starts = np.cumsum(counts) - counts

    def step(key: str, value: np.ndarray, grad: np.ndarray, rate: float, at: np.ndarray | None = None) -> None:
        if at is None:
            memory[key] += grad**2
            value -= rate * grad / np.sqrt(memory[key])
        else:
            memory[key][at] += grad**2
            value[at] -= rate * grad / np.sqrt(memory[key][at])

    for epoch in range(EPOCHS):
        rate = 0.08 / (1 + 0.5 * epoch)
        order = rng.permutation(np.flatnonzero(counts > 0))
        for rows in _batches(order, counts):
            n = counts[rows]
            words = ids[np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            seen, local = np.unique(words, return_inverse=True)
            local = local.reshape(words.shape)
            vec = model.embed[seen]
            tabs = [np.einsum("vd,kdf->kvf", vec, w) for w in model.kernels]
            pooled, places = _pooled(local, n, tabs, model, True)
            hidden = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            err = ((p - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = err[:, None] * model.out[None]
            grad_vec = np.zeros_like(vec)
            at = 0
            updates = []
            for i, (kernel, res, place) in enumerate(zip(model.kernels, pooled, places, strict=True)):
                f = res.shape[1]
                g = back[:, at : at + f] * (res > 0)
                at += f
                r, c = np.nonzero((g != 0) & (place >= 0))
                gv, where = g[r, c], place[r, c]
                grad_kernel = np.zeros_like(kernel)
                for k in range(len(kernel)):
                    w = local[where + k, 0]
                    if len(kernel) == 1:  # of a word and its stems, the one that won
                        both = local[where]
                        w = both[np.arange(len(both)), tabs[i][0][both, c[:, None]].argmax(axis=1)]
                    np.add.at(grad_kernel[k].T, c, gv[:, None] * vec[w])
                    np.add.at(grad_vec, w, gv[:, None] * kernel[k].T[c])
                updates.append((f"k{i}", kernel, grad_kernel))
                updates.append((f"b{i}", model.biases[i], g.sum(axis=0)))
            step("o", model.out, hidden.T @ err + 1e-5 * model.out, rate)
            bias = np.array([model.out_bias])
            step("ob", bias, np.array([err.sum()]), rate)
            model.out_bias = float(bias[0])
            for key, value, grad in updates:
                step(key, value, grad, rate)
            grad_vec[seen == 0] = 0
            step("e", model.embed, grad_vec, rate, seen)
    return model


def _threshold(logit: np.ndarray, label: np.ndarray, prior: float) -> float:
    """The cut with the best F1, in the middle of its gap, drawn towards the prior: the fewer rows of label 1 set it, the
    more. Where a class is missing it is the prior."""
    n = int(label.sum())
    if n in (0, len(label)):
        return prior
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + n)
    k = int(np.argmax(f1))
    low = logit[order[k + 1]] if k + 1 < len(order) else logit[order[k]] - 1
    return float((n * (logit[order[k]] + low) / 2 + HALF_ROWS * prior) / (n + HALF_ROWS))


def _language_table(ids: np.ndarray, counts: np.ndarray, lang: np.ndarray, n: int, rows: int) -> np.ndarray:
    row = np.repeat(lang.astype(np.int32), counts)
    seen = np.full((rows, n), 0.5, np.float32)  # counts of words stay far below 2^24
    for i in range(0, len(ids), 100_000):
        np.add.at(seen, (ids[i : i + 100_000, 0], row[i : i + 100_000]), 1)
    p = seen / seen.sum(axis=0, dtype=np.float64).astype(np.float32)
    p[0] = 1.0
    np.log(p, out=p)
    return p - p.mean(axis=1, keepdims=True)


def guess_language(ids: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The likeliest language of each row by its words; the first for rows without words."""
    total = np.zeros((len(counts), words.shape[1]))
    have = np.flatnonzero(counts)
    if len(have):
        total[have] = np.add.reduceat(words[ids[:, 0]], (np.cumsum(counts) - counts)[have], axis=0)
    return total.argmax(axis=1)


def _sample_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """text_words of the texts, some at a time."""
    ids, at, counts = np.empty((max(1, texts.nbytes // 5), 1 + len(STEMS)), np.int32), 0, []
    for _, _, data, off in text_slices(texts, SCORE_BYTES):
        part, n = text_words(data, off)
        if at + len(part) > len(ids):
            ids.resize((max(at + len(part), len(ids) * 5 // 4), ids.shape[1]), refcheck=False)
        ids[at : at + len(part)] = part
        at += len(part)
        counts.append(n)
    ids.resize((at, ids.shape[1]), refcheck=False)
    return ids, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def train(sample: pa.Table) -> Cnn:
    """sample: text, label, lang. Fits on three rows of four; the thresholds of the languages are set on the fourth."""
    nth = np.arange(sample.num_rows)
    sample = sample.take(pa.array(np.argsort(nth % 4 != 0, kind="stable")))  # the fourth first, so that parts are views
    label, lang = (sample.column("label").to_numpy() == 1).astype(np.int64), sample.column("lang").to_pylist()
    ids, counts = _sample_words(sample.column("text"))
    del sample
    names = sorted(set(lang))
    code = np.array([names.index(x) for x in lang], np.int64)
    fold = -(-len(label) // 4)
    cut = int(counts[:fold].sum())
    lookup = frequent(ids[cut:], counts[fold:])
    for i in range(0, len(ids), 100_000):
        ids[i : i + 100_000] = lookup[ids[i : i + 100_000]]
    model = fit(ids[cut:], counts[fold:], label[fold:], lookup)
    if len(label):
        model.lang_words = _language_table(ids, counts, code, len(names), len(model.embed))
        guess = guess_language(ids[:cut], counts[:fold], model.lang_words)
        tables, ends = model.responses(), np.concatenate(([0], np.cumsum(counts[:fold])))
        z = np.concatenate([logits(ids[ends[i] : ends[min(i + 100, fold)]], counts[i : min(i + 100, fold)], model, tables) for i in range(0, fold, 100)])
        y = label[:fold]
        pooled = _threshold(z, y, 0.0)
        model.thresholds = np.array([_threshold(z[guess == k], y[guess == k], pooled) for k in range(len(names))])
    return model


def score_texts(data: np.ndarray, off: np.ndarray, model: Cnn, tables: list[np.ndarray]) -> np.ndarray:
    """Scores of the rows' texts; 0.5 is the threshold of the row's language."""
    ids, counts = text_words(data, off)
    ids = model.lookup[ids]
    z = logits(ids, counts, model, tables) - model.thresholds[guess_language(ids, counts, model.lang_words)] if len(ids) else np.full(len(counts), model.out_bias - model.thresholds[0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether a row is in the fold that labels are not learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> pa.Table:
    """A bounded sample of the labelled rows that are not held out: text, label, lang."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label is not null").groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    rows = rows.where(~held_out("id") & (F.octet_length("text") > 0))
    return bounded_sample(rows, 1, SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_WINDOW, known).select(["text", "label", "lang"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", model: Cnn | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, k_id, k_hash.

    labels has the ids' labels (of several, the largest counts; null ones do not). Without labels of both
    classes all scores are alike. A null or empty text scores as a text without words. Rows may repeat; an
    empty table gives an empty result. Columns but the named ones are not read.
    """
    if model is None:
        model = train(training_rows(docs, labels, id_col, text_col, lang_col, label_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS numbers and the sample's words
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("k_id", pa.int64()), ("k_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        tables = m.responses()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, j, data, off in text_slices(batch.column("text"), SCORE_BYTES):
                out[i:j] = score_texts(data, off, m, tables)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), batch.column("k_id"), batch.column("k_hash")], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", "text", held_out("doc_id").alias("held_out"), *row_key()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, k_id long, k_hash long")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more, with all their columns; one pass over the texts, no join."""
    model = train(training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = shared.value
        tables = m.responses()
        for batch in batches:
            keep = np.empty(batch.num_rows, bool)
            for i, j, data, off in text_slices(batch.column("text"), SCORE_BYTES):
                keep[i:j] = score_texts(data, off, m, tables) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
