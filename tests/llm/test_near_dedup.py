"""The pipeline's near-duplicate stage against all pairs of whole shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pytest
from reference_models import AWKWARD
from test_dedup import frame

from veritrail.llm import near_dedup


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}


def kept_by_all_pairs(rows):
    """Ids that stay: of each group linked by a similarity of 4/5 or more, the smallest (null only if all are)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((rows[i][0] for i in range(len(rows)) if find(i) == i), key=str)


def planted(seed=0):
    """Texts with chains of copies in which some words differ: similarities from below 0.8 to nearly 1."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for _ in range(25):
        text = [word() for _ in range(r.choice([4, 30, 120, 400]))]
        rows.append(" ".join(text))
        for changes in r.sample([1, 1, 2, 3, 4, 5, 6, 8, 10, 14], 4):
            copy = list(text)
            for at in r.sample(range(len(copy)), min(len(copy), changes)):
                copy[at] = word()
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return list(enumerate(rows))


def similarities(rows):
    sets = [shingle_set(t) for _, t in rows]
    return [len(a & b) / len(a | b) for j, a in enumerate(sets) for b in sets[:j] if a & b]


def test_near_copies_from_08(spark):
    rows = planted() + [(None if d is None else 1000 + d, t) for d, t in AWKWARD]
    assert sum(0.8 <= s < 0.95 for s in similarities(rows)) > 20 and any(0.7 < s < 0.8 for s in similarities(rows))
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == kept_by_all_pairs(rows)


def test_large_group(spark):
    """A chain of copies, each with one more word changed, is one group though its ends differ."""
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(180):
        text[i] = f"x{i}"
        rows.append((i, " ".join(text)))
    found = near_dedup.near_components(frame(spark, rows)).select("root").distinct().count()
    assert found == 1


@pytest.mark.parametrize("rows_a_pair, block", [(16, 1000), (2, 7)])
def test_large_loose_group(spark, monkeypatch, rows_a_pair, block):
    """Copies of one text at many distances: some only link through others, some to none."""
    monkeypatch.setattr(near_dedup, "PAIR_ROWS", rows_a_pair)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    r = random.Random(4)
    text, rows = [f"w{i}" for i in range(150)], []
    for i in range(120):
        copy = list(text)
        for at in r.sample(range(150), r.randrange(1, 9)):
            copy[at] = f"x{r.random()}"
        rows.append((i, " ".join(copy)))
    kept = near_dedup.keep_one_of_each_near(frame(spark, rows))
    assert sorted((x.doc_id for x in kept.collect()), key=str) == kept_by_all_pairs(rows)


def test_bucket_links():
    sets = [np.arange(i * 4, i * 4 + 40, dtype=np.uint64) for i in range(20)] + [np.arange(500, 520, dtype=np.uint64)]
    found = near_dedup._bucket_links(sets, np.arange(21))
    assert len(found) == 19 and all(abs(a - b) == 1 for a, b in found)
