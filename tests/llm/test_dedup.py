import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from reference_models import AWKWARD, generated, simhash, substring, suffix

from veritrail.llm import exact_dedup, simhash_dedup, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, size string, k_id int, rid string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "s", 0, "r", "en", "a", 1) for d, t in rows], SCHEMA).repartition(3)


def texts(spark, folder):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def exact_model(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    low = lambda d: -1 if d is None else d
    return Counter((d, max(groups[t or ""], key=low), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


@pytest.mark.parametrize("rows", [AWKWARD, generated(), [(i, "copy") for i in range(50)]], ids=["awkward", "generated", "copies"])
def test_exact(spark, rows):
    found = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == exact_model(rows)
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_levels(spark):
    """Long texts that differ in one byte or in length only take several levels of names."""
    base = "ab" * 700
    rows = [(i, base[: 1400 - i % 3] + ("x" if i % 5 == 0 else "")) for i in range(20)] + [(99, base[:700] + "z" + base[701:])]
    ids = exact_dedup.block_identities(frame(spark, rows), block_bytes=64).collect()
    by_text = dict(rows)
    names = defaultdict(set)
    for r in ids:
        names[r.n_bytes, r.name].add(by_text[r.doc_id])
    assert all(len(v) == 1 for v in names.values()) and len(names) == len(set(by_text.values()))


def test_exact_keeps_columns(spark):
    kept = exact_dedup.keep_one_of_each(frame(spark, AWKWARD))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert Counter((r.text or "") for r in kept.collect()) == Counter({t or "" for _, t in AWKWARD})


def test_empty(spark):
    empty = frame(spark, AWKWARD).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert simhash_dedup.simhash_components(empty).count() == 0
    assert substring_dedup.remove_repeated_words(empty).count() == 0
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


@pytest.mark.parametrize("node_rows", [4096, 3])
@pytest.mark.parametrize("rows", [AWKWARD, generated(200, 3)], ids=["awkward", "generated"])
def test_simhash(spark, rows, node_rows):
    found = simhash_dedup.simhash_components(frame(spark, rows), node_rows=node_rows).collect()
    assert sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in found), key=str) == simhash(rows)


def test_trie_links_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([centres] + [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for c in centres for k in (1, 2, 3, 4, 5, 6)] and
                  [centres, *[np.array([c ^ np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64))]) for c in centres for k in (1, 2, 3, 4, 5, 6)]]))
    i, j = simhash_dedup.trie_links(fp, np.array([0, len(fp)]))
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 4}
    got = [(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert set(got) == want and len(got) == len(want)


def test_simhash_keeps_one(spark):
    rows = [r for r in generated(150, 5)]
    kept = {r.doc_id for r in simhash_dedup.keep_one_of_each_component(frame(spark, rows)).collect()}
    assert kept == {c for _, _, c in simhash(rows)}


@pytest.mark.parametrize("limit", [4000, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_substring(spark, limit, seed):
    rows = generated(120, seed) + [(1000, None), (1001, ""), (1002, "a b " * 60), (1003, "a b " * 60)]
    found = substring_dedup.remove_repeated_words(frame(spark, rows), bucket_pieces=limit).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == substring(rows)
    assert any(v[1] for v in substring(rows).values())


@pytest.mark.parametrize("limit", [4000, 1])
@pytest.mark.parametrize("seed", [0, 1])
def test_suffix(spark, limit, seed):
    rows = generated(120, seed) + [(1000, None), (1001, ""), (1002, "ab" * 400), (1003, "ü" * 500), (1004, "\x00" * 401), (1005, "q"), (1005, "q")]
    found = suffix_dedup.remove_repeated_bytes(frame(spark, rows), bucket_pieces=limit).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == Counter(suffix(rows))


def test_awkward_rows_do_not_crash(spark):
    assert substring_dedup.remove_repeated_words(frame(spark, AWKWARD)).count() == len(AWKWARD)
    assert suffix_dedup.remove_repeated_bytes(frame(spark, AWKWARD)).count() == len(AWKWARD)


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    t = np.concatenate((rng.integers(1, 4, 3000).astype(np.uint8), [0])).astype(np.uint8)
    order = suffix_dedup.suffix_array(t, 400)
    assert sorted(order.tolist()) == list(range(len(t)))
    raw = t.tobytes()
    assert order.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])


def test_whole_tables(spark, tiny):
    rows = texts(spark, tiny)
    found = substring_dedup.op2_substring_dedup(spark, tiny).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == substring(rows)
    found = suffix_dedup.op6_suffix_dedup(spark, tiny).collect()
    assert Counter(tuple(r) for r in found) == Counter(suffix(rows))
    found = simhash_dedup.op9_simhash_near_dedup(spark, tiny).collect()
    assert sorted((tuple(r) for r in found), key=str) == simhash(rows)
