import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from reference_models import AWKWARD, crc, generated, targets

from veritrail.llm import ann_search, bpe, language_id, mixing, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, shard string, size string"


def frame(spark, rows, source="a"):
    return spark.createDataFrame([(d, t, "en", source, "x", "y") for d, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [AWKWARD, generated(100), [(i, f"pair {i // 2}") for i in range(96)], [(i, "copy") for i in range(70)] + [(i, str(i)) for i in range(70, 100)]], ids=["awkward", "generated", "pairs", "hot"])
def test_shards(spark, rows):
    found = sharding.shard_documents(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in rows)
    sizes = Counter(r.shard for r in found)
    counts = [sizes.get(s, 0) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = defaultdict(set)
    for d, t in rows:
        text[d].add((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert all((r.size, r.text_crc32) in text[r.doc_id] and r.law == "rows" and r.grown_shard is None for r in found)


def test_shards_keep_copies_together(spark):
    rows = [(i, f"pair {i // 2}") for i in range(480)]
    by = defaultdict(set)
    for r in sharding.shard_documents(frame(spark, rows)).collect():
        by[r.doc_id // 2].add(r.shard)
    assert sum(len(v) == 1 for v in by.values()) > 0.8 * len(by)


def mixed_frame(spark, n=600):
    rows = [(i, t, "en", [None, "a", "b", "c", "d"][i % 5 if i % 3 else 1], "", "") for i, t in generated(n, 2)] + [(9000, None, None, "a", "", ""), (9001, "", None, None, "", ""), (9002, "a b", None, "zero", "", ""), (9003, "", None, "none", "", "")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("group_rows", [4096, 5])
def test_mixing(spark, group_rows):
    df, rows = mixed_frame(spark)
    found = mixing.mix_sources(df, group_rows=group_rows).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _, _ in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    longest = max(len((t or "").split()) for _, t, *_ in rows)
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    again = mixing.mix_sources(df.repartition(7), group_rows=group_rows).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)
    counted = Counter(r.doc_id for r in mixing.mixed_rows(df, group_rows=group_rows).collect())
    assert counted == {r.doc_id: r.copies for r in found if r.copies}


def test_pivot_keeps_words():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        sizes, probs = rng.integers(1, 50, n).tolist(), rng.random(n).tolist()
        out, held = mixing._pivot(list(range(n)), sizes, probs, int(rng.integers(1000)), 0)
        assert abs(sum(s * p for s, p in zip(sizes, out, strict=True)) - sum(s * p for s, p in zip(sizes, probs, strict=True))) < 1e-6
        assert all(p in (0.0, 1.0) for k, p in enumerate(out) if k != held)


def test_bpe_equals_library(spark, tiny):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own = Tokenizer.from_file(path), bpe.TrieBpe(path)
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + [t or "" for _, t in AWKWARD]
    texts += ["<|endoftext|>x<|startoftext|>", "İ ΣΑΣ ẞ ﬁ", "안녕 กข", "it's WE'LL 12½", "Ᲊ ՘ Ɤ", "é é", "👩‍👩‍👧"]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    rows = {(r.doc_id, r.n_tokens) for r in bpe.encode_documents(frame(spark, AWKWARD), bpe.default_vocabulary(), full=True).collect()}
    assert (1, 0) in rows and (2, 0) in rows and len({d for d, _ in rows}) == 15
    assert bpe.encode_documents(frame(spark, AWKWARD).limit(0), bpe.default_vocabulary()).count() == 0


def test_ann_recall_and_edges(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    found = defaultdict(list)
    for r in ann_search.op1_ann_search(spark, small).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([r.vec_id for r in e])
    x = np.array([r.embedding for r in e], dtype=np.float64)
    hit = total = 0
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    for q, got in found.items():
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 21))
        hit += len({v for _, v, _ in got} & set(ids[order].tolist()))
        total += 20
        assert all(abs(v - s[ids == i][0]) < 1e-12 for _, i, v in got)
    assert hit / total >= 0.9


def test_ann_awkward(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (1, [1.0, None]), (2, []), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (None, [1.0, 1.0]), (4, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_search.nearest_neighbours(df).collect()]
    assert sorted(got) == [(0, 1, 3), (0, 2, 3), (0, 3, 20), (20, 1, 3), (20, 2, 3), (20, 3, 0)]  # both rows with id 3 are candidates
    assert ann_search.nearest_neighbours(df.limit(0)).count() == 0


def brute_force(rows, k=20, every=20):
    """(query_id, rank, vec_id) by all pairs; rows: id, vector."""
    out = []
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(rows) if b != a and len(w) == len(v))
            out += [(i, n + 1, j) for n, (_, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    [(i, [1.0, 2.0]) for i in range(60)],  # one vector only: ties go to the smaller id
    [(i // 2, [float(i % 3), 1.0]) for i in range(70)],  # repeated ids, repeated vectors
    [(i, [float(i % 7), 1.0, -1.0][: 2 + i % 2]) for i in range(80)],  # two lengths
], ids=["equal", "repeats", "lengths"])
def test_ann_ties(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, row string, list int").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_search.nearest_neighbours(df).collect()]
    assert sorted(got) == brute_force(rows)


@pytest.mark.parametrize("spread", [0.25, 3.0], ids=["clusters", "even"])
def test_ann_recall_of_many(spark, spread):
    """50,000 vectors in many lists, in clusters and nearly without any."""
    rng = np.random.default_rng(1)
    n, dims = 50_000, 32
    x = (rng.standard_normal((200, dims))[rng.integers(0, 200, n)] + spread * rng.standard_normal((n, dims))).astype(np.float32)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dims + 1, dims, dtype=np.int32)), pa.array(x.ravel()))
    found = ann_search.nearest_neighbours(spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": flat})), query_every=200).toPandas()
    x, q = x.astype(np.float64), np.arange(0, n, 200)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-near, axis=1)[:, :20]
    by = {k: set(v) for k, v in found.groupby("query_id")["vec_id"]}
    assert len(found) == 20 * len(q)
    assert sum(len(by[a] & set(t.tolist())) for a, t in zip(q.tolist(), top, strict=True)) / (20 * len(q)) >= 0.9


def test_language_held_out(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = language_id.op4_language_id(spark, small).collect()
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_language_awkward(spark):
    df = spark.createDataFrame([(d, t, "en" if (d or 0) % 2 else "fr", None, "", "") for d, t in AWKWARD], SCHEMA)
    found = {(r.doc_id, r.lang_pred) for r in language_id.identify_languages(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (11, "und")} <= found
    assert language_id.identify_languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}


def test_toxicity_finds_planted_words(spark):
    rows = [(i, t + (" vile scoundrel" if i % 4 == 0 else "")) for i, t in generated(400, 9)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.9
    assert toxicity.toxicity_scores(frame(spark, AWKWARD), labels).count() == len(AWKWARD)
    assert toxicity.toxicity_scores(docs.limit(0), labels.limit(0)).count() == 0
