"""Long texts, null ids, repeated rows and ties of every operator on documents, against plain versions; the classifiers'
arithmetic by hand; real held-out labels."""

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from reference_models import AWKWARD, crc, generated, simhash, substring, suffix
from test_dedup import frame

from veritrail.llm import bpe, exact_dedup, language_id, mixing, sharding, simhash_dedup, substring_dedup, suffix_dedup, toxicity


def long_rows(seed=3):
    """Two texts of 25,000 words that share a middle part, one word of 200,000 letters, and rows that repeat."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    middle = [word() for _ in range(5000)]
    texts = [" ".join([word() for _ in range(10_000)] + middle + [word() for _ in range(10_000)]) for _ in range(2)]
    return [(100, texts[0]), (101, texts[1]), (102, "y" * 200_000), (103, "tie tie"), (104, "tie tie"), (105, texts[0])]


ROWS = [(d, t) for d, t in AWKWARD if d is not None and d != 14] + long_rows()
UNIQUE = list(dict(ROWS).items())


def test_substring_and_suffix(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_words(frame(spark, UNIQUE)).collect()}
    assert got == substring(UNIQUE)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_bytes(frame(spark, UNIQUE)).collect())
    assert got == sorted(suffix(UNIQUE))


def test_null_and_shared_ids(spark):
    """A null id stands first; of two texts with one id, the places of each are their own."""
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(None, f"a {passage} b"), (7, f"c {passage} d"), (7, f"e f {passage}")]
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_words(frame(spark, rows)).collect())
    assert got == [(False, 42, 40), (False, 42, 40), (True, 42, 0)]
    assert sorted(r.n_removed > 0 for r in suffix_dedup.remove_repeated_bytes(frame(spark, [(d, t * 9) for d, t in rows])).collect()) == [True] * 3


def test_simhash(spark):
    got = {(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash_dedup.simhash_components(frame(spark, UNIQUE)).collect()}
    assert got == set(simhash(UNIQUE))


def test_exact(spark):
    rows = exact_dedup.exact_duplicates(frame(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in ROWS)
    assert {(r.doc_id, r.keep_id) for r in rows if r.doc_id in (100, 103, 104, 105)} == {(100, 105), (105, 105), (103, 104), (104, 104)}


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(frame(spark, AWKWARD + long_rows()), bpe.default_vocabulary(), full=True).collect())
    want = Counter((d, tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)) for d, t in AWKWARD + long_rows() for e in [library.encode(t or "", add_special_tokens=False)])
    assert found == want


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_RUNS", 20)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    small, large = bpe.TrieBpe(bpe.default_vocabulary()), bpe.TrieBpe(bpe.default_vocabulary())
    texts = [t for _, t in generated(40, 5)]
    got = [small.coded(texts[i : i + 3]) for i in range(0, 40, 3)]
    monkeypatch.undo()
    assert sum(got, []) == large.coded(texts) and len(small.ids_of) < len(large.ids_of)


def test_bpe_words_known_as_runs():
    """Words of letters skip the splitter and words met as runs are not encoded again; both are as the library has them."""
    from tokenizers import Tokenizer

    vocabulary = bpe.default_vocabulary()
    library, mine = Tokenizer.from_file(vocabulary), bpe.TrieBpe(vocabulary)
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) != "Cn"]
    assert [c for c in known if c.isalpha() != bool(regex.match(r"\p{L}", c))] == []
    encoded = []
    plain = mine.encode_words
    mine.encode_words = lambda words: encoded.append(sorted(words)) or plain(words)
    texts = ["antidisestablishment señor o'clock", "antidisestablishment, señor. o'clock! '' x_ 's 4- ''s", "antidisestablishment() (señor) don't.", "", "´´ <|endoftext|>, ."]
    assert [[int(x) for x in mine.coded([t])[0]] for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum("antidisestablishment" in words for words in encoded) == 1


def test_bpe_gives_memory_back(monkeypatch):
    """After each batch, so that a worker does not keep the size of its largest ones."""
    calls = []
    monkeypatch.setattr(bpe, "give_back", lambda: calls.append(1), raising=False)
    texts = [t for _, t in generated(6, 7)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts, "k_id": list(range(6)), "k_hash": [0] * 6})
    out = list(bpe._encode(bpe.default_vocabulary(), False)(iter([batch, batch.slice(0, 2)])))
    assert [b.num_rows for b in out] == [6, 2] and len(calls) == 2


def test_shards_and_mix(spark):
    rows = AWKWARD + long_rows()
    found = sharding.shard_documents(frame(spark, rows), shards=5).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in found) == Counter((d, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes, slots = Counter(r.shard for r in found), defaultdict(set)
    for r in found:
        slots[r.shard].add(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(slots[s] == set(range(n)) for s, n in sizes.items())
    mixed = mixing.mix_sources(frame(spark, rows)).collect()
    words = {d: len((t or "").split()) for d, t in rows}
    assert Counter(r.doc_id for r in mixed) == Counter(d for d, _ in rows) and all(r.taken in (0, r.size, 2 * r.size) for r in mixed)
    assert abs(sum(r.taken for r in mixed) - mixed[0].target) <= max(words.values())


# ----------------------------------------------------------------------------- classifiers


def plain_language(text, model):
    """(language, score) of one text: trigrams in a dictionary, machines one by one."""
    raw = text.encode()
    folded = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in raw]
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
            folded[i] += 32
    folded = [b for i, b in enumerate(folded) if not (b == 32 and i and folded[i - 1] == 32)]
    count = Counter()
    for a, b, c in zip(folded, folded[1:], folded[2:], strict=False):
        count[(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 19] += 1
    length = sum(count.values()) ** 0.5 or 1.0
    x = {k: n**0.5 / length for k, n in count.items()}
    dot = lambda w: sum(v * float(w[k]) for k, v in x.items()) + float(w[-1])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    margins = [dot(w) for w in model.family]
    g = int(np.argmax(margins))
    score = sigmoid(2 * max(margins)) if len(margins) > 1 else 1.0
    votes, sums = defaultdict(float), defaultdict(float)
    for (a, b), w in model.pairs.items():
        if a in model.groups[g]:
            z = dot(w)
            votes[a if z >= 0 else b] += 1
            sums[a] += z
            sums[b] -= z
    best = max(model.groups[g], key=lambda k: (votes[k], np.tanh(sums[k])))
    others = len(model.groups[g]) - 1
    return model.languages[best], score * (sigmoid(2 * sums[best] / others) if others else 1.0)


def test_language_by_hand(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    some = [(r.doc_id, r.text) for r in docs.where("length(text) > 20").orderBy("doc_id").limit(25).collect()] + [(100, long_rows()[0][1])]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(frame(spark, some), model=model).collect()}
    for d, t in some:
        lang, score = plain_language(t, model)
        assert found[d][0] == lang and abs(found[d][1] - score) < 1e-3


def plain_toxicity(text, model):
    """The score of one text: every window of every filter by itself."""
    raw = text.encode()
    ids, counts = toxicity.text_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    ids = model.lookup[ids]
    hidden = []
    for kernel, bias in zip(model.kernels, model.biases, strict=True):
        width, _, filters = kernel.shape
        for f in range(filters):
            best = None
            for i in range(len(ids) - width + 1):
                if width == 1:  # a word and its stems
                    z = max(float(model.embed[k] @ kernel[0, :, f]) for k in ids[i])
                else:
                    z = sum(float(model.embed[ids[i + j, 0]] @ kernel[j, :, f]) for j in range(width))
                best = z if best is None else max(best, z)
            hidden.append(max(best + float(bias[f]), 0) if best is not None else 0)
    lang = int(np.argmax(model.lang_words[ids[:, 0]].sum(axis=0))) if len(ids) else 0
    return 1 / (1 + np.exp(-(float(np.dot(hidden, model.out)) + model.out_bias - model.thresholds[lang])))


def test_toxicity_by_hand(spark):
    rows = [(i, t + (" vile scoundrel" if i % 4 == 0 else "")) for i, t in generated(300, 9)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(frame(spark, rows), labels))
    some = rows[:15] + [(1000, ""), (1001, "x"), (1002, None)]
    found = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame(spark, some), labels, model=model).collect()}
    assert all(abs(found[d] - plain_toxicity(t or "", model)) < 1e-3 for d, t in some)


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in toxicity.op5_toxicity(spark, folder).collect() if r.held_out and r.doc_id in label]
    assert all(crc(r.doc_id) % 5 == 0 for r in found)
    toxic, clean = ([r.predicted for r in found if label[r.doc_id] == k] for k in (1, 0))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.05 * len(clean)


@pytest.mark.parametrize("rows, most", [([(5, "a b c")] * 50, 10), ([(None, "copy of one text")] * 50, 10), ([(i, "w " * 3000) for i in range(50)], 50)], ids=["one row", "null id", "long"])
def test_training_sample_is_bounded(spark, rows, most):
    """Repeats of a row, or rows without an id, do not fill the driver; a text's window has no more than its bound."""
    picked = language_id.bounded_sample(frame(spark, rows).selectExpr("doc_id as id", "text", "lang"), 2, 4000, 30_000_000, 100)
    assert 0 < picked.num_rows <= most and all(len(t) <= 100 for t in picked.column("text").to_pylist())
