"""The pipeline's stages, each on what its predecessor wrote, against plain versions where these exist; run() against the
stages. What toxicity drops, mixing takes and encoding gives is tested with the operators."""

import os
import shutil
from collections import Counter

import corpus_pipeline
from test_near_dedup import kept_by_all_pairs, planted, similarities

from veritrail.llm._common import materialize
from veritrail.llm.bpe import default_vocabulary, encode_documents


def rows_of(docs):
    return Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_stages_and_run(spark, tiny, tmp_path):
    shutil.copy(f"{tiny}/labels.parquet", tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    near = [(100_000 + d, t) for d, t in planted()]
    more = [(d, t, "en", "planted", len(t)) for d, t in near + [(200_000 + d, t) for d, t in near[:20]]]
    added = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(added).write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(0.8 <= s < 0.95 for s in similarities(near)) > 20
    folder, seen = str(tmp_path), {}
    at = spark.read.parquet(f"{folder}/documents.parquet")
    seen["input"] = rows_of(at)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = materialize(stage(spark, at, folder), f"test-{name}")
        seen[name] = rows_of(at)
    last = corpus_pipeline.STAGES[-1][1](spark, at, folder).collect()
    assert not seen["toxicity"] - seen["input"] and seen["toxicity"]
    largest = {}
    for d, t in seen["toxicity"]:
        largest[t] = max(d, largest.get(t, d))
    assert seen["exact_dedup"] == Counter((d, t) for t, d in largest.items())
    assert sorted((d for d, _ in seen["simhash_near_dedup"].elements()), key=str) == kept_by_all_pairs(list(seen["exact_dedup"]))
    assert not set(seen["mixing"]) - set(seen["simhash_near_dedup"]) and seen["mixing"]
    assert Counter(r.doc_id for r in last) == Counter(d for d, _ in seen["mixing"].elements())
    words = encode_documents(spark.createDataFrame(list(seen["mixing"]), "doc_id long, text string"), default_vocabulary()).collect()
    assert {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in last} == {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in words}
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, last))


def test_tables_between_steps_have_no_checksum_files(spark):
    """Each such file costs a process that counts the JVM's memory as its own while it starts."""
    rows = spark.range(100).selectExpr("id", "id % 3 AS part")
    for by in (None, "part"):
        t = materialize(rows, "test-plain", by)
        files = [f for _, _, names in os.walk(t._veritrail_path.removeprefix("file://")) for f in names]
        assert any(f.endswith(".parquet") for f in files) and not any(f.endswith(".crc") for f in files)
        assert sorted(map(tuple, t.select("id", "part").collect())) == [(i, i % 3) for i in range(100)]
