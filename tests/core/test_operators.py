import numpy as np
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import claims as C
from veritrail.operators import retrieval as R
from veritrail.operators import transcripts as P
from veritrail.sources import store
from veritrail.streaming import ingest


def test_parse_transcript(spark):
    df = spark.createDataFrame([("v", "lead [00:05] Speaker 1: a [1:02:03] b [00:09] "), ("w", "no marker"), ("x", "[120:05] x")], "video_id string, transcript string")
    rows = {(r.video_id, r.start_seconds, r.end_seconds, r.speaker, r.text) for r in P.parse_transcripts(df).collect()}
    assert rows == {("v", 5.0, 3723.0, "Speaker 1", "a"), ("v", 3723.0, None, None, "b"), ("w", 0.0, None, None, "no marker"), ("x", 0.0, None, None, "[120:05] x")}


def packed(spark, counts):
    units = [(f"s{i}", n, 0.0, 1.0) for i, n in enumerate(counts, 1)]
    df = spark.createDataFrame([("v", units)], "video_id string, sentences array<struct<text:string,words:int,start:double,end:double>>")
    return [r.text for r in P.pack_chunks(df).orderBy("chunk_index").collect()]


def test_chunk_packing(spark):
    assert packed(spark, [20] * 10) == ["s1 s2 s3 s4 s5 s6 s7 s8 s9", "s7 s8 s10"]
    assert packed(spark, [200]) == ["s1"]
    assert packed(spark, [60, 60, 60]) == ["s1 s2 s3"]


def test_fusion(spark):
    one = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "question_id long, rank int, id long")
    two = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "question_id long, rank int, id long")
    rows = [(r.id, r.score, r.payload_list) for r in R.reciprocal_rank_fusion([one, two], 10).orderBy("rank").collect()]
    assert rows == [(11, round(1 / 61 + 1 / 62, 6), 1), (10, round(1 / 61, 6), 0), (12, round(1 / 62, 6), 1)]


def test_citations(spark):
    labels = F.array(F.lit("Source 1"), F.lit("Source 2"))
    df = spark.createDataFrame([("[Source 1] [Source 2] [Source 7]",), ("[Source 1 at 2:03]",), ("none",)], "a string")
    got = [tuple(r.r) for r in df.select(T.verify_citations(F.col("a"), labels).alias("r")).collect()]
    assert got == [(3, ["Source 1", "Source 2"], ["Source 7"], False), (3, ["Source 1", "Source 2"], ["Source 03"], False), (0, [], [], True)]


def test_evaluation(spark):
    rows = [(None, ["c1", "c2", "c3"], ["c1"]), (None, ["c2", "c3", "c5"], ["c5"]), (None, ["c2", "c3", "c4"], ["c9"])]
    df = spark.createDataFrame(rows, "category string, retrieved array<string>, expected array<string>")
    got = {r.category: (r.n, r.mrr, r.hit_at_1, r.hit_at_3, r.hit_at_5) for r in R.evaluate(df).collect()}
    assert got["(all)"] == got["unlabeled"] == (3, 0.444444, 0.333333, 0.666667, 0.666667)


def test_claim_validation(spark):
    import json

    claim = lambda kind, chunk: {"video_id": "v", "claim": "c", "claim_type": kind, "stance": "support", "evidence": [{"chunk_id": chunk, "evidence_text": "e"}], "topics": []}
    raw = "```json\n" + json.dumps([claim("fact", "c0"), claim("opinion", "c1"), claim("fact", "c9"), claim("bad", "c9")]) + "\n```"
    df = spark.createDataFrame([(1, raw), (2, "sorry"), (3, "{}")], "reply_id long, raw string")
    chunks = spark.createDataFrame([("c0",), ("c1",)], "chunk_id string")
    got = {(r.reply_id, r.pos): r.reason for r in C.validate_claims(df, chunks).collect()}
    assert got == {(1, 0): None, (1, 1): None, (1, 2): "unknown_chunk", (1, 3): "invalid_claim_type", (2, 0): "invalid_json", (3, 0): "invalid_json"}


def test_themes_and_clusters(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.94), (3, 4, 0.93)], "i long, j long, cosine double")
    assert [(r.i, r.j) for r in C.theme_match(pairs).orderBy("theme_no").collect()] == [(1, 2), (3, 4)]
    rows = [(1, 0, 0, "a", [1.0, 0.0]), (1, 1, 1, "a", [0.99, 0.1]), (1, 2, 2, "b", [1.0, 0.0])]
    got = C.cluster_greedy(spark.createDataFrame(rows, "workspace_id long, ord long, claim_id long, video string, vector array<double>")).orderBy("ord").collect()
    assert [r.cluster_no for r in got] == [0, 0, 1]


def test_context_dedup(spark):
    df = spark.createDataFrame([(1, 1, 5, "a b c"), (1, 2, 6, "a b c d e f g"), (1, 3, 7, "x y z")], "question_id long, rank int, id long, text string")
    assert [r.id for r in R.deduplicate_context(df).orderBy("label_no").collect()] == [5, 7]


def test_store(spark, tmp_path):
    p = str(tmp_path / "t")
    store.overwrite_workspace(spark.createDataFrame([("a", 1), ("b", 2)], "workspace_id string, x int"), p)
    store.overwrite_workspace(spark.createDataFrame([("a", 3)], "workspace_id string, x int"), p)
    assert {(r.workspace_id, r.x) for r in spark.read.parquet(p).collect()} == {("a", 3), ("b", 2)}
    assert store.delete_workspace(spark, p, "b") == 1 and store.delete_workspace(spark, p + "none", "b") == 0
    (tmp_path / "u.txt").write_text(" http://x \n\n# no\nhttp://y\n")
    assert [r.url for r in store.read_urls(spark, str(tmp_path / "u.txt")).collect()] == ["http://x", "http://y"]


def test_stream_is_idempotent(spark, tmp_path):
    schema = "video_ord long, content_hash string"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], schema)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        ingest.ingest_stream(spark, source, target, str(tmp_path / "c"), schema).awaitTermination()
    assert sorted((r.video_ord, r.content_hash) for r in spark.read.parquet(target).collect()) == [(1, "a"), (1, "a"), (2, "b")]


def test_retrieval_eval_of_short_items(spark, tmp_path):
    """Items of one or two words, and one whose inner words have no token, against SQL."""
    import duckdb

    from veritrail.plans import catalogue

    docs = [(1, "red apple pie"), (2, "green apple"), (3, "a -- b c"), (4, "red apple tart with cream"), (5, None)]
    items = [(1, "red apple"), (2, "apple"), (3, "a -- b"), (4, "apple tart with cream"), (6, "nowhere at all")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["retrieval_eval"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.ORACLES["retrieval_eval"]).fetchall()) and ("(all)", 4) in [r[:2] for r in got]


def test_vector_search_in_blocks(spark, monkeypatch):
    """Queries in several blocks, ties to the smaller id, zero vectors without rank, against plain Python."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    index = [(i, [float(i % 3), float(i % 5), 1.0] if i else [0.0, 0.0, 0.0], i % 2) for i in range(40)]
    queries = [(100 + i, [1.0, float(i % 2), 0.5] if i else [0.0, 0.0, 0.0], i % 2) for i in range(8)]
    got = R.vector_top_k(spark.createDataFrame(index, "id long, vector array<double>, s int").repartition(3), spark.createDataFrame(queries, "question_id long, vector array<double>, s int"), 4, "s")
    norm = lambda v: sum(x * x for x in v) ** 0.5
    want = []
    for qid, q, s in queries:
        near = sorted((-round(sum(a * b for a, b in zip(q, v, strict=True)) / norm(q) / norm(v), 6), i) for i, v, t in index if t == s and norm(q) and norm(v))
        want += [(qid, n + 1, i, -c) for n, (c, i) in enumerate(near[:4])]
    assert sorted((r.question_id, r["rank"], r.id, r.score) for r in got.collect()) == want


def test_theme_pairs_in_cells(spark, monkeypatch):
    """Clustered vectors in many cells and blocks: each pair that reaches the floor once, as by all pairs."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 6))[rng.integers(0, 12, 300)] + 0.25 * rng.standard_normal((300, 6))
    x[5] = 0
    rows = [(i, i % 7, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ord long, video int, vector array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for block, floor in ((2048, 0.8), (40, 0.8), (9, 0.95), (25, -0.2)):
        monkeypatch.setattr(C, "BLOCK_ROWS", block)
        got = sorted((r.i, r.j, r.cosine) for r in C.theme_pairs(df, floor).collect())
        near = u @ u.T
        want = sorted((i, j, round(near[i, j], 6)) for i in range(300) for j in range(i + 1, 300) if near[i, j] >= floor and i % 7 != j % 7 and i != 5 and j != 5)
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    assert C.theme_pairs(df.limit(0), 0.8).count() == 0
