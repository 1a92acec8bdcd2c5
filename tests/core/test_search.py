import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import answers
from veritrail.operators import retrieval as R
from veritrail.plans import catalogue
from veritrail.sources import store


def test_bm25_by_blocks_of_questions(spark, monkeypatch):
    """Scores in small pieces as by plain Python, ties to the smaller id; no postings are joined or shuffled."""
    for name, value in (("QUERY_BLOCK", 2), ("SCORES_HELD", 40), ("TOKENS_HELD", 5)):
        monkeypatch.setattr(R, name, value)
    words = ["Red", "apple", "pie", "tart", "zwölf", "K2", "a-b", "über", "plum", "x1"]
    docs = [(i, " ".join(words[(i * j + i // 3) % 10] for j in range(i % 9))) for i in range(60)] + [(99, None)]
    asked = [(1, "red red apple"), (2, "tart"), (3, "nothing known"), (4, "K2 b x1 plum"), (5, ""), (6, None), (7, "pie apple b")]
    corpus, questions = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "question_id long, question string")
    for b in (0.75, 0.0):
        toks = {r.doc_id: r.t for r in corpus.select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
        df = Counter(t for x in toks.values() for t in set(x))
        raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        mean, avgdl = sum(raw.values()) / len(raw), sum(map(len, toks.values())) / len(docs)
        want = []
        for q, text in asked:
            found = {}
            for i, x in toks.items():
                tf = Counter(x)
                found[i] = round(sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * tf[t] * 2.5 / (tf[t] + 1.5 * (1 - b + b * len(x) / avgdl)) for t in Counter(plain_tokens(text)).elements() if tf[t]), 6)
            best = sorted((-s, i) for i, s in found.items() if s > 0)[:6]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        got = R.bm25_top_k(corpus, questions, 6, b=b)
        assert sorted(map(tuple, got.collect())) == want and len({w[0] for w in want}) == 4
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan and plan.count("MapInArrow") >= 2


def plain_tokens(text):
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (text or "").lower()).split()


def test_bm25_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "question_id long, question string")
    assert R.bm25_top_k(none, some, 3).columns == ["question_id", "rank", "doc_id", "score"]
    assert R.bm25_top_k(none, some, 3).count() == R.bm25_top_k(spark.createDataFrame([(1, None)], none.schema), some, 3).count() == R.bm25_top_k(none, some.limit(0), 3).count() == 0


def test_large_table_in_one_file_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SPREAD_BYTES", 100)
    path = str(tmp_path / "t")
    spark.range(4000).coalesce(1).write.parquet(path)
    rows = store.spread(spark.read.parquet(path), path)
    per = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 4000 and max(per) * spark.sparkContext.defaultParallelism <= 6000
    spark.range(4000).repartition(40).write.parquet(path + "2")
    many = spark.read.parquet(path + "2")
    assert store.spread(many, path + "2") is many


@pytest.mark.parametrize("name", ["rerank_topk", "context_dedup", "context_budget"])
def test_few_fused_rows_meet_the_documents_unshuffled(spark, tiny, name):
    """With documents too large to broadcast, as in a larger input: the few rows are, and the search runs once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "150k")
    try:
        plan = catalogue.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "MapIn" not in plan
    if name != "context_budget":  # its last join meets texts with narrow columns
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_contexts_of_answers_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    labelled = spark.createDataFrame([(1, 1, 7, "a"), (1, 2, 8, "b")], "question_id long, label_no long, id long, block string")
    labelled = labelled.mapInPandas(counted, labelled.schema)
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "question_id long, question string")
    got = {r.question_id: r for r in answers.ask(asked, labelled, lambda: lambda prompt: "so [Source 2]").collect()}
    assert got[1].verified and got[1].source_map == {"Source 1": 7, "Source 2": 8} and got[2].answer == answers.NOTHING_FOUND
    assert made.value == 2
