"""Queries of sources, sinks and steps with a model in the loop, over the driver's tables: files are written and read
back, and a model's replies are made from its prompts by a plain function."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import answers, synthesis
from veritrail.operators import claims as C
from veritrail.plans.catalogue import _DEDUP, _PAIRS, _deduplicated, _nth, _pairs, _questions, _t, query
from veritrail.sources import store
from veritrail.streaming import ingest


def _claims_client():
    """One claim for each part of a prompt; parts with an id divisible by 7 get a claim of no known type."""

    def client(prompt: str) -> str:
        ids = re.findall(r"(?m)^\[(d\d+)\]$", prompt)
        kind = lambda i: "rumour" if int(i[1:]) % 7 == 0 else "fact"
        return json.dumps([{"claim": f"claim of {i}", "claim_type": kind(i), "stance": "support", "evidence": [{"chunk_id": i, "evidence_text": "x"}], "topics": ["t"]} for i in ids])

    return client


def _relations_client():
    """Contradiction where the first claim named has an even number, else agreement; a bad note for every third."""

    def client(prompt: str) -> str:
        first = int(re.search(r"(?m)^k(\d+)_claim0: ", prompt)[1])
        note = "see k0_claim9" if first % 3 == 0 else f"see k{first}_claim0."
        return "```json\n" + json.dumps({"relationship": "agreement" if first % 2 else "contradiction", "synthesis_note": note}) + "\n```"

    return client


def _answers_client():
    return lambda prompt: "It is so [Source 1], and also [Source 1 at 9]."


@query("""SELECT concat('v', doc_id) AS video_id, coalesce(lang, 'Untitled') AS title, coalesce(source, 'Unknown') AS channel, coalesce(n_chars, 0)::BIGINT AS duration_seconds, '' AS description, md5(text) AS transcript_md5
    FROM documents WHERE length(text) > 0""")
def read_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files of at most 100 videos each, written and read."""
    d = _t(spark, sf_dir, "documents")
    meta = F.struct(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("lang").alias("title"), F.col("source").alias("channel"), F.col("n_chars").alias("duration_seconds"))
    rows = d.select(F.floor(F.col("doc_id") / 100).alias("file"), F.to_json(F.struct(meta.alias("metadata"), F.col("text").alias("transcript"))).alias("v"))
    files = rows.groupBy("file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("v"), ",\n"), F.lit("]")).alias("value")).select("value")
    folder = store.shared_folder(spark, "videos")
    files.write.option("maxRecordsPerFile", 1).text(folder)
    return store.read_videos(spark, folder).select("video_id", "title", "channel", "duration_seconds", "description", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


@query("SELECT page_id, url, n FROM (SELECT page_id, url, count(*) OVER (PARTITION BY url) AS n FROM pages)")
def read_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the pages' URLs with blank lines and comments, written, read and joined to its pages."""
    pages, folder = _t(spark, sf_dir, "pages").select("page_id", "url"), store.shared_folder(spark, "urls")
    pages.select(F.concat(F.lit("  "), F.col("url"), F.lit(" \n\n# "), F.col("page_id").cast("string")).alias("value")).write.text(folder)
    listed = store.read_urls(spark, folder).groupBy("url").agg(F.count("*").alias("n"))
    return pages.join(listed, "url").select("page_id", "url", "n")


@query("""SELECT lang AS workspace_id, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('de', 'fr') AND (lang <> 'en' OR doc_id % 2 = 1) GROUP BY 1""")
def workspace_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by workspace: one partition is replaced by its odd rows, one by no rows, one is deleted."""
    path = store.shared_folder(spark, "by-workspace")
    rows = _t(spark, sf_dir, "documents").where("lang is not null").select(F.col("lang").alias("workspace_id"), "doc_id")
    store.overwrite_workspace(rows, path)
    read = lambda: store.read_optional(spark, path, "workspace_id STRING, doc_id BIGINT")
    store.replace_workspace(read().where("workspace_id = 'en' and doc_id % 2 = 1").drop("workspace_id"), path, "en")
    store.replace_workspace(read().where("false").drop("workspace_id"), path, "de")
    store.delete_workspace(spark, path, "fr")
    return read().groupBy("workspace_id").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"))


@query("SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations, min(text) AS first_text FROM conversations GROUP BY 1")
def appended_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages appended as JSON in two parts, and read."""
    rows, path = _t(spark, sf_dir, "conversations"), store.shared_folder(spark, "messages")
    for odd in (0, 1):
        store.append_json(rows.where(F.col("turn") % 2 == odd), path)
    read = spark.read.schema(rows.schema).json(path)
    return read.groupBy("role").agg(F.count("*").alias("messages"), F.count_distinct("conv_id").alias("conversations"), F.min("text").alias("first_text"))


_HASHED = "SELECT doc_id, source, substr(sha256(text), 1, 16) AS content_hash, doc_id % 7 > 0 AS good FROM documents WHERE text IS NOT NULL"


@query(f"""WITH h AS ({_HASHED}), c AS (SELECT DISTINCT h.content_hash FROM h JOIN labels USING (doc_id))
    SELECT content_hash, count(*) FILTER (good) AS claims, min(CASE WHEN good THEN concat('claim of d', doc_id) END) AS first_claim FROM h WHERE content_hash NOT IN (SELECT content_hash FROM c) GROUP BY 1""")
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the documents whose text has no labelled copy (these are in the cache), by recorded replies."""
    d = _t(spark, sf_dir, "documents").where("text is not null")
    chunks = d.select(F.col("source").alias("video_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), T.content_hash(F.col("text")).alias("content_hash"), "text")
    cache = chunks.join(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi").select("content_hash", F.array().cast(f"array<{C.CLAIM}>").alias("claims")).distinct()
    fresh, _ = synthesis.extract_claims(chunks, cache, _claims_client)
    return fresh.select("content_hash", F.size("claims").cast("long").alias("claims"), F.array_min(F.transform("claims", lambda c: c["claim"])).alias("first_claim"))


@query("""WITH r AS (SELECT event_id // 10 AS c, min(event_id) AS first, count(DISTINCT user_id) AS unique_videos, count(*) AS size, count(*) FILTER (event_id % 4 = 0) AS support_count, sum(event_id % 3 + 1)::BIGINT AS total_evidence FROM events GROUP BY 1)
    SELECT concat('c', c) AS cluster_id, unique_videos, size, support_count, total_evidence, CASE WHEN unique_videos < 2 THEN 'single_source' WHEN first % 3 > 0 THEN CASE WHEN first % 2 = 1 THEN 'agreement' ELSE 'contradiction' END END AS relationship,
      CASE WHEN unique_videos >= 2 AND first % 3 > 0 THEN concat('see k', first, '_claim0.') END AS synthesis_note, CASE WHEN unique_videos >= 2 AND first % 3 = 0 THEN 'unknown_claim' ELSE 'ok' END AS status FROM r""")
def synthesize_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of ten events each; recorded replies say how their users relate."""
    e = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.floor(e / 10).cast("string")).alias("cluster_id"), e.alias("ord"), F.format_string("k%d_claim0", e).alias("claim_id"), F.col("event_type").alias("claim"), F.col("user_id").cast("string").alias("video_id"),
        _nth(["support", "oppose", "neutral", "mixed"], e % 4).alias("stance"), (e % 3 + 1).alias("n_evidence"),
    )
    return synthesis.synthesize_clusters(rows, _relations_client).select("cluster_id", "unique_videos", "size", "support_count", "total_evidence", "relationship", "synthesis_note", "status")


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cosine DESC, i, j) AS n FROM ({_PAIRS})),
    m(n, used, picks) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
      SELECT p.n, CASE WHEN ok THEN list_concat(used, [i, j]) ELSE used END, CASE WHEN ok THEN list_append(picks, p.n) ELSE picks END
      FROM (SELECT p.*, m.used, m.picks, NOT list_contains(m.used, p.i) AND NOT list_contains(m.used, p.j) AND len(m.picks) < 10 AS ok FROM m JOIN p ON p.n = m.n + 1) p)
    SELECT row_number() OVER (ORDER BY p.n) AS theme_no, concat('k', i, '_claim0,k', j, '_claim0') AS members, CASE WHEN i % 3 = 0 THEN 'related' WHEN i % 2 = 1 THEN 'agreement' ELSE 'contradiction' END AS relationship,
      CASE WHEN i % 3 = 0 THEN '' ELSE concat('see k', i, '_claim0.') END AS synthesis_note FROM p, (SELECT picks FROM m ORDER BY n DESC LIMIT 1) WHERE list_contains(picks, p.n)""")
def label_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The themes of `theme_match`, labelled by recorded replies; a reply that names an unknown claim labels nothing."""
    claims = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.format_string("k%d_claim0", "vec_id").alias("claim_id"), F.lit("c").alias("claim"), F.col("label").cast("string").alias("video_id"))
    got = synthesis.label_themes(C.theme_match(_pairs(spark, sf_dir)), claims, _relations_client)
    return got.select(F.col("theme_no").cast("long").alias("theme_no"), F.array_join("member_claim_ids", ",").alias("members"), "relationship", "synthesis_note")


@query(_DEDUP + """, per AS (SELECT question_id, count(*) AS labels FROM lab GROUP BY 1)
    SELECT item_id AS question_id, CASE WHEN labels IS NULL THEN $$%s$$ ELSE 'It is so [Source 1], and also [Source 1 at 9].' END AS answer, CASE WHEN labels IS NULL THEN 0 ELSE 2 END AS cited_count, labels IS NULL AS all_valid, labels IS NULL AS verified
    FROM benchmark LEFT JOIN per ON item_id = question_id""" % answers.NOTHING_FOUND)
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the benchmark's questions by a recorded model that cites a source too many (no question has nine)."""
    labelled = _deduplicated(spark, sf_dir).select("question_id", "label_no", F.col("doc_id").alias("id"), F.concat(F.lit("[Source] "), F.col("text")).alias("block"))
    got = answers.ask(_questions(spark, sf_dir), labelled, _answers_client)
    return got.select("question_id", "answer", "citation_check.cited_count", "citation_check.all_valid", "verified")


@query("""SELECT event_id, array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS title,
    concat(m, format('{}:{:02d}', a // 60, a % 60), '–', m, format('{}:{:02d}', b // 60, b % 60)) AS times FROM (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN '~' ELSE '' END AS m, event_id % 3000 AS a, event_id % 3000 + 75 AS b FROM events)""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of identifiers, and time ranges, marked where they are estimates."""
    at = (F.col("event_id") % 3000).cast("double")
    return _t(spark, sf_dir, "events").select("event_id", T.title_case(F.col("event_type")).alias("title"), T.timestamp_range(at, at + 75, F.col("event_id") % 2 == 0).alias("times"))


_FOLD = """WITH RECURSIVE e AS MATERIALIZED (SELECT label::BIGINT AS w, vec_id, (vec_id % 5)::VARCHAR AS video, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    f(w, n, cents, sizes, vids, picks) AS (
      SELECT DISTINCT w, 0::BIGINT, []::DOUBLE[][], []::BIGINT[], []::VARCHAR[][], []::BIGINT[] FROM e
      UNION ALL
      SELECT w, n, CASE WHEN j THEN list_transform(range(1, len(cents) + 1), lambda i: CASE WHEN i = b THEN list_transform(range(1, len(v) + 1), lambda k: (cents[b][k] * sizes[b] + v[k]) / (sizes[b] + 1)) ELSE cents[i] END) ELSE list_append(cents, v) END,
        CASE WHEN j THEN list_transform(range(1, len(sizes) + 1), lambda i: sizes[i] + (i = b)::BIGINT) ELSE list_append(sizes, 1) END,
        CASE WHEN j THEN vids ELSE list_append(vids, [video]) END, list_append(picks, CASE WHEN j THEN b - 1 ELSE len(cents) END)
      FROM (SELECT *, coalesce(list_contains(vids[b], video) AND near[b] >= 0.2, false) AS j FROM (SELECT *, list_position(near, list_max(near)) AS b FROM (
        SELECT f.*EXCLUDE (n), e.n, e.v, e.video, list_transform(f.cents, lambda c: list_cosine_similarity(c, e.v)) AS near FROM f JOIN e ON e.w = f.w AND e.n = f.n + 1))))"""


@query(_FOLD + " SELECT e.w AS workspace_id, vec_id AS ord, vec_id AS claim_id, picks[e.n] AS cluster_no FROM e JOIN (SELECT w, picks FROM f QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC) = 1) USING (w)")
def cluster_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential fold over each label's vectors."""
    e = _t(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("long").alias("workspace_id"), F.col("vec_id").alias("ord"), F.col("vec_id").alias("claim_id"), (F.col("vec_id") % 5).cast("string").alias("video"), F.col("embedding").alias("vector"))
    return C.cluster_greedy(rows, 0.2)


@query("SELECT strftime(time_bucket(INTERVAL 5 MINUTES, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; each trigger's counts replace the last ones."""
    rows, source, target = _t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), store.shared_folder(spark, "events"), store.shared_folder(spark, "activity")
    rows.write.parquet(source)
    counts = ingest.activity(spark.readStream.schema(rows.schema).parquet(source))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", store.shared_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT doc_id AS video_ord, substr(sha256(text), 1, 16) AS content_hash FROM documents WHERE text IS NOT NULL QUALIFY doc_id = min(doc_id) OVER (PARTITION BY sha256(text))""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks ingested as a stream; the same files delivered again add nothing."""
    schema, source, target, state = "video_ord long, content_hash string", *(store.shared_folder(spark, x) for x in ("chunks", "ingested", "state"))
    rows = _t(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("video_ord"), T.content_hash(F.col("text")).alias("content_hash"))
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        ingest.ingest_stream(spark, source, target, state, schema).awaitTermination()
    return spark.read.schema(schema).parquet(target)
