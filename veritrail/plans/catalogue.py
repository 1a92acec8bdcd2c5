"""The library's queries over the driver's tables, each with its DuckDB SQL where SQL expresses it.

documents stand for chunks (lang: workspace, source: video), benchmark for questions, conversations for transcripts
and messages, embeddings for claim vectors. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import answers, report
from veritrail.operators import claims as C
from veritrail.operators import retrieval as R
from veritrail.operators import transcripts as P
from veritrail.sources import store, video

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work, over all cores."""
    return store.spread(_t(spark, sf_dir, name), f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------------------- SQL parts

_TOK = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
_SENTS = r"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', concat('\1', chr(31)), 'g'), chr(31)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_WC = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def _bm25_sql(name: str, k: int, b: float) -> str:
    return f"""
    {name}_s AS (SELECT question_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * dl / avgdl))), 6) AS score
      FROM post JOIN asked USING (token) JOIN idf USING (token) GROUP BY ALL),
    {name} AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM {name}_s
      QUALIFY rank <= {k} AND score > 0)"""


_BM25 = f"""WITH toks AS (SELECT doc_id, {_TOK.format(x="coalesce(text, '')")} AS toks FROM documents),
    post AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS token FROM toks) GROUP BY ALL),
    n AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM toks),
    raw AS (SELECT token, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, avgdl FROM post, n GROUP BY token, n_docs, avgdl),
    idf AS (SELECT token, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT question_id, token, count(*) AS qtf FROM (SELECT item_id AS question_id, unnest({_TOK.format(x="text")}) AS token FROM benchmark) GROUP BY ALL),"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("question_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(_BM25 + _bm25_sql("a", 25, 0.75) + " SELECT question_id, rank, doc_id, score FROM a")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(R.bm25_top_k(_spread(spark, sf_dir, "documents"), _questions(spark, sf_dir), 25))


@query("""SELECT q.vec_id AS question_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank,
    e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 50 = 0 QUALIFY rank <= 25""")
def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    q = e.where("id % 50 = 0").withColumnRenamed("id", "question_id")
    return _ranked(R.vector_top_k(e, q, 25, "label").withColumnRenamed("id", "doc_id"))


_FUSE = """
    {name} AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS rank, doc_id, score FROM (
      SELECT question_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(list_no * 1000 + rank) AS seen FROM (
        SELECT question_id, doc_id, rank, 0 AS list_no FROM {a} UNION ALL SELECT question_id, doc_id, rank, 1 FROM {b}) GROUP BY ALL) QUALIFY rank <= {k})"""


@query(_BM25 + _bm25_sql("a", 25, 0.75) + "," + _bm25_sql("b", 25, 0.0) + "," + _FUSE.format(name="f", a="a", b="b", k=25) + " SELECT question_id, rank, doc_id, score FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = _spread(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    lists = [R.bm25_top_k(d, q, 25, b=b) for b in (0.75, 0.0)]
    return _ranked(R.reciprocal_rank_fusion(lists, 25, "doc_id").withColumnRenamed("id", "doc_id"))


_BAG = "list_transform(range(0, 64), lambda i: len(list_filter(list_transform(" + _TOK + ", lambda t: CAST(concat('0x', substr(md5(t), 1, 2)) AS INTEGER) % 64), lambda s: s = i))::DOUBLE)"
_VECTORS = f""" dv AS MATERIALIZED (SELECT doc_id, {_BAG.format(x="coalesce(text, '')")} AS v FROM documents), qv AS MATERIALIZED (SELECT item_id AS question_id, {_BAG.format(x="text")} AS v FROM benchmark),
    vec AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (
      SELECT question_id, doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM qv q, dv d WHERE list_sum(q.v) > 0 AND list_sum(d.v) > 0) QUALIFY rank <= 25),"""
_HYBRID = _BM25 + _bm25_sql("a", 25, 0.75) + "," + _VECTORS + _FUSE.format(name="h", a="vec", b="a", k=25)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = _spread(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    index = d.select(F.col("doc_id").alias("id"), R.bag_of_words(F.coalesce("text", F.lit(""))).alias("vector"))
    asked = q.select("question_id", R.bag_of_words(F.col("question")).alias("vector"))
    vec = R.vector_top_k(index, asked, 25)
    return R.reciprocal_rank_fusion([vec, R.bm25_top_k(d, q, 25).withColumnRenamed("doc_id", "id")], 25).withColumnRenamed("id", "doc_id")


@query(_HYBRID + " SELECT question_id, rank, doc_id, score FROM h")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_hybrid(spark, sf_dir))


_OVERLAP = f"coalesce(len(list_intersect(list_distinct({_TOK.format(x='b.text')}), {_TOK.format(x='d.text')}))::DOUBLE / nullif(len(list_distinct({_TOK.format(x='b.text')})), 0), 0.0)"
_RERANK = _HYBRID + f""",
    top AS MATERIALIZED (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, old_rank) AS rank, doc_id, score, text FROM (
      SELECT question_id, h.rank AS old_rank, doc_id, d.text, round({_OVERLAP}, 6) AS score FROM h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = question_id) QUALIFY rank <= 8)"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 reranked documents of each question, with their texts."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    fused = store.written(_hybrid(spark, sf_dir).drop("score"), "fused")  # of known size: whole texts are not shuffled to meet few rows
    met = fused.join(d, "doc_id").join(_questions(spark, sf_dir), "question_id")
    top = R.rerank(met, 8, R.token_overlap(F.col("question"), F.coalesce("text", F.lit(""))))
    return top.select("question_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.col("pair_score").alias("score"), "text", "source", "lang")


@query(_RERANK + " SELECT question_id, rank, doc_id, score FROM top")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("question_id", "rank", "doc_id", "score")


_WORDSET = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''))"
_DEDUP = _RERANK.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    ws AS MATERIALIZED (SELECT question_id, rank, doc_id, {_WORDSET} AS w FROM top),
    kept(question_id, i, ids, sets) AS (
      SELECT DISTINCT question_id, 0::BIGINT, []::BIGINT[], []::VARCHAR[][] FROM ws
      UNION ALL
      SELECT k.question_id, k.i + 1,
        CASE WHEN near THEN ids ELSE list_append(ids, doc_id) END, CASE WHEN near THEN sets ELSE list_append(sets, w) END
      FROM (SELECT k.*, s.doc_id, s.w, len(list_filter(k.sets, lambda x: coalesce(len(list_intersect(x, s.w))::DOUBLE / nullif(least(len(x), len(s.w)), 0), 0) >= 0.6)) > 0 AS near
            FROM kept k JOIN ws s ON s.question_id = k.question_id AND s.rank = k.i + 1) k),
    ded AS (SELECT question_id, ids FROM kept QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY i DESC) = 1),
    lab AS (SELECT question_id, unnest(range(1, len(ids) + 1)) AS label_no, unnest(ids) AS doc_id FROM ded)"""


def _deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deduplicate_context(_top(spark, sf_dir).withColumnRenamed("doc_id", "id")).select("question_id", F.col("label_no").cast("long").alias("label_no"), F.col("id").alias("doc_id"), "text")


@query(_DEDUP + " SELECT question_id, label_no, doc_id FROM lab")
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduplicated(spark, sf_dir).select("question_id", "label_no", "doc_id")


@query(_DEDUP + f""" SELECT question_id, label_no, doc_id, upto, sha256(block) AS block_sha256 FROM (
    SELECT *, round(sum({_WC.format(x="block")} * 1.3::DOUBLE) OVER (PARTITION BY question_id ORDER BY label_no), 6) AS upto FROM (
      SELECT question_id, label_no, doc_id, concat('[Source ', label_no, ']', chr(10), 'Video: ', source, ' | Channel: ', lang, ' | Timestamp: 0:00', chr(10), chr(10), text) AS block
      FROM lab JOIN documents USING (doc_id))) WHERE label_no = 1 OR upto <= 1500""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.written(_deduplicated(spark, sf_dir), "deduplicated").join(_t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return R.within_budget(rows, answers.source_block(F.col("label_no"), F.col("source"), F.col("lang"), F.lit("0:00"), F.col("text"))).select("question_id", "label_no", "doc_id", "upto", F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"))


@query("""SELECT conv_id, turn, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) ELSE format('{}:{:02d}', s // 60, s % 60) END AS label
    FROM (SELECT conv_id, turn, turn * 611 + conv_id % 4000 AS s FROM conversations)""")
def format_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.timestamp_label((F.col("turn") * 611 + F.col("conv_id") % 4000).cast("double")).alias("label"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one transcript with a marker before each turn."""
    s = F.col("turn") * 61
    line = F.format_string("[%02d:%02d] Speaker %d: %s", F.floor(s / 60), s % 60, F.pmod("turn", F.lit(2)) + 1, F.coalesce("text", F.lit("")))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), " ").alias("transcript"))


@query(r"""WITH r AS (SELECT conv_id, string_agg(format('[{:02d}:{:02d}] Speaker {}: {}', turn * 61 // 60, turn * 61 % 60, turn % 2 + 1, coalesce(text, '')), ' ' ORDER BY turn, text) AS transcript FROM conversations GROUP BY 1),
    m AS (SELECT conv_id, string_split(regexp_replace(transcript, '\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]\s*(?:(Speaker \d+):)?\s*', concat(chr(30), '\1', chr(31), '\2', chr(31), '\3', chr(31), '\4', chr(31)), 'g'), chr(30)) AS slots FROM r),
    p AS (SELECT conv_id, unnest(range(0, len(slots))) AS ord, string_split(unnest(slots), chr(31)) AS f FROM m)
    SELECT conv_id, ord, start_seconds, lead(start_seconds) OVER (PARTITION BY conv_id ORDER BY ord) AS end_seconds, speaker, text FROM (
      SELECT conv_id, ord, (coalesce(try_cast(nullif(f[1], '') AS INTEGER), 0) * 3600 + try_cast(f[2] AS INTEGER) * 60 + try_cast(f[3] AS INTEGER))::DOUBLE AS start_seconds,
        nullif(f[4], '') AS speaker, regexp_replace(f[5], '^\s+|\s+$', '', 'g') AS text FROM p WHERE ord > 0) WHERE text <> ''""")
def parse_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_transcripts(_rendered(spark, sf_dir), "conv_id")


@query(r"""WITH d AS (SELECT conv_id, string_agg(format('{}:{:02d} {}', turn, turn * 7 % 60, replace(coalesce(text, ''), chr(10), ' ')), chr(10) ORDER BY turn, text) AS description FROM conversations GROUP BY 1),
    l AS (SELECT conv_id, unnest(range(0, len(x))) AS pos, unnest(x) AS line FROM (SELECT conv_id, regexp_extract_all(description, '(?m)^(?:\d{1,2}:)?\d{1,2}:\d{2}\s+[^\n]+$') AS x FROM d))
    SELECT conv_id, pos, (coalesce(try_cast(nullif(regexp_extract(line, '^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+(.+)$', 1), '') AS INTEGER), 0) * 3600
      + regexp_extract(line, '^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+(.+)$', 2)::INTEGER * 60 + regexp_extract(line, '^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+(.+)$', 3)::INTEGER)::DOUBLE AS start_seconds,
      regexp_replace(regexp_extract(line, '^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+(.+)$', 4), '^\s+|\s+$', '', 'g') AS title FROM l""")
def extract_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("%d:%02d %s", "turn", F.col("turn") * 7 % 60, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("x")).groupBy("conv_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    found = rows.agg(text.alias("description")).select("conv_id", F.posexplode(P.chapters(F.col("description"))).alias("pos", "c"))
    return found.select("conv_id", F.col("pos").cast("long").alias("pos"), "c.start_seconds", "c.title")


_SENTENCES = f"sent AS (SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTS.format(x='text')} AS s FROM documents))"


@query(f"WITH {_SENTENCES} SELECT doc_id, pos, sentence FROM sent")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(f"""WITH {_SENTENCES}, w AS (SELECT *, {_WC.format(x='sentence')} AS words FROM sent)
    SELECT doc_id, pos, words, round(600.0 * (coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / greatest(sum(words) OVER (PARTITION BY doc_id), 1), 6) AS start_seconds,
      round(600.0 * (sum(words) OVER (PARTITION BY doc_id ORDER BY pos)) / greatest(sum(words) OVER (PARTITION BY doc_id), 1), 6) AS end_seconds FROM w""")
def sentence_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _spread(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ord"), F.lit(0.0).alias("start_seconds"), F.lit(None).cast("double").alias("end_seconds"), "text")
    rows = P.sentence_times(segments, "doc_id", F.lit(600.0))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("words").cast("long").alias("words"), "start_seconds", "end_seconds")


@query("""WITH c AS (SELECT conv_id, turn * 10 AS s, max(role) AS title FROM conversations WHERE turn % 3 = 1 GROUP BY ALL)
    SELECT e.conv_id, e.turn, (e.turn * 10)::DOUBLE AS seconds, c.title AS nearest_chapter_title FROM conversations e ASOF LEFT JOIN c ON e.conv_id = c.conv_id AND e.turn * 10 >= c.s""")
def nearest_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    marks = c.where("turn % 3 = 1").select("conv_id", (F.col("turn") * 10.0).alias("start_seconds"), F.col("role").alias("title"))
    return P.nearest_chapter_join(c.select("conv_id", "turn", (F.col("turn") * 10.0).alias("seconds")), marks, "conv_id").select("conv_id", "turn", "seconds", "nearest_chapter_title")


_PACK = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, x, list_transform(x, lambda t: {_WC.format(x='t')}) AS xw FROM (SELECT doc_id, {_SENTS.format(x='text')} AS x FROM documents)),
    r(doc_id, i, cur, cw, w, added, emit) AS (
      SELECT doc_id, 0::BIGINT, []::VARCHAR[], []::BIGINT[], 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM s
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN w2 >= 180 THEN list_transform(ov, lambda j: c2[j]) ELSE c2 END, CASE WHEN w2 >= 180 THEN list_transform(ov, lambda j: cw2[j]) ELSE cw2 END,
        CASE WHEN w2 >= 180 THEN coalesce(list_sum(list_transform(ov, lambda j: cw2[j])), 0)::BIGINT ELSE w2 END, CASE WHEN w2 >= 180 THEN 0 ELSE added + 1 END, CASE WHEN w2 >= 180 THEN list_aggregate(c2, 'string_agg', ' ') END
      FROM (SELECT *, CASE WHEN w2 >= 180 THEN list_filter(range(1, len(c2)), lambda j: coalesce(list_sum(cw2[j + 1:len(c2) - 1]), 0) < 25) ELSE []::BIGINT[] END AS ov
        FROM (SELECT r.doc_id, r.i, r.added, list_append(r.cur, s.x[r.i + 1]) AS c2, list_append(r.cw, s.xw[r.i + 1]) AS cw2, (r.w + s.xw[r.i + 1])::BIGINT AS w2 FROM r JOIN s ON s.doc_id = r.doc_id WHERE r.i < len(s.x)))),
    chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, last) - 1 AS chunk_index, text FROM (
      SELECT doc_id, i, 0 AS last, emit AS text FROM r WHERE emit IS NOT NULL
      UNION ALL SELECT r.doc_id, r.i, 1, list_aggregate(cur, 'string_agg', ' ') FROM r JOIN s ON s.doc_id = r.doc_id WHERE r.i = len(s.x) AND added > 0))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spread(spark, sf_dir, "documents").where("text is not null")
    unit = lambda x: F.struct(x.alias("text"), T.word_count(x).alias("words"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    rows = d.select("doc_id", F.transform(T.sentences(F.col("text")), unit).alias("sentences"))
    return P.pack_chunks(rows, "doc_id").withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(_PACK + " SELECT doc_id, chunk_index, format('{}_c{:04d}', doc_id, chunk_index) AS chunk_id, substr(sha256(text), 1, 16) AS content_hash FROM chunk")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk_id", "content_hash")


@query(_PACK + """, h AS (SELECT doc_id, chunk_index, substr(sha256(text), 1, 16) AS content_hash FROM chunk)
    SELECT doc_id, chunk_index, content_hash FROM h WHERE doc_id % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id % 2 = 0)
    QUALIFY doc_id = min(doc_id) OVER (PARTITION BY content_hash)""")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with even ids are there already; those with odd ids come in."""
    c = _chunks(spark, sf_dir).select("doc_id", "chunk_index", "content_hash")
    return P.new_chunks(c.where("doc_id % 2 = 1").withColumn("video_ord", F.col("doc_id")), c.where("doc_id % 2 = 0")).select("doc_id", "chunk_index", "content_hash")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, CAST(concat('0x', substr(sha1(format('{}_c0000', doc_id)), 1, 15)) AS BIGINT) AS point_id FROM documents")
def content_hash_point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.point_id(F.format_string("%d_c0000", "doc_id")).alias("point_id"))


_KINDS = "['recommendation', 'opinion', 'fact', 'prediction', 'warning', 'rumour'][event_id % 6 + 1]"
_STANCE = "['support', 'oppose', 'neutral', 'mixed', 'unsure'][event_id % 5 + 1]"


def _nth(values: list[str], at: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[at.cast("int")]


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each event: one claim, sometimes with a bad type or stance, no evidence or an unknown chunk."""
    e = F.col("event_id")
    evidence = F.when(e % 7 == 0, F.array().cast("array<struct<chunk_id:string,evidence_text:string>>")).otherwise(
        F.array(F.struct(F.concat(F.lit("d"), (F.col("user_id") * 13).cast("string")).alias("chunk_id"), F.lit("x").alias("evidence_text")))
    )
    claim = F.struct(
        F.lit("v").alias("video_id"), F.col("event_type").alias("claim"), _nth(["recommendation", "opinion", "fact", "prediction", "warning", "rumour"], e % 6).alias("claim_type"),
        _nth(["support", "oppose", "neutral", "mixed", "unsure"], e % 5).alias("stance"), evidence.alias("evidence"), F.array(F.lit("t")).alias("topics"),
    )
    raw = F.when(e % 11 == 0, F.col("props")).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.array(claim)), F.lit("\n```")))
    return _spread(spark, sf_dir, "events").select(e.alias("reply_id"), raw.alias("raw"))


@query(f"""SELECT event_id AS reply_id, 0 AS pos, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS claim,
    CASE WHEN event_id % 11 = 0 THEN 'invalid_json' WHEN {_KINDS} = 'rumour' THEN 'invalid_claim_type' WHEN {_STANCE} = 'unsure' THEN 'invalid_stance' WHEN event_id % 7 = 0 THEN 'no_evidence'
      WHEN user_id * 13 NOT IN (SELECT doc_id FROM documents) THEN 'unknown_chunk' END AS reason FROM events""")
def claims_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return C.validate_claims(_replies(spark, sf_dir), chunks).select("reply_id", "pos", "claim", "reason")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch_no FROM documents")
def claims_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batches(_t(spark, sf_dir, "documents"), "source", "doc_id").select("doc_id", "source", "batch_no")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the texts of labelled documents, by content hash: as many as 1 + quality + toxic."""
    met = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id")
    rows = met.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.max(F.col("quality") + F.col("toxic")).alias("n"))
    return rows.select("content_hash", F.transform(F.sequence(F.lit(0), "n"), lambda i: F.format_string("claim %d", i)).alias("claims"))


_CACHE = "WITH cache AS (SELECT substr(sha256(text), 1, 16) AS content_hash, max(quality + toxic) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), d AS (SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents)"


@query(_CACHE + " SELECT doc_id, content_hash FROM d WHERE content_hash NOT IN (SELECT content_hash FROM cache)")
def claims_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return C.cache_misses(d, _cache(spark, sf_dir)).select("doc_id", "content_hash")


@query(_CACHE + " SELECT doc_id AS ord, pos, format('d{}_claim{}', doc_id, pos) AS claim_id, format('claim {}', pos) AS claim FROM (SELECT doc_id, unnest(range(0, n + 1)) AS pos FROM d JOIN cache USING (content_hash))")
def claims_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), T.content_hash(F.col("text")).alias("content_hash"))
    return C.claims_from_cache(d, _cache(spark, sf_dir)).select("ord", F.col("pos").cast("long").alias("pos"), "claim_id", "claim")


@query("""SELECT cluster_id, string_agg(DISTINCT video_id, ',' ORDER BY video_id) AS videos, count(DISTINCT video_id) AS unique_videos, count(DISTINCT video_id) AS unique_channels, count(*) FILTER (stance = 'support') AS support_count,
    count(*) FILTER (stance = 'oppose') AS oppose_count, count(*) FILTER (stance IN ('neutral', 'mixed')) AS neutral_count, sum(n_evidence)::BIGINT AS total_evidence, count(*) AS size FROM (
    SELECT event_id % 97 AS cluster_id, user_id::VARCHAR AS video_id, ['support', 'oppose', 'neutral', 'mixed'][event_id % 4 + 1] AS stance, event_id % 3 + 1 AS n_evidence FROM events) GROUP BY 1""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _t(spark, sf_dir, "events").select((e % 97).alias("cluster_id"), F.col("user_id").cast("string").alias("video_id"), _nth(["support", "oppose", "neutral", "mixed"], e % 4).alias("stance"), (e % 3 + 1).alias("n_evidence"))
    return C.cluster_stats(rows)


_PAIRS = "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.theme_pairs(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("label").alias("video"), F.col("embedding").alias("vector")), 0.4)


@query(_PAIRS)
def theme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cosine DESC, i, j) AS n FROM ({_PAIRS})),
    m(n, used, picks) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL
      SELECT p.n, CASE WHEN ok THEN list_concat(used, [i, j]) ELSE used END, CASE WHEN ok THEN list_append(picks, p.n) ELSE picks END
      FROM (SELECT p.*, m.used, m.picks, NOT list_contains(m.used, p.i) AND NOT list_contains(m.used, p.j) AND len(m.picks) < 10 AS ok FROM m JOIN p ON p.n = m.n + 1) p)
    SELECT row_number() OVER (ORDER BY p.n) AS theme_no, i, j, round(cosine, 3) AS cosine FROM p, (SELECT picks FROM m ORDER BY n DESC LIMIT 1) WHERE list_contains(picks, p.n)""")
def theme_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.theme_match(_pairs(spark, sf_dir)).withColumn("theme_no", F.col("theme_no").cast("long"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'invalid_json' WHEN event_id % 4 = 3 THEN 'unknown_relationship' WHEN event_id % 5 = 0 THEN 'unknown_claim' ELSE 'ok' END AS status FROM events""")
def relationship_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = _nth(["agreement", "contradiction", "independent", "friendship"], e % 4)
    note = F.when(e % 5 == 0, F.lit("see v1_claim0001, and v9_claim0009.")).otherwise(F.lit("see v1_claim0001, and v2_claim0002."))
    raw = F.when(e % 9 == 0, F.lit("no json")).otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(kind.alias("relationship"), note.alias("synthesis_note"))), F.lit("\n```")))
    return _t(spark, sf_dir, "events").select("event_id", C.relationship_status(raw, F.array(F.lit("v1_claim0001"), F.lit("v2_claim0002"))).alias("status"))


@query("""SELECT count(*) FILTER (videos < 2) AS single_source, count(*) FILTER (videos >= 2) AS multi_source FROM (SELECT user_id, count(DISTINCT event_type) AS videos FROM events GROUP BY 1)""")
def single_vs_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("videos"))
    return per.agg(F.count_if(F.col("videos") < 2).alias("single_source"), F.count_if(F.col("videos") >= 2).alias("multi_source"))


@query(r"""SELECT conv_id, turn, len(cited)::INTEGER AS cited_count, list_aggregate(list_sort(list_filter(cited, lambda c: list_contains(labels, c))), 'string_agg', ',') AS valid, list_aggregate(list_sort(list_filter(cited, lambda c: NOT list_contains(labels, c))), 'string_agg', ',') AS invalid,
      len(list_filter(cited, lambda c: NOT list_contains(labels, c))) = 0 AS all_valid FROM (
    SELECT conv_id, turn, ['Source 1', 'Source 2', 'Source 3'] AS labels, list_distinct(list_transform(flatten(list_transform(regexp_extract_all(answer, '\[([^\[\]]*?Source[^\[\]]*?)\]', 1), lambda b: regexp_extract_all(b, '\d+'))), lambda n: concat('Source ', n))) AS cited
    FROM (SELECT conv_id, turn, concat(replace(replace(text, '[', '('), ']', ')'), ' [Source ', turn % 5 + 1, ', ', conv_id % 4 + 1, '] and [Source 1 at 2:03] [12]') AS answer FROM conversations WHERE text IS NOT NULL))""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    answer = F.concat(text, F.lit(" [Source "), (F.col("turn") % 5 + 1).cast("string"), F.lit(", "), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("] and [Source 1 at 2:03] [12]"))
    rows = _t(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", T.verify_citations(answer, F.array(*[F.lit(f"Source {i}") for i in (1, 2, 3)])).alias("r"))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return rows.select("conv_id", "turn", "r.cited_count", joined("r.valid_citations").alias("valid"), joined("r.invalid_citations").alias("invalid"), "r.all_valid")


@query("SELECT conv_id, turn, role, n FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations) WHERE n <= 12")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.last_messages(_t(spark, sf_dir, "conversations"), "conv_id", ["turn desc", "role"], 12).select("conv_id", "turn", "role", F.col("n").cast("long").alias("n"))


@query(_BM25 + _bm25_sql("a", 25, 0.75) + """, got AS (SELECT question_id, list(doc_id ORDER BY rank) AS retrieved FROM a GROUP BY 1),
    want AS (SELECT item_id AS question_id, list(doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1),
    r AS (SELECT CASE WHEN question_id % 3 = 0 THEN 'unlabeled' ELSE format('c{}', question_id % 3) END AS category, list_filter(range(1, len(retrieved) + 1), lambda i: list_contains(expected, retrieved[i])) AS hits FROM want JOIN got USING (question_id)),
    s AS (SELECT category, coalesce(1.0 / hits[1], 0) AS rr, (coalesce(hits[1], 99) <= 1)::INT::DOUBLE AS h1, (coalesce(hits[1], 99) <= 3)::INT::DOUBLE AS h3, (coalesce(hits[1], 99) <= 5)::INT::DOUBLE AS h5 FROM r)
    SELECT coalesce(category, '(all)') AS category, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(h1), 6) AS hit_at_1, round(avg(h3), 6) AS hit_at_3, round(avg(h5), 6) AS hit_at_5 FROM s GROUP BY ROLLUP (category)""")
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions are benchmark items; a document is expected that holds the item's text. Candidates meet by the rarest
    token of the item's inner words, which any text that holds the item has; the few items without one are looked for
    in every text."""
    d, q = _spread(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    w = T.words(F.col("question"))
    met = q.select("question_id", "question", F.explode_outer(T.tokens(F.array_join(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), " "))).alias("token"))
    post = R.postings(d)
    rarest = met.where("token is not null").join(post.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "token").groupBy("question_id", "question").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    want = rarest.join(post.select("token", "doc_id"), "token").join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("question"))).select("question_id", "doc_id")
    short = met.where("token is null").select("question_id", "question")
    bare = d.select("doc_id", "text").join(F.broadcast(short), F.contains("text", F.col("question"))).select("question_id", "doc_id")
    want = want.unionByName(bare)
    want = want.groupBy("question_id").agg(F.collect_set("doc_id").alias("expected"))
    got = R.bm25_top_k(d, q, 25).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved"))
    category = F.when(F.col("question_id") % 3 > 0, F.format_string("c%d", F.col("question_id") % 3))
    return R.evaluate(want.join(got, "question_id").select(category.alias("category"), "retrieved", "expected"))


@query("""SELECT coalesce(d.lang, c.role) AS workspace_id, coalesce(videos, 0) AS videos, coalesce(chunks, 0) AS chunks, coalesce(messages, 0) // 2 AS exchanges FROM
    (SELECT lang, count(DISTINCT source) AS videos, count(*) AS chunks FROM documents GROUP BY 1) d FULL JOIN (SELECT role, count(*) AS messages FROM conversations GROUP BY 1) c ON d.lang = c.role""")
def workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("lang").alias("workspace_id"), F.col("source").alias("video_id"))
    return store.workspace_counts(d, _t(spark, sf_dir, "conversations").select(F.col("role").alias("workspace_id")))


@query(" UNION ALL ".join(f"SELECT '{t}' AS artefact, count(*) AS records FROM {t}" for t in ("documents", "embeddings", "labels", "conversations")) + " UNION ALL SELECT 'report', NULL")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.status(spark, {t: f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "labels", "conversations", "report")})


@query("SELECT source AS video_id, count(l.doc_id) AS claims FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def claims_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit"))  # noqa: E741
    return _t(spark, sf_dir, "documents").join(l, "doc_id", "left").groupBy(F.col("source").alias("video_id")).agg(F.count("hit").alias("claims"))


@query("""SELECT video_id, count(*) AS claims, sha256(string_agg(format('- claim {} ({}, ~{}) https://youtu.be/{}?t={}', doc_id, video_id, CASE WHEN t >= 3600 THEN format('{}:{:02d}:{:02d}', t // 3600, t % 3600 // 60, t % 60) ELSE format('{}:{:02d}', t // 60, t % 60) END, video_id, t), chr(10) ORDER BY doc_id)) AS lines_sha256
    FROM (SELECT doc_id, source AS video_id, n_chars AS t FROM documents JOIN labels USING (doc_id)) GROUP BY 1""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("source").alias("video_id"), F.col("n_chars").alias("t"))
    line = F.format_string("- claim %d (%s, ~%s) https://youtu.be/%s?t=%d", "doc_id", "video_id", T.timestamp_label(F.col("t")), "video_id", "t")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("video_id").agg(F.count("*").alias("claims"), F.sha2(lines.cast("binary"), 256).alias("lines_sha256"))


@query("""SELECT point_id, vec_id, version FROM (SELECT vec_id % 300 AS point_id, vec_id, 1 AS version FROM embeddings UNION ALL SELECT vec_id % 300, vec_id, 2 FROM embeddings WHERE label < 5)
    QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY version DESC, vec_id DESC) = 1""")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select((F.col("vec_id") % 300).alias("point_id"), "vec_id", "label")
    return store.upsert(e.drop("label").withColumn("version", F.lit(1)), e.where("label < 5").drop("label").withColumn("version", F.lit(2)), "point_id", ["version desc", "vec_id desc"])


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3 OR label IS NULL")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.without_workspace(_t(spark, sf_dir, "embeddings"), "label", 3).select("vec_id", "label")


@query("SELECT source, substr(sha256(string_agg(concat(doc_id, ':', sha256(coalesce(text, ''))), ',' ORDER BY doc_id)), 1, 16) AS signature FROM documents GROUP BY 1")
def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return store.signatures(rows, "source", "doc_id", "h")


@query(r"""SELECT user_id, md5(string_agg(format('[{:02d}:{:02d}] {}', t // 60, t % 60, event_type), chr(10) ORDER BY event_id)) AS transcript_md5
    FROM (SELECT *, (event_id % 7200)::BIGINT AS t FROM events) GROUP BY 1""")
def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), (F.col("event_id") % 7200).cast("double").alias("start_seconds"), F.col("event_type").alias("text"))
    return video.render_transcripts(e, "user_id").select("user_id", F.md5(F.col("transcript").cast("binary")).alias("transcript_md5"))


def _report_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"), F.col("lang").alias("title"), F.col("source").alias("channel"), F.col("n_chars").cast("long").alias("duration_seconds"))


_LABEL = "CASE WHEN {x} >= 3600 THEN format('{{}}:{{:02d}}:{{:02d}}', {x} // 3600, {x} % 3600 // 60, {x} % 60) ELSE format('{{}}:{{:02d}}', {x} // 60, {x} % 60) END"


@query(f"""SELECT doc_id AS ord, concat('- **', coalesce(lang, '(untitled)'), '** — ', coalesce(source, '?'), ' (', {_LABEL.format(x="n_chars")}, ', ', coalesce(n, 0), ' claims)') AS line
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) USING (doc_id)""")
def report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _t(spark, sf_dir, "labels").select(F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("video_id"))
    return report.source_lines(_report_videos(spark, sf_dir), claims)


def _report_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per event, of its user's video; its chunk is the event's, which every third event lacks."""
    e, v = _t(spark, sf_dir, "events"), F.concat(F.lit("v"), F.col("user_id").cast("string"))
    chunk = F.when(F.col("event_id") % 3 > 0, F.format_string("v%d_c%04d", "user_id", "event_id"))
    claims = e.select(F.format_string("k%d", "event_id").alias("claim_id"), v.alias("video_id"), F.col("event_type").alias("claim"), chunk.alias("chunk_id"))
    chunks = e.where("event_id % 3 = 1").select(F.format_string("v%d_c%04d", "user_id", "event_id").alias("chunk_id"), (F.col("event_id") % 5000 + 0.5).alias("start_seconds"), (F.col("event_id") % 2 == 0).alias("is_estimated"))
    return report.citation(claims, chunks, _report_videos(spark, sf_dir))


@query(f"""SELECT concat('k', event_id) AS claim_id, concat('v', user_id) AS source, concat(event_type, ' — [', coalesce(lang, concat('v', user_id)), ' @ ', CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN '~' ELSE '' END, {_LABEL.format(x="t")}, '](https://youtu.be/v', user_id, '?t=', t, ')') AS line
    FROM (SELECT *, CASE WHEN event_id % 3 = 1 THEN event_id % 5000 ELSE 0 END AS t FROM events) LEFT JOIN documents ON doc_id = user_id""")
def report_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_cited(spark, sf_dir).select("claim_id", "source", "line")


@query(r"SELECT conv_id, turn, regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[!.?]+$', '') IN (" + ", ".join(f"'{g}'" for g in answers.GREETINGS) + ") AS greets FROM conversations")
def greetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", answers.is_greeting(F.col("text")).alias("greets"))
