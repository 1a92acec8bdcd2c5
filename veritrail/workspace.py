"""A workspace: its tables under one folder, and the steps that fill and read them. The command line and the HTTP routes
call nothing else. Tables are Parquet, partitioned by workspace_id; each step replaces its workspace's partition only."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from veritrail.functions import text as T
from veritrail.operators import answers, report, synthesis
from veritrail.operators import claims as C
from veritrail.operators import retrieval as R
from veritrail.operators import transcripts as P
from veritrail.sources import store
from veritrail.sources.models import Client, Embedder, PairScorer, embed

SCHEMAS = {
    "videos": "workspace_id STRING, ord BIGINT, video_id STRING, title STRING, channel STRING, duration_seconds BIGINT, description STRING, transcript STRING",
    "chunks": "workspace_id STRING, id BIGINT, video_ord BIGINT, video_id STRING, ord BIGINT, chunk_id STRING, title STRING, channel STRING, nearest_chapter_title STRING, start_seconds DOUBLE, end_seconds DOUBLE, is_estimated BOOLEAN, text STRING, content_hash STRING",
    "vectors": "workspace_id STRING, id BIGINT, vector ARRAY<DOUBLE>",
    "claim_cache": f"workspace_id STRING, content_hash STRING, claims ARRAY<{C.CLAIM}>",
    "clusters": "workspace_id STRING, cluster_id STRING, size INT, member_claim_ids ARRAY<STRING>",
    "synthesis": "workspace_id STRING, cluster_id STRING, videos STRING, unique_videos BIGINT, support_count BIGINT, oppose_count BIGINT, neutral_count BIGINT, total_evidence BIGINT, size BIGINT, relationship STRING, synthesis_note STRING, status STRING",
    "themes": "workspace_id STRING, theme_no INT, relationship STRING, videos ARRAY<STRING>, synthesis_note STRING, member_claim_ids ARRAY<STRING>",
    "messages": "workspace_id STRING, ord BIGINT, role STRING, content STRING, mode STRING",
}


@dataclass(frozen=True)
class Models:
    """Makers of the models that a worker loads once. Without an embedder, texts are bags of words; without a scorer, pairs
    are scored by shared tokens. query_prefix stands before a question, for embedders that want one."""

    embedder: Callable[[], Embedder] | None = None
    scorer: Callable[[], PairScorer] | None = None
    query_prefix: str = ""


def columns(name: str) -> list[str]:
    """A table's columns without workspace_id."""
    return [f.name for f in StructType.fromDDL(SCHEMAS[name]) if f.name != "workspace_id"]


class Workspace:
    def __init__(self, spark: SparkSession, root: str, workspace_id: str, models: Models = Models()) -> None:
        self.spark, self.root, self.id, self.models = spark, root.rstrip("/"), store.checked_workspace(workspace_id), models

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return store.read_optional(self.spark, self._path(name), SCHEMAS[name]).where(F.col("workspace_id") == self.id)

    def _put(self, name: str, rows: DataFrame) -> None:
        """Rows become this workspace's partition of a table, also if there are none."""
        store.replace_workspace(rows.select(*columns(name)), self._path(name), self.id)

    def _embedded(self, rows: DataFrame, text: str, prefix: str = "") -> DataFrame:
        """rows with `vector`."""
        if self.models.embedder is None:
            return rows.withColumn("vector", R.bag_of_words(text))
        return embed(rows, text, "vector", self.models.embedder, prefix)

    def _unchanged(self, step: str, signature: str) -> bool:
        return store.read_signature(self.spark, f"{self.root}/_signatures/{self.id}-{step}") == signature

    def _sign(self, step: str, signature: str) -> None:
        store.write_text(self.spark, f"{self.root}/_signatures/{self.id}-{step}", signature)

    def ingest(self, path: str) -> dict[str, int]:
        """Adds the videos of a JSON file; known videos and known chunks add nothing."""
        known = self.table("videos")
        start = known.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        got = store.read_videos(self.spark, path).withColumn("ord", F.monotonically_increasing_id() + start)
        first = got.groupBy("video_id").agg(F.min("ord").alias("ord"))
        got = got.join(first, ["video_id", "ord"], "left_semi").join(known.select("video_id"), "video_id", "left_anti")
        seg = P.parse_transcripts(got).join(got.select("video_id", "duration_seconds"), "video_id")
        sentences = P.sentence_times(seg)
        item = F.struct("ord", "pos", F.col("sentence").alias("text"), "words", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
        packed = P.pack_chunks(sentences.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("sentences")))
        chunks = packed.join(got.select("video_id", F.col("ord").alias("video_ord"), "title", "channel", P.chapters(F.col("description")).alias("chapters")), "video_id")
        chunks = chunks.withColumn("nearest_chapter_title", P.nearest_chapter(F.col("chapters"), F.col("start_seconds")))
        chunks = chunks.withColumn("id", T.point_id(F.col("chunk_id"))).withColumn("ord", F.col("chunk_index").cast("long")).withColumn("is_estimated", F.lit(True))
        old = self.table("chunks")
        before, n_videos = old.count(), known.count()
        cols = columns("chunks")
        incoming = store.written(chunks.select(*cols), "incoming")
        fresh = P.new_chunks(incoming, old)
        self._put("chunks", old.select(*cols).unionByName(fresh.select(*cols)))
        added = self.table("chunks").select("video_id").distinct()
        vcols = columns("videos")
        self._put("videos", known.select(*vcols).unionByName(got.join(added, "video_id", "left_semi").select(*vcols)))
        videos, after = self.table("videos").count(), self.table("chunks").count()
        listed = store.read_videos(self.spark, path).select("video_id").distinct().count()
        return {"videos": videos, "chunks": after, "added": after - before, "skipped": incoming.count() - (after - before), "videos_added": videos - n_videos, "videos_skipped": listed - (videos - n_videos)}

    def add(self, payload: dict, make_client: Callable[[], Client]) -> dict:
        """One video, {metadata, transcript}, through all steps. Themes are left as they are if labelling them fails."""
        beside = f"{self.root}/_new/raw-{self.id}"
        raw = json.dumps([payload], ensure_ascii=False)
        self.spark.createDataFrame([(raw,)], "value string").coalesce(1).write.mode("overwrite").text(beside)
        got = {**self.ingest(beside), "indexed": self.index(), **self.extract_claims(make_client), **self.cluster(synthesis.asking(make_client))}
        try:
            got |= self.synthesize(make_client)
        except Exception as e:
            got["themes_error"] = f"{type(e).__name__}: {e}"[:500]
        return got

    def add_all(self, urls: Iterable[str], fetch: Callable[[str], dict], make_client: Callable[[], Client]) -> list[dict]:
        """Fetches and adds videos in turn; one that fails is told and skipped."""
        found = []
        for url in urls:
            try:
                found.append({"url": url, **self.add(fetch(url), make_client)})
            except Exception as e:
                found.append({"url": url, "error": f"{type(e).__name__}: {e}"[:500]})
        return found

    def urls(self, path: str) -> list[str]:
        """The URLs of a list file; someone wrote it by hand, one line a video."""
        return [r.url for r in store.read_urls(self.spark, path).toLocalIterator()]

    def known(self) -> bool:
        return not self.table("videos").isEmpty()

    def index(self) -> int:
        """Embeds the chunks that have no vector yet; vectors of chunks that are gone go."""
        chunks, old = self.table("chunks").select("id", "text"), self.table("vectors").select("id", "vector")
        fresh = self._embedded(chunks.join(old.select("id"), "id", "left_anti"), "text").select("id", "vector")
        self._put("vectors", old.join(chunks.select("id"), "id", "left_semi").unionByName(fresh))
        return self.table("vectors").count()

    def extract_claims(self, make_client: Callable[[], Client]) -> dict[str, int]:
        """Asks for the claims of chunks that the cache lacks. The counts are of chunks, cached and asked for, and of claims."""
        cache, chunks = self.table("claim_cache").select("content_hash", "claims"), self.table("chunks")
        total, missing = chunks.count(), C.cache_misses(chunks, cache).count()
        fresh, rejected = synthesis.extract_claims(chunks, cache, make_client)
        refused, known = rejected.count(), cache.count()
        self._put("claim_cache", cache.unionByName(fresh))
        return {"chunks": total, "cached": total - missing, "new": missing, "answered": self.table("claim_cache").count() - known, "claims": self.claims().count(), "rejected": refused}

    def claims(self) -> DataFrame:
        """The chunks' claims, whole, from the cache, with ord, claim_id, and chunk_id and video_id of the first evidence's chunk."""
        chunks = self.table("chunks")
        rows = C.claims_from_cache(chunks, self.table("claim_cache")).join(chunks.select("chunk_id", "video_id", "video_ord"), "chunk_id")
        nth = F.row_number().over(W.partitionBy(F.lit(self.id)).orderBy("video_ord", "ord", "pos"))  # one workspace's claims
        c = [F.col(f"claim.{k}").alias(k) for k in ("claim", "claim_type", "stance", "evidence", "topics")]
        return rows.select(nth.cast("long").alias("ord"), "claim_id", *c, "video_id", "chunk_id")

    def cluster(self, agrees: Callable[[], synthesis.Adjudicator] | None = None, force: bool = False) -> dict[str, int]:
        """Clusters the claims; `agrees` makes an adjudicator (none: no doubtful pair merges). Unchanged claims are not
        clustered again, unless a model failed the last time."""
        found, asks = self.claims(), agrees is not None
        signature = store.fingerprint(found.select("claim_id", "claim"), C.WITHIN_MERGE, synthesis.GRAY_ZONE, synthesis.CROSS_FLOOR, asks)
        if not force and self._unchanged("cluster", signature):
            return {"clusters": self.table("clusters").count(), "reused": 1}
        texts = self.table("chunks").select("chunk_id", F.col("text").alias("context"))
        rows = self._embedded(found.join(texts, "chunk_id", "left"), "claim")
        rows = rows.select(F.lit(self.id).alias("workspace_id"), "ord", "claim_id", F.col("video_id").alias("video"), "claim", "context", "vector")
        done = store.written(synthesis.cluster_adjudicated(rows, agrees or (lambda: lambda *_: False)), "clustered")
        self._put("clusters", synthesis.members(done))
        counts = synthesis.clustering_counts(done).drop("workspace_id").first()
        counts = counts.asDict() if counts is not None and asks else {}
        if not counts.get("adjudication_errors"):
            self._sign("cluster", signature)
        return {"clusters": self.table("clusters").count(), **counts}

    def synthesize(self, make_client: Callable[[], Client], force: bool = False) -> dict[str, int]:
        """How each cluster's sources relate, and the themes across sources that did not merge. Unchanged claims and clusters
        ask no model again."""
        rows, clusters = self.claims(), self.table("clusters")
        signature = store.fingerprint(rows.select("claim_id", "claim"), store.fingerprint(clusters.select("cluster_id", "member_claim_ids")))
        if force or not self._unchanged("synthesis", signature):
            of = clusters.select("cluster_id", F.explode("member_claim_ids").alias("claim_id"))
            self._put("synthesis", synthesis.synthesize_clusters(of.join(rows, "claim_id").withColumn("n_evidence", F.size("evidence")), make_client))
            self.themes(make_client)
            self._sign("synthesis", signature)
        found = self.table("synthesis")
        return {"clusters": found.count(), "across": found.where("unique_videos >= 2").count(), "themes": self.table("themes").count()}

    def themes(self, make_client: Callable[[], Client]) -> int:
        rows = self.claims()
        pairs = C.theme_pairs(self._embedded(rows.select("ord", F.col("video_id").alias("video"), "claim"), "claim"), 0.80)
        self._put("themes", synthesis.label_themes(C.theme_match(pairs), rows, make_client))
        return self.table("themes").count()

    def report(self, path: str | None = None) -> str:
        """The report's text, written to a file too if a path is given."""
        text = report.render(self.id, self.table("videos"), self.table("chunks"), self.claims(), self.table("themes"), self.table("clusters"))
        if path is not None:
            store.write_text(self.spark, path, text)
        return text

    def retrieve(self, questions: DataFrame, k: int = 25) -> DataFrame:
        """questions: question_id, question. BM25 and vector lists of k, fused."""
        asked = self._embedded(questions.select("question_id", "question"), "question", self.models.query_prefix).select("question_id", "vector")
        near = R.vector_top_k(self.table("vectors").select("id", "vector"), asked, k)
        words = R.bm25_top_k(self.table("chunks").select("id", "text"), questions, k, "id")
        return R.reciprocal_rank_fusion([near, words], k)

    def ask(self, question: str, make_client: Callable[[], Client], mode: str = "grounded", history: list[dict] | None = None, keep: bool = True) -> dict:
        """The answer with its checked citations. The stored messages are its history, unless one is given; question and
        answer become messages if keep is set. A mere greeting is answered at once, and not kept."""
        if self.spark.range(1).where(answers.is_greeting(F.lit(question))).count():
            none = {"cited_count": 0, "valid_citations": [], "invalid_citations": [], "all_valid": True}
            return {"question_id": 0, "answer": answers.greeting_reply(self.id, mode), "citation_check": none, "verified": False, "mode": mode, "source_map": {}, "error": None}
        q = self.spark.createDataFrame([(0, question)], "question_id long, question string")
        chunks = self.table("chunks").select("id", "title", "channel", T.timestamp_range(F.col("start_seconds"), F.col("end_seconds"), F.col("is_estimated")).alias("times"), "text")
        said = self.table("messages")
        recent = store.last_messages(said, "workspace_id", ["ord desc"], 20).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", "content"))), lambda m: F.struct(m["role"], m["content"])).alias("history")).withColumn("question_id", F.lit(0).cast("long"))
        if history is not None:
            recent = self.spark.createDataFrame([(0, [(m.get("role"), m.get("content")) for m in history])], "question_id long, history array<struct<role:string,content:string>>")
        got = answers.ask(q, answers.hybrid_contexts(chunks, q, self.retrieve(q), make_scorer=self.models.scorer), make_client, recent, mode).first().asDict(recursive=True)
        if not keep:
            return got
        n = said.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        new = self.spark.createDataFrame([(n, "user", question, mode), (n + 1, "assistant", got["answer"], mode)], "ord long, role string, content string, mode string")
        new.withColumn("workspace_id", F.lit(self.id)).write.mode("append").partitionBy("workspace_id").parquet(self._path("messages"))
        return got

    def evaluate(self, path: str, results: str | None = None, k: int = 8) -> list[dict]:
        """A JSON array of question, category, expected_chunk_ids; hit rates and reciprocal ranks of the k rows that the
        reranker keeps of the fused lists. results: a folder that gets each question's outcome as JSON."""
        items = self.spark.read.schema("question STRING, category STRING, expected_chunk_ids ARRAY<STRING>").option("multiLine", True).json(path).withColumn("question_id", F.monotonically_increasing_id())
        items = store.written(items, "questions")
        chunks = self.table("chunks")
        got = answers.reranked(chunks.select("id", "text"), items, self.retrieve(items), k, self.models.scorer).join(chunks.select("id", "chunk_id"), "id")
        lists = got.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
        rows = items.join(lists, "question_id", "left").select("question", "category", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), F.col("expected_chunk_ids").alias("expected"))
        rows = store.written(rows, "evaluated")
        if results is not None:
            told = rows.select("question", F.coalesce("category", F.lit("unlabeled")).alias("category"), "expected", F.slice("retrieved", 1, 5).alias("retrieved_top5"), T.reciprocal_rank(F.col("retrieved"), F.col("expected")).alias("reciprocal_rank"), *(T.hit_at(F.col("retrieved"), F.col("expected"), n).alias(f"hit@{n}") for n in (1, 3, 5)))
            told.write.mode("overwrite").json(results)
        return [json.loads(r) for r in R.evaluate(rows).toJSON().toLocalIterator()]

    def titles(self) -> list[str]:
        """The videos' titles, cut at 60 characters, with their channels."""
        rows = self.table("videos").orderBy("ord").select(F.format_string("%s (%s)", F.substring(F.coalesce("title", F.lit("?")), 1, 60), F.coalesce("channel", F.lit("?"))).alias("t"))
        return [r.t for r in rows.toLocalIterator()]

    def status(self) -> dict[str, int | None]:
        """Records of each table; None where there is none yet."""
        return {name: self.table(name).count() if store.exists(self.spark, self._path(name)) else None for name in SCHEMAS}

    def delete(self) -> dict[str, int]:
        """Vectors go first, so that a failure leaves nothing that points to deleted chunks."""
        order = ["vectors", *(n for n in SCHEMAS if n != "vectors")]
        return {name: store.delete_workspace(self.spark, self._path(name), self.id) for name in order}


def workspaces(spark: SparkSession, root: str) -> list[dict]:
    """All workspaces with their videos, chunks, exchanges, and their first three titles, cut at 40 characters."""
    chunks, messages, videos = (store.read_optional(spark, f"{root}/{name}", SCHEMAS[name]) for name in ("chunks", "messages", "videos"))
    first = videos.withColumn("nth", F.row_number().over(W.partitionBy("workspace_id").orderBy("ord"))).where("nth <= 3")
    named = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.substring(F.coalesce("title", F.lit("?")), 1, 40).alias("t")))), lambda x: x["t"])
    rows = store.workspace_counts(chunks, messages).join(first.groupBy("workspace_id").agg(F.array_join(named, "; ").alias("titles")), "workspace_id", "left")
    return [r.asDict() for r in rows.orderBy("workspace_id").toLocalIterator()]
