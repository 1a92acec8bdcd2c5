"""A cited Markdown report of a workspace, without any model: sources, themes, repeated points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import text as T


def citation(claims: DataFrame, chunks: DataFrame, videos: DataFrame) -> DataFrame:
    """claims: claim_id, video_id, claim, chunk_id (of its first evidence). Adds source (the video cited), line.

    The source is the chunk id's video, or the claim's own without evidence; a chunk or video that is not there
    gives time 0 and the video id as title.
    """
    at = chunks.select("chunk_id", "start_seconds", "is_estimated")
    rows = claims.join(at, "chunk_id", "left").withColumn("source", F.coalesce(F.nullif(T.without_chunk_suffix(F.col("chunk_id")), F.lit("")), F.col("video_id")))
    rows = rows.join(videos.select(F.col("video_id").alias("source"), "title"), "source", "left")
    start = F.coalesce(F.col("start_seconds").cast("long"), F.lit(0).cast("long"))
    mark = F.when(F.col("is_estimated"), "~").otherwise("")
    link = F.format_string("https://youtu.be/%s?t=%d", F.col("source"), start)
    line = F.concat("claim", F.lit(" — ["), F.coalesce("title", "source"), F.lit(" @ "), mark, T.timestamp_label(start), F.lit("]("), link, F.lit(")"))
    return rows.select("claim_id", "video_id", "source", F.coalesce("title", "source").alias("title"), line.alias("line"))


def source_lines(videos: DataFrame, claims: DataFrame) -> DataFrame:
    """(ord, line) of the videos: title, channel, duration and how many claims each has."""
    n = claims.groupBy("video_id").agg(F.count("*").alias("n"))
    rows = videos.join(n, "video_id", "left")
    line = F.format_string("- **%s** — %s (%s, %d claims)", F.coalesce("title", F.lit("(untitled)")), F.coalesce("channel", F.lit("?")), T.timestamp_label(F.col("duration_seconds")), F.coalesce("n", F.lit(0).cast("long")))
    return rows.select("ord", line.alias("line"))


def theme_lines(themes: DataFrame, cited: DataFrame) -> DataFrame:
    """themes: theme_no, relationship, videos (array), synthesis_note, member_claim_ids. (theme_no, pos, line): a
    heading, the note if there is one, and a line per member that is a known claim."""
    head = F.concat(F.lit("### "), T.title_case(F.coalesce("relationship", F.lit("related"))), F.lit(" — across "), F.array_join("videos", ", "))
    heads = themes.select("theme_no", F.lit(-2).alias("pos"), head.alias("line"))
    notes = themes.where("length(synthesis_note) > 0").select("theme_no", F.lit(-1).alias("pos"), F.concat(F.lit("> "), "synthesis_note").alias("line"))
    members = themes.select("theme_no", F.posexplode("member_claim_ids").alias("pos", "claim_id")).join(cited.select("claim_id", "line"), "claim_id")
    return heads.unionByName(notes).unionByName(members.select("theme_no", "pos", F.concat(F.lit("- "), "line").alias("line")))


def repeated_lines(clusters: DataFrame, cited: DataFrame) -> DataFrame:
    """clusters: cluster_id, size, member_claim_ids. (size, cluster_id, line) of those with more than one claim: how
    often, the titles, and the first member; a cluster whose first member is not a known claim goes."""
    rows = clusters.where("size > 1").select("cluster_id", "size", F.posexplode("member_claim_ids").alias("pos", "claim_id")).join(cited, "claim_id")
    one = rows.groupBy("cluster_id", "size").agg(F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("titles"), F.min(F.struct("pos", "line")).alias("first")).where("first.pos = 0")
    return one.select("size", "cluster_id", F.format_string("- (%d×, *%s*) %s", F.col("size").cast("long"), F.col("titles"), F.col("first.line")).alias("line"))


def _ordered(lines: DataFrame, order: list[Column], empty: str) -> str:
    found = [r["line"] for r in lines.orderBy(*order).select("line").toLocalIterator()]  # one workspace's report, as text for one reader
    return "\n".join(found) if found else empty


def render(workspace_id: str, videos: DataFrame, chunks: DataFrame, claims: DataFrame, themes: DataFrame, clusters: DataFrame) -> str:
    """The report's text. It is one document for a reader, streamed to the driver part by part."""
    cited = citation(claims, chunks, videos).cache()
    parts = [
        f"# Research Brief: {workspace_id}", f"{videos.count()} videos, {claims.count()} claims with checked evidence; each links to its time.",
        "## Sources", _ordered(source_lines(videos, claims), [F.col("ord")], ""),
        "## Cross-source themes", _ordered(theme_lines(themes, cited), [F.col("theme_no"), F.col("pos")], "_No cross-source themes detected yet._"),
        "## Most-emphasized points per source", _ordered(repeated_lines(clusters, cited), [F.desc("size"), F.col("cluster_id")], "_No repeated claims detected._"),
    ]
    cited.unpersist()
    return "\n\n".join(parts) + "\n"
