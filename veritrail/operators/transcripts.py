"""Transcript parsing, sentence times, chapters and chunk packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veritrail.functions import text as T

TARGET_WORDS = 180
OVERLAP_WORDS = 25
# fixed values: the formats of a transcript's markers and of a chapter's line
_MARKER = r"\[(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\]\s*(?:(Speaker \d+):)?\s*"
_CHAPTER = r"(?md)^(?:(\d{1,2}):)?(\d{1,2}):(\d{2})\s+([^\n]+)$"
_FIELD, _RECORD = "\x1f", "\x1e"


def parse_transcripts(videos: DataFrame, key: str = "video_id", transcript: str = "transcript") -> DataFrame:
    """One row per non-empty segment: key, ord, start_seconds, end_seconds (the next one's start), speaker, text.

    Text before the first marker is dropped; a transcript without markers is one segment at 0.
    """
    marked = F.regexp_replace(transcript, _MARKER, f"{_RECORD}$1{_FIELD}$2{_FIELD}$3{_FIELD}$4{_FIELD}")
    slots = F.split(marked, _RECORD)
    parts = videos.where(F.length(T.strip(F.col(transcript))) > 0).select(key, F.size(slots).alias("n"), F.posexplode(slots).alias("ord", "slot")).where("n = 1 or ord > 0")
    f = F.split("slot", _FIELD)
    rows = parts.select(
        key, F.col("ord").cast("long").alias("ord"), F.when(F.col("n") == 1, F.lit(0.0)).otherwise(T.seconds_of(F.get(f, F.lit(0)), F.get(f, F.lit(1)), F.get(f, F.lit(2)))).alias("start_seconds"),
        F.when((F.col("n") > 1) & (F.get(f, F.lit(3)) != ""), F.get(f, F.lit(3))).alias("speaker"),
        T.strip(F.when(F.col("n") == 1, F.col("slot")).otherwise(F.get(f, F.lit(4)))).alias("text"),
    ).where("text <> ''")
    return rows.withColumn("end_seconds", F.lead("start_seconds").over(W.partitionBy(key).orderBy("ord"))).select(key, "ord", "start_seconds", "end_seconds", "speaker", "text")


def chapters(description: Column) -> Column:
    """Array of (start_seconds, title) of the lines that begin with a time."""
    lines = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(_CHAPTER), F.lit(0))
    group = lambda x, k: F.regexp_extract(x, _CHAPTER, k)
    return F.transform(lines, lambda x: F.struct(T.seconds_of(group(x, 1), group(x, 2), group(x, 3)).alias("start_seconds"), T.strip(group(x, 4)).alias("title")))


def nearest_chapter(chapter_list: Column, seconds: Column) -> Column:
    """Title of the last chapter that starts at or before `seconds`; of equal starts the later in the list."""
    numbered = F.transform(chapter_list, lambda c, i: F.struct(c["start_seconds"].alias("s"), i.alias("i"), c["title"].alias("title")))
    return F.get(F.array_sort(F.filter(numbered, lambda c: c["s"] <= seconds)), F.size(F.filter(numbered, lambda c: c["s"] <= seconds)) - 1)["title"]


def nearest_chapter_join(events: DataFrame, marks: DataFrame, key: str, at: str = "seconds") -> DataFrame:
    """The same over tables: an as-of join as one sorted pass per key (events: key, at, ...; marks: key, start_seconds, title)."""
    both = events.select("*", F.lit(1).alias("is_event"), F.lit(None).cast("string").alias("mark")).unionByName(
        marks.select(key, F.col("start_seconds").alias(at), F.lit(0).alias("is_event"), F.col("title").alias("mark")), allowMissingColumns=True
    )
    seen = F.last("mark", ignorenulls=True).over(W.partitionBy(key).orderBy(at, "is_event", "mark").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("nearest_chapter_title", seen).where("is_event = 1").drop("is_event", "mark")


def sentence_times(segments: DataFrame, key: str = "video_id", duration: Column | None = None) -> DataFrame:
    """segments: key, ord, start_seconds, end_seconds, text. One row per sentence with its estimated times.

    Times are linear in words within a segment; a missing end is the video's duration; a negative span is 0.
    """
    duration = duration if duration is not None else F.col("duration_seconds")
    rows = segments.withColumn("span", F.greatest(F.coalesce("end_seconds", duration, "start_seconds") - F.col("start_seconds"), F.lit(0.0)))
    rows = rows.select(key, "ord", "start_seconds", "span", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("words", T.word_count(F.col("sentence")))
    by = W.partitionBy(key, "ord")
    before = F.coalesce(F.sum("words").over(by.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("total", F.greatest(F.sum("words").over(by), F.lit(1)))
    at = lambda n: F.round(F.col("start_seconds") + F.col("span") * n / F.col("total"), 6)
    return rows.select(key, "ord", "pos", "sentence", "words", at(F.col("before")).alias("start_seconds"), at(F.col("before") + F.col("words")).alias("end_seconds"))


def packed(sentence_list: Column, target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Chunks of an array of (text, words, start, end): arrays of these.

    Sentences gather until they have `target` words. The next chunk begins with those before the last one,
    walking back while they have fewer than `overlap` words; what is left at the end is a chunk if it has a new one.
    """
    s = "struct<text:string,words:int,start:double,end:double>"
    one = F.transform(sentence_list, lambda x: F.struct(x["text"].alias("text"), x["words"].cast("int").alias("words"), x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    empty = F.array().cast(f"array<{s}>")
    state = lambda cur, w, added, out: F.struct(cur.alias("cur"), w.cast("int").alias("w"), added.cast("int").alias("added"), out.alias("out"))

    def tail(cur: Column) -> Column:
        zero = F.struct(empty.alias("k"), F.lit(0).alias("w"))
        take = lambda a, x: F.when(a["w"] < overlap, F.struct(F.concat(F.array(x), a["k"]).alias("k"), (a["w"] + x["words"]).alias("w"))).otherwise(a)
        return F.aggregate(F.reverse(F.slice(cur, 1, F.size(cur) - 1)), zero, take)

    def step(a: Column, x: Column) -> Column:
        cur, w = F.concat(a["cur"], F.array(x)), a["w"] + x["words"]
        kept = tail(cur)
        return F.when(w >= target, state(kept["k"], kept["w"], F.lit(0), F.concat(a["out"], F.array(cur)))).otherwise(state(cur, w, a["added"] + 1, a["out"]))

    zero = state(empty, F.lit(0), F.lit(0), F.array().cast(f"array<array<{s}>>"))
    return F.aggregate(one, zero, step, lambda a: F.when(a["added"] > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def pack_chunks(videos: DataFrame, key: str = "video_id", sentence_list: str = "sentences") -> DataFrame:
    """One row per chunk: key, chunk_index, chunk_id, start_seconds, end_seconds, text, content_hash. No shuffle."""
    rows = videos.select(key, F.posexplode(packed(F.col(sentence_list))).alias("chunk_index", "units"))
    text = F.array_join(F.transform("units", lambda u: u["text"]), " ")
    return rows.select(
        key, "chunk_index", F.format_string("%s_c%04d", F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"), F.round(F.col("units")[0]["start"], 1).alias("start_seconds"),
        F.round(F.array_max(F.transform("units", lambda u: u["end"])), 1).alias("end_seconds"), text.alias("text"), T.content_hash(text).alias("content_hash"),
    )


def new_chunks(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming: video_ord, content_hash, ...; keeps chunks whose hash is neither in existing nor in an earlier
    video of incoming. Repeats inside one video stay."""
    owners = incoming.select("content_hash", F.col("video_ord").alias("owner"), F.lit(False).alias("old")).unionByName(existing.select("content_hash", F.lit(None).cast("long").alias("owner"), F.lit(True).alias("old")))
    owners = owners.groupBy("content_hash").agg(F.min("owner").alias("owner"), F.bool_or("old").alias("old")).where("not old").select("content_hash", "owner")
    return incoming.join(owners, "content_hash").where("video_ord = owner").drop("owner")
