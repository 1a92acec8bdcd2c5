"""Transcription: from a URL to the raw payload {metadata, transcript}. Download and speech models are passed in."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the metadata fields of a payload
FIELDS = ("video_id", "title", "channel", "channel_url", "subscriber_count", "duration_seconds", "view_count", "like_count", "comment_count", "upload_date", "tags", "categories", "thumbnail_url", "is_live", "language", "description")

Download = Callable[[str, str], tuple[str, dict]]  # (url, folder) -> (audio file, all metadata)
Transcribe = Callable[[str], Iterable[tuple[float, str]]]  # audio file -> (start seconds, text)


def marker(seconds: Column) -> Column:
    """[MM:SS], minutes past 59 included."""
    s = seconds.cast("long")
    return F.format_string("[%02d:%02d]", F.floor(s / 60), F.pmod(s, F.lit(60)))


def render_transcripts(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """segments: key, ord, start_seconds, text. One transcript per video, a marked line per segment in order."""
    line = F.concat(marker(F.col("start_seconds")), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def on_first_device(load: Callable[[str], Transcribe], devices: Iterable[str] = ("cuda", "cpu")) -> Transcribe:
    """What load makes of the first device on which it works; the last failure is told if none does."""
    failed = None
    for device in devices:
        try:
            return load(device)
        except Exception as e:  # whatever a device lacks, the next one is tried
            failed = e
    raise RuntimeError(f"no device works: {failed}")


def payload(url: str, download: Download, transcribe: Transcribe) -> dict:
    """One video; the audio lives in a folder that goes when the transcript is there, or fails."""
    with tempfile.TemporaryDirectory() as folder:
        audio, meta = download(url, folder)
        lines = [f"[{int(at) // 60:02d}:{int(at) % 60:02d}] {text.strip()}" for at, text in transcribe(audio)]
    return {"metadata": {k: meta.get(k) for k in FIELDS}, "transcript": "\n".join(lines)}


def append_payload(path: str, item: dict) -> int:
    """Adds an item to a local JSON array, the root of which may be one object; a corrupt file starts anew. Returns its items."""
    items = []
    if os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                items = json.load(f)
        except json.JSONDecodeError:
            items = []
    items = [*(items if isinstance(items, list) else [items]), item]
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(items, f, ensure_ascii=False, indent=1)
    os.replace(f"{path}.new", path)
    return len(items)
