"""Column functions: all are JVM expressions, columns in and columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Removes white space of any kind at both ends (Spark's trim removes blanks only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lowered text."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(x: Column) -> Column:
    """Splits after . ! ? and white space; stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def content_hash(x: Column) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def point_id(x: Column) -> Column:
    """First 15 hex digits of the SHA-1, as a number of 60 bits."""
    return F.conv(F.substring(F.sha1(x.cast("binary")), 1, 15), 16, 10).cast("long")


def timestamp_label(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour; fractions are cut off; null is 0."""
    s = F.coalesce(seconds.cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def timestamp_range(start: Column, end: Column, estimated: Column) -> Column:
    mark = F.when(estimated, "~").otherwise("")
    return F.concat(mark, timestamp_label(start), F.lit("–"), mark, timestamp_label(end))


def seconds_of(hours: Column, minutes: Column, seconds: Column) -> Column:
    part = lambda x: F.coalesce(F.when(x == "", None).otherwise(x).cast("int"), F.lit(0))
    return (part(hours) * 3600 + part(minutes) * 60 + part(seconds)).cast("double")


def strip_fence(x: Column) -> Column:
    """The inside of a Markdown code fence, without its language name; other text is only stripped."""
    x = strip(x)
    return F.when(x.startswith("```"), strip(F.regexp_replace(F.get(F.split(x, "```"), F.lit(1)), "^json", ""))).otherwise(x)


def containment(a: Column, b: Column) -> Column:
    """Shared distinct words of the lowered texts over the smaller number of them; 0 if one has none."""
    a, b = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length)


def hit_at(retrieved: Column, expected: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), expected), F.lit(False))


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    at = F.array_position(F.transform(retrieved, lambda r: F.array_contains(expected, r)), F.lit(True))
    return F.when(at > 0, F.lit(1.0) / at).otherwise(F.lit(0.0))


def cited_labels(answer: Column) -> Column:
    """Distinct labels `Source <n>` for all numbers in brackets that hold the word Source, in text order."""
    brackets = F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]*?Source[^\[\]]*?)\]"), F.lit(1))
    numbers = F.flatten(F.transform(brackets, lambda b: F.regexp_extract_all(b, F.lit(r"\d+"), F.lit(0))))
    return F.array_distinct(F.transform(numbers, lambda n: F.concat(F.lit("Source "), n)))


def verify_citations(answer: Column, labels: Column) -> Column:
    cited = cited_labels(answer)
    invalid = F.array_sort(F.array_except(cited, labels))
    return F.struct(
        F.size(cited).alias("cited_count"), F.array_sort(F.array_intersect(cited, labels)).alias("valid_citations"), invalid.alias("invalid_citations"), (F.size(invalid) == 0).alias("all_valid")
    )


def without_chunk_suffix(chunk_id: Column) -> Column:
    """The video of a chunk id: what stands before its last `_c`."""
    return F.regexp_replace(chunk_id, r"_c(?!.*_c).*$", "")


def title_case(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))
