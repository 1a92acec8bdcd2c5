"""Grounded answers: prompts with labelled sources and recent messages, the canned reply, checked citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import retrieval as R
from veritrail.sources.models import Client, PairScorer, complete, score_pairs
from veritrail.sources.store import written

#: Messages of the history that a prompt shows.
SHOWN_MESSAGES = 12
# fixed values: the reply that needs no model, and what greets
NOTHING_FOUND = "I couldn't find any relevant information in this workspace to answer that."
GREETINGS = ("hi", "hello", "hey", "yo", "hi bhai", "hey bhai", "hello bhai", "hii", "hey there", "namaste", "hola")
#: Fixed value: the format of a source in a prompt, on which its tokens depend.
SOURCE = "[Source %d]\nVideo: %s | Channel: %s | Timestamp: %s\n\n%s"
_RULES = {
    "grounded": "Answer from the sources below and nothing else. Put [Source N] behind every statement. Say so if they do not answer the question.",
    "assist": "Help with the task. Build on the sources below, cite them as [Source N], and say where you add knowledge of your own.",
}


def is_greeting(message: Column) -> Column:
    """Whether a message only greets, whatever its case and end marks."""
    return F.regexp_replace(F.lower(T.strip(message)), r"[!.?]+$", "").isin(*GREETINGS)


def source_block(label_no: Column, title: Column, channel: Column, times: Column, text: Column) -> Column:
    """A labelled source as a prompt shows it; its words, heading included, count towards the budget."""
    return F.format_string(SOURCE, label_no, title, channel, times, text)


def greeting_reply(workspace_id: str, mode: str = "grounded") -> str:
    more = "I can also help you use what is in them." if mode == "assist" else "Every answer cites them."
    return f"Hello! Ask me about the videos of {workspace_id}. {more}"


def contexts(labelled: DataFrame) -> DataFrame:
    """labelled: question_id, label_no, id, block. One row per question: context, labels, source_map (label to id).
    A question's blocks are within its budget, so one row holds them."""
    item = F.struct("label_no", "id", "block")
    rows = labelled.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    label = lambda x: F.format_string("Source %d", x["label_no"])
    return rows.select("question_id", F.array_join(F.transform("s", lambda x: x["block"]), "\n\n").alias("context"), F.transform("s", label).alias("labels"), F.map_from_entries(F.transform("s", lambda x: F.struct(label(x), x["id"]))).alias("source_map"))


def prompt(question: Column, context: Column, history: Column, mode: str = "grounded") -> Column:
    """history: array of (role, content), oldest first; its last SHOWN_MESSAGES are shown."""
    shown = F.slice(history, F.greatest(F.size(history) - SHOWN_MESSAGES + 1, F.lit(1)), SHOWN_MESSAGES)
    said = F.array_join(F.transform(shown, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    before = F.when(F.size(history) > 0, F.concat(F.lit("Conversation so far:\n"), said, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(_RULES[mode] + "\n\n"), before, F.lit("Sources:\n"), context, F.lit("\n\nQuestion: "), question)


def ask(questions: DataFrame, labelled: DataFrame, make_client: Callable[[], Client], history: DataFrame | None = None, mode: str = "grounded") -> DataFrame:
    """questions: question_id, question. labelled: what `within_budget` returns. history: question_id, history.

    One row per question: question_id, answer, citation_check, verified, mode, source_map. A question without sources
    gets the canned reply and asks no model. Only grounded answers whose every citation is valid are verified.
    """
    rows = questions.select("question_id", "question").join(contexts(labelled), "question_id", "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    rows = rows.join(history.select("question_id", "history"), "question_id", "left").withColumn("history", F.coalesce("history", none)) if history is not None else rows.withColumn("history", none)
    rows = written(rows, "contexts")  # the prompts and the answers' checks read them
    found = rows.where("context is not null").select("question_id", prompt(F.col("question"), F.col("context"), F.col("history"), mode).alias("prompt"))
    got = written(complete(found, make_client, "question_id").select("question_id", "raw", "error"), "replies")
    rows = rows.join(got, "question_id", "left").withColumn("answer", F.when(F.col("context").isNull(), NOTHING_FOUND).otherwise(F.col("raw")))
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    check = T.verify_citations(F.when(F.col("context").isNull(), "").otherwise(F.coalesce("answer", F.lit(""))), labels)
    rows = rows.withColumn("citation_check", check)
    ok = F.lit(mode == "grounded") & F.col("citation_check.all_valid") & F.col("answer").isNotNull()
    return rows.select("question_id", "answer", "citation_check", ok.alias("verified"), F.lit(mode).alias("mode"), "source_map", "error")


def reranked(chunks: DataFrame, questions: DataFrame, fused: DataFrame, keep: int = 8, make_scorer: Callable[[], PairScorer] | None = None) -> DataFrame:
    """chunks: id, text. fused: question_id, rank, id. The best of the fused rows by a pair scorer (token overlap, if none
    is given), with their texts."""
    rows = fused.select("question_id", "rank", "id").join(questions.select("question_id", "question"), "question_id").join(chunks.select("id", "text"), "id")
    if make_scorer is None:
        return R.rerank(rows, keep, R.token_overlap(F.col("question"), F.col("text")))
    return R.rerank(score_pairs(rows, "question", "text", "by_model", make_scorer), keep, F.col("by_model"))


def hybrid_contexts(chunks: DataFrame, questions: DataFrame, fused: DataFrame, keep: int = 8, budget: float = 1500.0, make_scorer: Callable[[], PairScorer] | None = None) -> DataFrame:
    """chunks: id, title, channel, times, text. fused: question_id, rank, id. Reranked, deduplicated, labelled and cut to budget."""
    kept = R.deduplicate_context(reranked(chunks, questions, fused, keep, make_scorer)).join(chunks.select("id", "title", "channel", "times"), "id")
    return R.within_budget(kept, source_block(F.col("label_no"), F.col("title"), F.col("channel"), F.col("times"), F.col("text")), budget)
