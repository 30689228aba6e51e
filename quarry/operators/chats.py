"""Conversations: pairing, history, search and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T


def exchanges(messages: DataFrame, last: int | None = None) -> DataFrame:
    """Each assistant message that directly follows a user message, other roles aside, with that question; the last n of each conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = messages.filter(F.col("role").isin("user", "assistant")).withColumn("before", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
    out = m.filter((F.col("role") == "assistant") & (F.col("before") == "user")).select("conv_id", "turn", "question", F.col("text").alias("answer"))
    if last is None:
        return out
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return out.withColumn("back", back).filter(F.col("back") <= last).drop("back")


def like(c: str, words: str) -> Column:
    """Case-insensitive containment in which % and _ keep their pattern meaning."""
    return F.col(c).ilike(f"%{words}%")


def search(messages: DataFrame, titles: DataFrame, words: str) -> DataFrame:
    """Conversations with a matching message or title."""
    hit = messages.filter(like("text", words)).select("conv_id").distinct()
    return titles.join(hit.withColumn("in_text", F.lit(True)), "conv_id", "left").filter(F.coalesce("in_text", F.lit(False)) | like("title", words)).drop("in_text")


def first_match(messages: DataFrame, words: str) -> DataFrame:
    """Per conversation a snippet around the first matching message, else its opening."""
    hit = F.min_by("text", F.when(like("text", words), F.col("turn")))
    opening = F.min_by("text", "turn")
    per = messages.groupBy("conv_id").agg(F.coalesce(hit, opening).alias("line"))
    return per.select("conv_id", T.snippet_around("line", words).alias("snippet"))


def titles(messages: DataFrame) -> DataFrame:
    """A conversation's title from its first user message, and its number of messages."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(T.title(F.coalesce(first, F.lit("New chat"))).alias("title"), F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


def delete(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the conversations in ``gone``; their messages go too."""
    return messages.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def context(messages: DataFrame, last: int = 3, size: int = 200) -> DataFrame:
    """Per conversation its last exchanges, each squeezed and cut, as text for a classifier."""
    e = exchanges(messages, last)
    line = F.concat(F.lit("Q: "), T.safe_preview(T.squeeze(F.col("question")), size), F.lit("\nA: "), T.safe_preview(T.squeeze(F.col("answer")), size))
    rows = e.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))  # at most ``last`` lines
    return rows.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))
