"""The boundary to language models: what goes in and out, never the model itself.

An operator that needs a model takes a function from batches of prompts to
batches of replies. Everything before (planning, batching, fencing) and after
(parsing, validation, grounding) is deterministic and lives in the operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

Model = Callable[[list[str]], list[str]]
# The sentence of a refusal, and the forms that end an answer.
REFUSAL = "I could not find relevant information in your files."
REFUSAL_ENDS = [
    "I could not find relevant information in your files.",
    "I could not find relevant information in your files",
    "I cannot find relevant information in your files.",
    "I couldn't find relevant information in your files.",
]
REFUSAL_PART = "could not find relevant information"
EXCERPTS = r"(?i)\b(?:the|these|those)\s+(?:provided\s+)?excerpts(?:\s+provided)?\b"
# Fixed values end.


def ask(rows: DataFrame, prompt_col: str, model: Model, reply_col: str = "reply", batch: int = 16) -> DataFrame:
    """Replies of a model, in small batches per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies: list[str] = []
            for a in range(0, len(f), batch):
                replies += model(f[prompt_col].iloc[a : a + batch].tolist())
            yield f.assign(**{reply_col: replies})

    return rows.mapInPandas(run, rows.withColumn(reply_col, F.lit("")).schema)


def fence(label: Column, text: Column, nonce: Column, size: int = 280_000) -> Column:
    """Untrusted text between fences that it can't forge, as the nonce is unknown to it."""
    return F.concat(F.lit("<<"), nonce, F.lit(" "), T.safe_label(label), F.lit(">>\n"), F.substr(text, F.lit(1), F.lit(size)), F.lit("\n<<end "), nonce, F.lit(">>"))


def is_refusal(answer: Column) -> Column:
    """Whether an answer is no more than the refusal: under 120 characters, in any case, with or without an apology."""
    a = F.lower(T.strip(F.coalesce(answer, F.lit(""))))
    return (F.length(a) < 120) & a.contains(REFUSAL_PART)


def scrub(answer: Column) -> Column:
    """Without a refusal after a real answer, and without talk of excerpts; a reply that begins with it is capitalised anew."""
    a = T.strip(answer)
    before = T.strip(F.regexp_replace(a, "(?:" + "|".join(re.escape(x) for x in REFUSAL_ENDS) + ")$", ""))
    a = F.when(before == "", a).otherwise(before)
    s = F.regexp_replace(a, EXCERPTS, "your files")
    return F.when(s.startswith("your files") & (s != a), F.concat(F.lit("Y"), F.substr(s, F.lit(2)))).otherwise(s)


def cited(sources: DataFrame, answer_col: str, name_col: str) -> DataFrame:
    """Sources the answer names (between characters that are no part of names); all if it names none, none after a question back."""
    from pyspark.sql import Window as W

    name = F.regexp_replace(F.lower(F.col(name_col)), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    hit = F.regexp_like(F.lower(F.col(answer_col)), F.concat(F.lit(r"(^|[^a-z0-9._-])"), name, F.lit(r"([^a-z0-9_-]|$)")))
    s = sources.withColumn("hit", hit).withColumn("any_hit", F.max("hit").over(W.partitionBy(answer_col)))
    return s.filter(F.col("hit") | (~F.col("any_hit") & ~F.trim(answer_col).endswith("?"))).drop("hit", "any_hit")


def summary_plan(chunks: Column, single: int = 60, groups: int = 3, most: int = 450) -> Column:
    """How many calls a summary of so many chunks takes: one, or up to three parts and a merge."""
    used = F.least(chunks, F.lit(most))
    return F.when(chunks <= single, 1).otherwise(F.least(F.lit(groups), F.ceil(used / 150)) + 1).cast("int")


def call_batches(size: Column, most_chars: int = 280_000, most_docs: int = 10) -> Column:
    """A lower bound on the calls for documents of the given total size and count."""
    return F.greatest(F.ceil(size["chars"] / most_chars), F.ceil(size["docs"] / most_docs))
