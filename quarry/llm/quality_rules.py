"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words
are compared with those of its language (from all documents of that language
that pass the base rules) by Jensen-Shannon distance, 0 to 1. Short documents
are guarded: a histogram of fewer than ``MIN_CHARS`` characters or
``MIN_WORDS`` words gives no verdict. A language with fewer than ``MIN_REFERENCE``
words in all uses the reference of the whole corpus.

Repeated words: each 3-word window is packed as 33 bits of hash and 31 bits of
position into a long, so one sort of longs finds candidates; windows that meet
there are then compared word by word.

Defined cases: null and empty texts have no words and fail the base rules; a
null lang is a language of its own (``und``); repeated rows each get a row; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.workspace import Workspace, broadcast_if_small

SPACE = r"[\x20\x09-\x0D]+"
MIN_CHARS = 200
MIN_WORDS = 50
MIN_REFERENCE = 1000
#: Limits for long documents. A sample of n draws lies about sqrt(bins / (8 n ln 2)) away from
#: its own source, so that square, with these numbers of bins in use, is added to the limit's.
MAX_CHAR_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.25
CHAR_BINS = 9
WORD_BINS = 25

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais comme ou si leur y être cette aux ses on nous son elle",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien",
}
# Fixed values end.

VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Character classes, each counted after those before it are taken out.
CLASSES = (("lower", "[a-z]+"), ("space", SPACE), ("upper", "[A-Z]+"), ("symbol", "[#*$%&|<>]+"), ("digit", "[0-9]+"), ("punct", r"[\x21-\x7E]+"), ("umlaut", "[äöüßÄÖÜ]+"), ("accent", "[à-öø-ÿÀ-ÖØ-ÞœŒ]+"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document; ``chars`` and ``common`` are its histograms."""
    d = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != "")).withColumn("n", F.size("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("lines")
    # Windows that may repeat, by their packed hashes.
    pack = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.shiftleft(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), 31).bitwiseOR(i.cast("long")))
    d = d.withColumn("packed", F.when(F.col("n") >= 3, F.sort_array(pack)).otherwise(F.array().cast("array<bigint>")))
    same = lambda x, i: F.coalesce(F.shiftright(x, 31) == F.shiftright(F.get("packed", i), 31), F.lit(False))
    d = d.withColumn("maybe", F.filter("packed", lambda x, i: same(x, i - 1) | same(x, i + 1))).drop("packed")
    # Their words decide.
    spell = lambda x: F.struct(*(F.get("w", x.bitwiseAND(0x7FFFFFFF).cast("int") + k).alias(f"w{k}") for k in range(3)), x.bitwiseAND(0x7FFFFFFF).cast("int").alias("p"))
    d = d.withColumn("spelt", F.when(F.size("maybe") > 0, F.sort_array(F.transform("maybe", spell))))
    alike = lambda x, i: F.coalesce((x["w0"] == F.get("spelt", i)["w0"]) & (x["w1"] == F.get("spelt", i)["w1"]) & (x["w2"] == F.get("spelt", i)["w2"]), F.lit(False))
    d = d.withColumn("at", F.when(F.size("maybe") > 0, F.sort_array(F.transform(F.filter("spelt", lambda x, i: alike(x, i - 1) | alike(x, i + 1)), lambda x: x["p"])))).drop("maybe", "spelt")
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")
    # Common words as sorted codes, then runs.
    vocab = F.array(*map(F.lit, VOCABULARY))
    d = d.withColumn("codes", F.sort_array(F.transform(F.filter(F.transform("w", F.lower), lambda x: x.isin(VOCABULARY)), lambda x: F.array_position(vocab, x).cast("int")))).drop("w")
    d = d.withColumn("runs", F.filter(F.sequence(F.lit(0), F.size("codes")), lambda i: (i < F.size("codes")) & ((i == 0) | (F.get("codes", i) != F.get("codes", i - 1)))))
    d = d.withColumn("common", F.transform("runs", lambda p, j: F.struct(F.get("codes", p).alias("code"), (F.coalesce(F.get("runs", j + 1), F.size("codes")) - p).cast("long").alias("n")))).drop("codes", "runs")
    # Character classes, taken out one after the other.
    d = d.withColumn("len", F.length("t"))
    counts = []
    for name, pattern in CLASSES:
        d = d.withColumn("rest", F.regexp_replace("t", pattern, "")).withColumn("left", F.length("rest"))
        d = d.select(*(c for c in d.columns if c not in ("t", "rest", "left", "len")), (F.col("len") - F.col("left")).cast("long").alias(f"c_{name}"), F.col("rest").alias("t"), F.col("left").alias("len"))
        counts.append(F.col(f"c_{name}"))
    chars = F.array(*counts, F.col("len").cast("long"))
    total = sum(counts[1:], counts[0]) + F.col("len")
    return d.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), (total - F.col("c_space")).alias("word_chars"), F.col("c_symbol").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"), "n_repeat_words", chars.alias("chars"), "common"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(feats: DataFrame) -> DataFrame:
    """(lang, ref_words, char_p, word_p) of each language, and of all under the name "*"."""
    good = feats.filter(~base_failed())
    k = len(CLASSES) + 1
    sums = lambda by: by.agg(F.sum("n_words").alias("ref_words"), *(F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(k)))
    per_lang = sums(good.groupBy("lang"))
    codes = good.select("lang", F.inline("common")).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    entries = F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("words")  # one entry per vocabulary word at most
    one = per_lang.join(codes.groupBy("lang").agg(entries), "lang", "left")
    # A row per language; in the pooled row they are added up word by word.
    words = codes.groupBy("code").agg(F.sum("n").alias("n")).agg(entries)
    every = per_lang.agg(F.sum("ref_words").alias("ref_words"), *(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))).join(F.broadcast(words), F.lit(True), "left")  # a row each
    count = lambda m, code: F.coalesce(F.try_element_at(m, code), F.lit(0).cast("long"))
    each = F.sequence(F.lit(1), F.lit(len(VOCABULARY)))
    own, pooled = (d.withColumn("w", F.transform(each, lambda c: count(F.col("words"), c))) for d in (one, every.withColumn("lang", F.lit("*"))))
    cols = ["lang", "ref_words", *(f"c{i}" for i in range(k)), "w"]
    both = own.select(cols).union(pooled.select(cols))
    chars = F.array(*(F.col(f"c{i}") for i in range(k)))
    p = lambda a, total: F.transform(a, lambda x: x / F.greatest(total, F.lit(1)))
    words = F.col("w")
    total_chars = F.aggregate(chars, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long")))
    out = both.select("lang", "ref_words", p(chars, total_chars).alias("char_p"), p(words, F.col("ref_words")).alias("word_p"))
    return out.filter("ref_words > 0")


def _term(p: Column, q: Column) -> Column:
    """p log2(2p / (p + q)), 0 for p = 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def _add(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def distances(feats: DataFrame, refs: DataFrame) -> DataFrame:
    """The documents with char_distance and word_distance (null where a guard holds or no reference exists)."""
    # At most a row per language, and one more.
    pooled = refs.filter("lang = '*'").select(F.col("char_p").alias("all_char_p"), F.col("word_p").alias("all_word_p"))
    own = refs.filter(F.col("lang") != "*").filter(F.col("ref_words") >= MIN_REFERENCE).select("lang", "char_p", "word_p")
    d = feats.join(broadcast_if_small(own, limit=10_000), "lang", "left").join(F.broadcast(pooled), F.lit(True), "left")
    d = d.withColumn("char_p", F.coalesce("char_p", "all_char_p")).withColumn("word_p", F.coalesce("word_p", "all_word_p"))
    size = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("chars_n", size)
    js = _add(F.zip_with(F.transform("chars", lambda x: x / F.greatest("chars_n", F.lit(1))), "char_p", lambda p, q: _term(p, q) + _term(q, p))) / 2
    # Words of the document one by one; bins it lacks add half their reference share; the rest of the words is a bin.
    has = F.transform("common", lambda x: F.struct((x["n"] / F.col("n_words")).alias("p"), F.get("word_p", x["code"] - 1).alias("q")))
    d = d.withColumn("has", has)
    seen = _add(F.transform("has", lambda x: _term(x["p"], x["q"]) + _term(x["q"], x["p"])))
    lacks = _add("word_p") - _add(F.transform("has", lambda x: x["q"]))
    rest_p, rest_q = 1 - _add(F.transform("has", lambda x: x["p"])), 1 - _add("word_p")
    word = (seen + F.greatest(lacks, F.lit(0.0)) + _term(rest_p, rest_q) + _term(rest_q, rest_p)) / 2
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    d = d.withColumn("char_distance", F.when(F.col("chars_n") >= MIN_CHARS, root(js))).withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, root(word)))
    return d.drop("has", "char_p", "word_p", "all_char_p", "all_word_p", "chars_n")


def judge(spark: SparkSession, docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Every document with its counts, distances, base_failed and kept."""
    ws = Workspace(spark, "quality-rules")
    feats = ws.stage(features(docs), "features")
    refs = ws.stage(references(feats), "references")
    d = distances(feats, refs).withColumn("base_failed", base_failed())
    limit = lambda most, bins, n: F.sqrt(F.lit(most * most) + F.lit(bins / (8 * math.log(2))) / F.greatest(F.col(n), F.lit(1)))
    far = F.coalesce(F.col("char_distance") > limit(max_char, CHAR_BINS, "word_chars"), F.lit(False)) | F.coalesce(F.col("word_distance") > limit(max_word, WORD_BINS, "n_words"), F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~far)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same rows in DuckDB."""
    count = lambda c: f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))"
    vocab = ", ".join(f"('{w}')" for w in VOCABULARY)
    names = ["lower", "space", "upper", "symbol", "digit", "punct", "umlaut", "accent", "other"]
    term = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
    both = lambda p, q: f"{term(p, q)} + {term(q, p)}"
    limit = lambda most, bins, n: f"sqrt({most * most} + {bins / (8 * math.log(2))} / greatest({n}, 1))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE n > 1) GROUP BY doc_id),
k AS (SELECT doc_id, lang, len(w) AS n_words, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, length(t) AS size,
  {count('a-z')} AS c_lower, {count(chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D')} AS c_space, {count('A-Z')} AS c_upper, {count('#*$%&|<>')} AS c_symbol, {count('0-9')} AS c_digit,
  {count(chr(92) + 'x21-' + chr(92) + 'x7E')} AS ascii, {count('äöüßÄÖÜ')} AS c_umlaut, {count('à-öø-ÿÀ-ÖØ-ÞœŒ')} - ({count('äöüÄÖÜ')}) AS c_accent FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, ascii - c_lower - c_upper - c_symbol - c_digit AS c_punct, size - ascii - c_space - c_umlaut - c_accent AS c_other, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM k),
v AS (SELECT * FROM (VALUES {vocab}) AS v(word)),
c AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(list_transform(w, lambda x: lower(x))) AS word FROM w) JOIN v USING (word) GROUP BY ALL),
own AS (SELECT lang, sum(n_words) AS words, sum(size) AS chars, {', '.join(f'sum(c_{x}) AS c_{x}' for x in names)} FROM f WHERE NOT base_failed GROUP BY lang HAVING sum(n_words) >= {MIN_REFERENCE}),
every AS (SELECT '*' AS lang, sum(n_words) AS words, sum(size) AS chars, {', '.join(f'sum(c_{x}) AS c_{x}' for x in names)} FROM f WHERE NOT base_failed HAVING sum(n_words) > 0),
refs AS (SELECT * FROM own UNION ALL SELECT * FROM every),
cw AS (SELECT c.lang, word, sum(n) AS n FROM c JOIN f USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
rw AS (SELECT lang, word, n / words AS q FROM cw JOIN own USING (lang) UNION ALL SELECT '*', word, sum(n) / any_value(words) FROM cw, every GROUP BY word),
rest AS (SELECT lang, sum(q) AS q FROM rw GROUP BY lang),
x AS (SELECT f.*, coalesce(own.lang, '*') AS ref FROM f LEFT JOIN own ON own.lang = f.lang),
jc AS (SELECT x.doc_id, sqrt(greatest(({' + '.join('(' + both(f'(x.c_{n} / greatest(x.size, 1))', f'(r.c_{n} / greatest(r.chars, 1))') + ')' for n in names)}) / 2, 0)) AS d FROM x JOIN refs r ON r.lang = x.ref),
seen AS (SELECT x.doc_id, sum({both('(c.n / x.n_words)', 'coalesce(rw.q, 0)')}) AS s, sum(c.n / x.n_words) AS p, sum(coalesce(rw.q, 0)) AS q FROM x JOIN c ON c.doc_id = x.doc_id LEFT JOIN rw ON rw.lang = x.ref AND rw.word = c.word GROUP BY x.doc_id),
jw AS (SELECT x.doc_id, sqrt(greatest((coalesce(s, 0) + greatest(rest.q - coalesce(seen.q, 0), 0) + {both('(1 - coalesce(seen.p, 0))', '(1 - rest.q)')}) / 2, 0)) AS d FROM x JOIN rest ON rest.lang = x.ref LEFT JOIN seen ON seen.doc_id = x.doc_id)
SELECT f.doc_id, n_words, size - c_space AS word_chars, c_symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(size >= {MIN_CHARS} AND jc.d > {limit(MAX_CHAR_DISTANCE, CHAR_BINS, '(size - c_space)')}, false)
  AND NOT coalesce(n_words >= {MIN_WORDS} AND jw.d > {limit(MAX_WORD_DISTANCE, WORD_BINS, 'n_words')}, false) AS kept
FROM f LEFT JOIN jc USING (doc_id) LEFT JOIN jw USING (doc_id)
"""


SQL = _sql()
