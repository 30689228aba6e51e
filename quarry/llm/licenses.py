"""License scans by ordered signature rules, in DataFrame functions only.

A text is read as its words (A-Z lower-cased, everything else in ASCII but
letters and digits separates), each with a space on either side, so that
neighbouring matches share nothing. A rule is a row of word patterns written by
hand: a name of a license, or a name within one of the forms in which licenses
are announced. ``?`` after a word makes it optional. Every rule has keywords,
and runs only over texts that contain all of them; texts without any first
keyword aren't looked at again after they have been counted.

Where detections overlap, one that lies within another of higher priority, or
of the same priority and longer (at equal length: the earlier rule), is
suppressed. Base phrases are never suppressed. Detections of a text are rows,
whose places come from running sums, so a text of very many licenses is no long
array.

The score is the weight of the best detection: 1 for an identifier, 0.9 for an
announced name, 0.7 for a full name, 0.4 for a name that may mean other things,
0 for none.

Defined cases: null is empty: no words, no places, empty labels, score 0.
Repeated rows and doc_ids each get a row; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.plans.workspace import Workspace

#: What separates words, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Names, written by hand: label; the keyword besides that of the form; the words. A number says: needs no form, with that priority.
NAMES = (
    ("gpl-1.0", "general", "gnu general public licen[cs]e version? v?1 0?", 3),
    ("gpl-2.0", "general", "gnu general public licen[cs]e version? v?2 0?", 3),
    ("gpl-3.0", "general", "gnu general public licen[cs]e version? v?3 0?", 3),
    ("gpl-2.0-or-later", "general", "gnu general public licen[cs]e version? 2 0? or at? your? option? any? later version?", 4),
    ("gpl-3.0-or-later", "general", "gnu general public licen[cs]e version? 3 0? or at? your? option? any? later version?", 4),
    ("lgpl-2.0", "library", "gnu library general public licen[cs]e version? v?2? 0?", 3),
    ("lgpl-2.1", "lesser", "gnu lesser general public licen[cs]e version? v?2 1", 3),
    ("lgpl-3.0", "lesser", "gnu lesser general public licen[cs]e version? v?3 0?", 3),
    ("lgpl", "lesser", "gnu lesser general public licen[cs]e", 2),
    ("agpl-3.0", "affero", "gnu affero general public licen[cs]e version? v?3 0?", 3),
    ("agpl", "affero", "gnu? affero general public licen[cs]e", 2),
    ("gfdl-1.1", "documentation", "gnu free documentation licen[cs]e version? v?1 1", 3),
    ("gfdl-1.2", "documentation", "gnu free documentation licen[cs]e version? v?1 2", 3),
    ("gfdl-1.3", "documentation", "gnu free documentation licen[cs]e version? v?1 3", 3),
    ("gfdl", "documentation", "gnu free documentation licen[cs]e", 2),
    ("apache-1.0", "apache", "apache (software)? licen[cs]e version? v?1 0", 3),
    ("apache-1.1", "apache", "apache (software)? licen[cs]e version? v?1 1", 3),
    ("apache-2.0", "apache", "apache (software)? licen[cs]e version? v?2 0?", 3),
    ("mit-0", "no attribution", "mit no attribution (licen[cs]e)?", 3),
    ("x11", "x11", "x11 licen[cs]e", 2),
    ("expat", "expat", "expat licen[cs]e", 2),
    ("isc", "isc", "isc licen[cs]e", 2),
    ("bsd-4-clause", "bsd", "(4|four|original|old) clause? bsd licen[cs]e", 3),
    ("bsd-3-clause", "bsd", "(3|three|new|revised|modified) clause? bsd licen[cs]e", 3),
    ("bsd-2-clause", "bsd", "(2|two|simplified|freebsd) clause? bsd licen[cs]e", 3),
    ("0bsd", "clause bsd", "(0|zero) clause bsd (licen[cs]e)?", 3),
    ("bsd", "bsd", "bsd (style)? licen[cs]e", 2),
    ("mpl-1.0", "mozilla", "mozilla public licen[cs]e version? v?1 0", 3),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e version? v?1 1", 3),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e version? v?2 0?", 3),
    ("mpl", "mozilla", "mozilla public licen[cs]e", 2),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e version? v?1 0", 3),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e version? v?2 0", 3),
    ("epl", "eclipse", "eclipse public licen[cs]e", 2),
    ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e version? v?1? 0?", 3),
    ("cddl-1.0", "common", "common development and distribution licen[cs]e version? 1? 0?", 3),
    ("cpl-1.0", "common", "common public licen[cs]e version? 1? 0?", 3),
    ("cpal-1.0", "common", "common public attribution licen[cs]e version? 1? 0?", 3),
    ("eupl-1.1", "european", "european union public licen[cs]e version? v?1 1", 3),
    ("eupl-1.2", "european", "european union public licen[cs]e version? v?1 2", 3),
    ("eupl", "european", "european union public licen[cs]e", 2),
    ("artistic-1.0", "artistic", "artistic licen[cs]e version? 1 0", 3),
    ("artistic-2.0", "artistic", "artistic licen[cs]e version? 2 0", 3),
    ("artistic", "artistic", "artistic licen[cs]e", 2),
    ("bsl-1.0", "boost", "boost software licen[cs]e version? 1? 0?", 3),
    ("busl-1.1", "business", "business source licen[cs]e version? 1? 1?", 3),
    ("zlib", "zlib", "zlib (libpng)? licen[cs]e", 2),
    ("libpng", "libpng", "libpng licen[cs]e", 2),
    ("openssl", "openssl", "openssl licen[cs]e", 2),
    ("php-3.01", "php", "php licen[cs]e version? v?3 0?1?", 3),
    ("psf-2.0", "python", "python software foundation licen[cs]e version? 2?", 3),
    ("python-2.0", "python", "python licen[cs]e version? 2? 0?", 2),
    ("ruby", "ruby", "ruby licen[cs]e", 2),
    ("postgresql", "postgresql", "postgresql licen[cs]e", 2),
    ("unlicense", "unlicense", "the unlicen[cs]e", 2),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e version? 2?", 3),
    ("beerware", "beer", "beer ware licen[cs]e revision? 4?2?", 3),
    ("ofl-1.0", "font", "(sil)? open font licen[cs]e version? 1 0", 3),
    ("ofl-1.1", "font", "(sil)? open font licen[cs]e version? 1 1", 3),
    ("ofl", "font", "(sil)? open font licen[cs]e", 2),
    ("odbl-1.0", "database", "open database licen[cs]e version? v?1? 0?", 3),
    ("odc-by-1.0", "data", "open data commons attribution licen[cs]e v?1? 0?", 3),
    ("pddl-1.0", "data", "open data commons public domain dedication (and|&)? licen[cs]e v?1? 0?", 3),
    ("ogl-uk-3.0", "government", "open government licen[cs]e version? v?3 0?", 3),
    ("ogl-uk", "government", "open government licen[cs]e", 2),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", 2),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", 2),
    ("afl-3.0", "academic", "academic free licen[cs]e version? v?3? 0?", 3),
    ("osl-3.0", "open", "open software licen[cs]e version? v?3 0", 3),
    ("ecl-2.0", "educational", "educational community licen[cs]e version? 2? 0?", 3),
    ("upl-1.0", "universal", "universal permissive licen[cs]e version? v?1? 0?", 3),
    ("ncsa", "illinois", "university of illinois ncsa open source licen[cs]e", 3),
    ("w3c", "w3c", "w3c software (notice)? and? licen[cs]e", 2),
    ("vim", "vim", "vim licen[cs]e", 2),
    ("ijg", "jpeg", "independent jpeg group licen[cs]e", 2),
    ("cc0-1.0", "creative commons", "creative commons (zero|cc0) (universal)? v?1? 0? (universal)? (public domain dedication)?", 3),
    ("public-domain", "public domain", "(released|dedicated|placed) (in|into|to) the public domain", 3),
    ("public-domain", "public domain", "public domain dedication", 2),
    ("openrail", "open rail", "creative ml open rail (m)? licen[cs]e?", 3),
    ("llama2", "llama", "llama 2 community licen[cs]e (agreement)?", 3),
    ("proprietary", "rights reserved", "all rights reserved", 1),
    ("proprietary", "and confidential", "proprietary and confidential", 2),
)
#: Short identifiers, as after a tag or the words of a form: label, words.
IDENTIFIERS = (
    ("gpl-1.0", "gpl 1 0 (only)?"), ("gpl-2.0", "gpl 2 0 (only)?"), ("gpl-3.0", "gpl 3 0 (only)?"), ("gpl-2.0-or-later", "gpl 2 0 or later"), ("gpl-3.0-or-later", "gpl 3 0 or later"),
    ("gpl-2.0", "gplv2"), ("gpl-3.0", "gplv3"), ("lgpl-2.1", "lgpl 2 1 (only)?"), ("lgpl-2.1-or-later", "lgpl 2 1 or later"), ("lgpl-3.0", "lgpl 3 0 (only)?"), ("lgpl-3.0-or-later", "lgpl 3 0 or later"),
    ("lgpl-2.1", "lgplv2 1"), ("lgpl-3.0", "lgplv3"), ("agpl-3.0", "agpl 3 0 (only)?"), ("agpl-3.0-or-later", "agpl 3 0 or later"), ("agpl-3.0", "agplv3"), ("apache-2.0", "apache 2 0"), ("apache-1.1", "apache 1 1"),
    ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("0bsd", "0bsd"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"),
    ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"), ("eupl-1.2", "eupl 1 2"), ("artistic-2.0", "artistic 2 0"), ("bsl-1.0", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("zlib", "zlib"),
    ("ofl-1.1", "ofl 1 1"), ("odbl-1.0", "odbl 1 0"), ("cc0-1.0", "cc0 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("psf-2.0", "psf 2 0"), ("ms-pl", "ms pl"), ("upl-1.0", "upl 1 0"), ("ncsa", "ncsa"), ("postgresql", "postgresql"),
)
#: Forms in which a license is announced, around an identifier: keyword, words before, words after, priority.
FORMS = (
    ("spdx", "spdx licen[cs]e identifier", "", 4),
    ("licen", "(is|are)? (licen[cs]ed|released|distributed|published|available|provided) under (the)? (terms)? (of)? (the)?", "(licen[cs]e)?", 3),
    ("licen", "licen[cs]e", "", 3),
    ("licen", "licen[cs]e|licen[cs]es", "licen[cs]e", 3),
    ("licen", "", "licen[cs]e|licen[cs]ed", 2),
)
CC_PARTS = (("by", "by", "attribution"), ("by-sa", "by sa", "attribution share? alike|sharealike"), ("by-nd", "by nd", "attribution no? derivatives|noderivatives|noderivs"), ("by-nc", "by nc", "attribution non? commercial|noncommercial"), ("by-nc-sa", "by nc sa", "attribution non? commercial|noncommercial share? alike|sharealike"), ("by-nc-nd", "by nc nd", "attribution non? commercial|noncommercial no? derivatives|noderivatives|noderivs"))
CC_VERSIONS = (("1.0", "1 0"), ("2.0", "2 0"), ("2.5", "2 5"), ("3.0", "3 0"), ("4.0", "4 0"))
WEIGHTS = {5: 1.0, 4: 1.0, 3: 0.9, 2: 0.7, 1: 0.4}
PRIORITIES = sorted(set(WEIGHTS) - {5})


def pattern(words: str) -> str:
    """The regular expression of a rule's words over spaced words; ``?`` at a word's end: may be absent."""
    out = []
    for group in _groups(words):
        optional = group.endswith("?")
        body = group[:-1] if optional else group
        parts = body[1:-1].split(" ") if body.startswith("(") and " " in body else [body]
        one = "".join(f" (?:{p[1:-1] if p.startswith('(') else p}) " for p in parts)
        out.append(f"(?:{one})?" if optional else one)
    return "".join(out)


def _groups(words: str) -> list[str]:
    """Words, where a bracketed run of words is one."""
    out, depth, cur = [], 0, ""
    for c in words + " ":
        depth += (c == "(") - (c == ")")
        if c == " " and not depth:
            out += [cur] if cur else []
            cur = ""
        else:
            cur += c
    return out


def rules() -> list[tuple[int, str, list[str], str, int, bool]]:
    """(number, label, keywords, pattern, priority, base) of every rule, in order."""
    word = lambda w: "".join(f" {x} " for x in w.split(" "))  # noqa: E731  as it stands in spaced words
    out = [(label, [word(words)] if label == "cc-by" else ["licen", word(words.split()[0])], words, 5, True) for words, label in BASE]
    for label, key, words, priority in NAMES:
        needs = re.search(r"licen\S*(?<![?)])( |$)", words)
        out.append((label, ["licen", word(key)] if needs else [word(key)], words, priority, False))
    for label, words in IDENTIFIERS:
        key = word(words.split()[0])
        for form, before, after, priority in FORMS:
            if label in ("mit", "isc") and not before:
                continue  # a base phrase or a name above
            out.append((label, [form, key], f"{before} {words} {after}".strip(), priority, False))
    for part, short, long in CC_PARTS:
        for version, digits in CC_VERSIONS:
            out.append((f"cc-{part}-{version}", [word("cc by")], f"cc {short} v?{digits}", 4, False))
            out.append((f"cc-{part}-{version}", [word("creative commons")], f"creative commons {long} v?{digits}", 4, False))
        out.append((f"cc-{part}", [word("cc by")], f"cc {short}", 3, False))
        out.append((f"cc-{part}", [word("creative commons")], f"creative commons {long}", 3, False))
    return [(i, label, keys, pattern(words), priority, base) for i, (label, keys, words, priority, base) in enumerate(out)]


RULES = rules()
#: Every text that a rule can match has the rule's keywords; these are the first ones.
FIRST = sorted({keys[0] for _, _, keys, _, _, _ in RULES})


def spaced(text: str | Column = "text") -> Column:
    """The words of a text, each with a space on either side; no words: nothing."""
    s = F.trim(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BETWEEN, "  "))
    return F.when(s == "", "").otherwise(F.concat(F.lit(" "), s, F.lit(" ")))


def word_count(s: Column) -> Column:
    """Of spaced words: half their spaces."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("int")


def _rule_rows() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("rule"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(rx).alias("rx")) for i, _, keys, rx, _, _ in RULES))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with n_words and ``found``: for each rule that matches, the words before and in each of its matches."""
    d = docs.drop("n_words", "found", "row").withColumn("_spaced", spaced(F.col(text_col).cast("string"))).withColumn("n_words", word_count(F.col("_spaced")).cast("long"))
    d = d.withColumn("_low", F.lower("_spaced"))
    gate = F.lit(False)
    for key in FIRST:
        gate = gate | F.col("_low").contains(key)
    d = d.withColumn("_read", F.when(gate, F.translate("_spaced", UPPER, LOWER))).drop("_low")
    keyed = F.filter(_rule_rows(), lambda r: F.forall(r["keys"], lambda k: F.col("_read").contains(k)))
    count = lambda x: F.transform(x, word_count)
    hit = F.transform(keyed, lambda r: F.struct(r["rule"].alias("rule"), count(F.split(F.col("_read"), r["rx"], -1)).alias("gaps"), count(F.regexp_extract_all(F.col("_read"), r["rx"], F.lit(0))).alias("lens")))
    found = F.filter(hit, lambda x: F.size(x["lens"]) > 0)
    return d.withColumn("found", F.when(F.col("_read").isNotNull(), found)).drop("_spaced", "_read")


def spans(scanned: DataFrame, key: str) -> DataFrame:
    """(key, rule, first, last) in words, last included, of every match."""
    each = scanned.filter(F.size("found") > 0).select(key, F.inline("found"))
    # One gap more than matches: what follows the last.
    each = each.select(key, "rule", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("lens")).alias("gaps"), "lens"))).select(key, "rule", "pos", "col.gaps", "col.lens")
    before = W.partitionBy(key, "rule").orderBy("pos")
    end = F.sum(F.col("gaps") + F.col("lens")).over(before)
    return each.select(key, "rule", (end - F.col("lens")).alias("first"), (end - 1).alias("last"))


def detections(spark: SparkSession, found: DataFrame, key: str) -> DataFrame:
    """(key, rule, label, priority, base, first, last, kept) of every match of a scan; kept: not suppressed."""
    table = spark.createDataFrame([(i, label, p, base) for i, label, _, _, p, base in RULES], "rule int, label string, priority int, base boolean")
    d = found.join(F.broadcast(table), "rule")  # a fixed number of rules
    # What begins no later comes first, and of equal beginnings the longer, the higher, the earlier rule.
    before = W.partitionBy(key).orderBy("first", F.desc("last"), F.desc("priority"), "rule").rowsBetween(W.unboundedPreceding, -1)
    within = F.lit(False)
    for p in PRIORITIES:
        reach = F.max(F.when(F.col("priority") >= p, F.col("last"))).over(before)
        within = within | ((F.col("priority") == p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    return d.withColumn("kept", F.col("base") | ~within)


def license_scan(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged rows of the documents without their texts, with ``row`` as their key and n_words, and the detections of those rows."""
    ws = Workspace(spark, "licenses")
    rows = ws.stage(scan(docs, text_col).drop(text_col).withColumn("row", F.monotonically_increasing_id()), "scanned")
    return rows.drop("found"), detections(spark, spans(rows, "row"), "row")


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row of labels, places and score for each document."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  at most a label per rule
    base = lambda x: F.when(F.col("base"), x)
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("priority"))
    per = found.filter("kept").groupBy("row").agg(
        F.count(base(F.lit(1))).alias("n_base"), F.min(base(F.col("first"))).alias("first_word"), F.max(base(F.col("first"))).alias("last_word"), joined(base(F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max(weight).alias("score")
    )
    d = rows.select("row", "doc_id", "n_words").join(per, "row", "left")
    return d.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return summary(*license_scan(spark, docs))


def _sql() -> str:
    """The same rows in DuckDB, with suppression by comparing all pairs of a document's detections."""
    values = ", ".join(f"({i}, '{label}', {keys!r}, '{rx}', {p}, {str(base).lower()}, {WEIGHTS[p]})" for i, label, keys, rx, p, base in RULES)
    n = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    return rf"""
WITH r AS (SELECT * FROM (VALUES {values}) AS r(rule, label, keys, rx, priority, base, weight)),
d AS (SELECT row_number() OVER () AS row, doc_id, trim(regexp_replace(coalesce(text, ''), '{BETWEEN}', '  ', 'g'), ' ') AS s FROM documents),
w AS (SELECT row, doc_id, CASE WHEN s = '' THEN '' ELSE ' ' || translate(s, '{UPPER}', '{LOWER}') || ' ' END AS s FROM d),
m AS (SELECT row, rule, regexp_extract_all(s, rx) AS hit, string_split_regex(s, rx) AS gap FROM w JOIN r ON len(list_filter(keys, lambda k: NOT contains(s, k))) = 0 AND regexp_matches(s, rx)),
e AS (SELECT row, rule, unnest(range(1, len(hit) + 1)) AS pos, unnest(hit) AS hit, unnest(gap[1:len(hit)]) AS gap FROM m),
p AS (SELECT row, rule, {n('hit')} AS len, sum({n('gap')} + {n('hit')}) OVER (PARTITION BY row, rule ORDER BY pos) AS stop FROM e),
f AS (SELECT row, rule, label, priority, base, weight, stop - len AS a, stop - 1 AS z FROM p JOIN r USING (rule)),
k AS (SELECT * FROM f WHERE base OR NOT EXISTS (SELECT 1 FROM f g WHERE g.row = f.row AND g.a <= f.a AND g.z >= f.z AND (g.priority > f.priority OR (g.priority = f.priority AND (g.z - g.a > f.z - f.a OR (g.z - g.a = f.z - f.a AND g.rule < f.rule)))))),
s AS (SELECT row, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score FROM k GROUP BY row)
SELECT doc_id, CAST({n('s')} AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN s USING (row)
"""


SQL = _sql()
