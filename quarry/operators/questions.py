"""What a question asks for: its shape, the files it names, and whose documents it means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators.injection import KIND_WORDS, kinds, name_stems, stemmed
from quarry.plans.workspace import Workspace, broadcast_if_small

# Words and phrases by which a question is told.
PRONOUNS = r"\b(it|its|it's|they|them|their|theirs|he|him|his|she|her|hers|same)\b"
OPENERS = ["and ", "also ", "then ", "what about", "how about", "what if", "and the", "and its", "and their", "plus "]
GENERAL = [
    "in general", "across all", "all clients", "all my clients", "all of my clients", "every client", "any client", "all my files", "all my documents",
    "all of my files", "all of my documents", "across my files", "across my documents", "answer generally", "in general terms",
]
EXCLUDING = [
    "don't answer about", "dont answer about", "do not answer about", "forget about", "regardless of client", "regardless of the client", "regardless of whose",
    "not just this client", "not just that client", "no matter the client", "any client",
]
RELATIVES = r"\b(son|sons|daughter|daughters|wife|wives|husband|spouse|father|mother|child|children|kid|kids|brother|sister|sibling|siblings|nephew|niece|grandson|granddaughter|family|in-law|in-laws)\b"
ACTION = r"\b(overdue|chase|follow\s*up|respond|response|reply|notices?|renew\w*|expir\w*|urgent|action\s+items?|remind\w*|upcoming|need(?:s)?\s+(?:my\s+)?attention)\b"
PER_ITEM = r"\b(by\s+when|when\b|due\s+(?:by|date|on)|deadline|respond|response|reply|how\s+much|amounts?\b|expir\w+|renew\w+)"
COLLECTION = [
    "my files", "my documents", "my docs", "my collection", "my paperwork", "all my files", "all my documents", "all my docs", "across my files", "in my files",
    "from my files", "of my files", "in my documents", "everything i have", "all of my files", "all of my documents",
]
OVERVIEW = [
    "important", "overview", "summar", "highlight", "key thing", "key point", "main thing", "what's in", "whats in", "what is in", "rundown", "gist",
    "big picture", "tldr", "tl;dr", "at a glance", "what do i have", "what should i know", "what's there", "whats there",
]
SMALL_TALK = {
    "greeting": "hi, hii, hiii, hello, helo, hey, heya, hiya, yo, sup, wassup, whatsup, howdy, hola, namaste, good morning, good afternoon, good evening, good night, morning, evening, greetings",
    "thanks": "thanks, thank you, thx, ty, thank u, thankyou, thanks a lot, thanks!, many thanks",
    "farewell": "bye, goodbye, good bye, see you, see ya, cya, later, ttyl, take care",
}
SUBJECT_FILLER = (
    "return filing slip card letter order note deed policy gstr itr form record paper sales purchase monthly quarterly yearly annual own pending recent client fee week month year today last next "
    "january february march april june july august september october november december"
).split()
PATH = r"(/[^\s\n]+\.[A-Za-z0-9]{1,8})"
FILE_NAME = r"(\w[\w()\-]*\.[A-Za-z0-9]{1,8})"
# Fixed values end.
#: Files times questions of one task, where files meet questions.
SPREAD = 50_000_000


def _spaced(q: Column) -> Column:
    """Lower-cased and single-spaced, a blank on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), r"\s+", " ")), F.lit(" "))


def _says(q: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(_spaced(q), p))


def _matches(q: Column, pattern: str) -> Column:
    return F.coalesce(F.lower(q).rlike(pattern), F.lit(False))


def is_continuation(q: Column) -> Column:
    """A pronoun that refers back, or an elliptical opener."""
    plain = F.trim(_spaced(q))
    return _matches(q, PRONOUNS) | F.exists(F.array(*map(F.lit, OPENERS)), lambda o: F.startswith(plain, o))


def wants_general(q: Column) -> Column:
    return _says(q, GENERAL)


def excludes_client(q: Column) -> Column:
    return _says(q, EXCLUDING)


def mentions_relative(q: Column) -> Column:
    return _matches(q, RELATIVES)


def broadens(q: Column, named: Column) -> Column:
    """Whether a question is about everything: always if it excludes a client or asks for a relative, else if it says so and names none."""
    return excludes_client(q) | mentions_relative(q) | (wants_general(q) & ~named)


def is_action(q: Column) -> Column:
    return _matches(q, ACTION)


def asks_per_item(q: Column) -> Column:
    return _matches(q, PER_ITEM)


def is_overview(q: Column) -> Column:
    """Both the whole collection and an overview of it are meant."""
    return _says(q, COLLECTION) & _says(q, OVERVIEW)


def small_talk(q: Column) -> Column:
    """greeting, thanks or farewell, if that is all; else null."""
    plain = F.trim(F.regexp_replace(F.lower(q), r"\p{Punct}+$", ""))
    kind = None
    for name, words in SMALL_TALK.items():
        kind = (F.when if kind is None else kind.when)(plain.isin(words.split(", ")), name)
    return kind


def qualifiers(subject: Column) -> Column:
    """Stems of a subject that tell whose documents are meant: no kinds, no filler."""
    return F.array_except(stemmed(F.coalesce(subject, F.lit(""))), F.array(*map(F.lit, [*KIND_WORDS, *SUBJECT_FILLER])))


def has_qualifier(name: Column, entity: Column, quals: Column) -> Column:
    """Whether the file's name or its owner has any of the qualifiers; true if there are none."""
    return (F.size(quals) == 0) | F.arrays_overlap(F.array_union(name_stems(name), stemmed(F.coalesce(entity, F.lit("")))), quals)


def inventory_filter(matched: DataFrame, subject_col: str, question_col: str, name_col: str, entity_col: str, date_col: str) -> DataFrame:
    """Of the files that were matched to a question, those of its subject's owner and of the period that it names.

    A question without qualifiers or period keeps all; a file without a date is in no period.
    """
    period = D.asked_period(F.col(question_col))
    dated = period.isNull() | D.in_period(F.coalesce(date_col, F.lit("")), period["year"], period["month"])
    return matched.filter(has_qualifier(F.col(name_col), F.col(entity_col), qualifiers(F.col(subject_col))) & dated)


def complete_inventory(questions: DataFrame, matched: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, file, added): the files that were matched to questions, filtered, and those that the matching left out.

    questions: query_id, question, subject. matched: query_id, file. files: file, file_name, entity, doc_type, date.

    Matched files of another owner than the subject's go; a question that keeps none gets nothing. If it names a period,
    files out of it go, and every other file of it is added that is of a kind and an owner asked for. Without a period,
    the name stems that all of its (two or more) files share are looked for in all other names, a containment join: a
    file holds all of them only if it holds the rarest, so files meet questions by that one token, and the rest is
    checked there. Templates are never added, superseded names not by their stems.

    The rows found may be as many as files times questions, so no aggregation or shuffle sees them: a file brings along
    the questions that it was matched to, which tells what is added. Only files that share an id are put together after.
    """
    ws = Workspace(questions.sparkSession, "inventory")
    period = D.asked_period(F.col("question"))
    asked = questions.select("query_id", qualifiers(F.col("subject")).alias("quals"), kinds(stemmed(F.coalesce("question", F.lit("")))).alias("wanted"), period.alias("period"))
    asked = ws.stage(asked, "asked")
    name = F.coalesce("file_name", F.lit(""))
    iso = F.coalesce(F.col("date").cast("string"), F.lit(""))
    f = files.select(
        "file", name_stems(name).alias("stems"), F.array_union(name_stems(name), stemmed(F.coalesce("entity", F.lit("")))).alias("own"), F.col("doc_type"),
        F.substr(iso, F.lit(1), F.lit(4)).try_cast("int").alias("y"), F.substr(iso, F.lit(6), F.lit(2)).try_cast("int").alias("m"), name.rlike(T.TEMPLATE_NAME).alias("template"), name.rlike(T.SUPERSEDED_NAME).alias("superseded"),
    )
    theirs = (F.size("quals") == 0) | F.arrays_overlap("own", "quals")
    picks = matched.filter("query_id is not null").groupBy("file").agg(F.collect_set("query_id").alias("picked"))  # questions of one file
    f = ws.stage(f.join(picks, "file", "left").withColumn("many", F.count("*").over(W.partitionBy("file")) > 1), "files")
    kept = f.select("file", "many", "stems", "own", "y", "m", F.explode("picked").alias("query_id")).join(broadcast_if_small(asked), "query_id").filter(theirs)
    kept = ws.stage(kept.select("query_id", "file", "many", "stems", "y", "m", "period"), "kept")
    f = f.repartition(max(1, -(-f.count() * asked.count() // SPREAD)), "file")
    live = broadcast_if_small(ws.stage(asked.join(kept.select("query_id").distinct(), "query_id", "left_semi"), "live"))

    # Periods: a file is in a month, in its year, and in that month of any year.
    y, m = F.col("period")["year"], F.col("period")["month"]
    inside = kept.filter(F.col("period").isNotNull() & F.coalesce(((y == 0) | (y == F.col("y"))) & ((m == 0) | (m == F.col("m"))), F.lit(False)))
    keys = F.array_distinct(F.array(*(F.struct(a.alias("py"), b.alias("pm")) for a, b in ((F.col("y"), F.col("m")), (F.col("y"), F.lit(0)), (F.lit(0), F.col("m"))))))
    dated = f.filter("y is not null and m is not null and not template").select("file", "many", "picked", "stems", "own", "doc_type", F.inline(keys))
    of_kind = (F.size("wanted") == 0) | F.coalesce(F.array_contains("wanted", F.col("doc_type")), F.lit(False)) | F.arrays_overlap(kinds(F.col("stems")), "wanted")
    periods = live.filter("period is not null").withColumn("py", y).withColumn("pm", m)
    more = dated.join(periods, ["py", "pm"]).filter(of_kind & theirs)

    # Shared stems: those that as many files have as were kept.
    open_ = kept.filter("period is null")
    n = open_.groupBy("query_id").agg(F.count("*").alias("n")).filter("n >= 2")
    # Only stems of one of a question's files can be shared, so only these are counted.
    one = broadcast_if_small(ws.stage(open_.groupBy("query_id").agg(F.min("file").alias("file")), "one"))
    one = ws.stage(open_.join(one, ["query_id", "file"]).groupBy("query_id").agg(F.first("stems").alias("first_stems")), "first")
    both = F.explode(F.array_intersect("first_stems", "stems"))
    shared = open_.join(broadcast_if_small(one), "query_id").select("query_id", both.alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("n"))
    shared = ws.stage(shared.join(n, ["query_id", "n"]).select("query_id", "token"), "shared")
    index = f.filter("not template and not superseded").select("file", "many", "picked", "stems", "own", F.explode("stems").alias("token"))
    wanted = broadcast_if_small(ws.stage(shared.select("token").distinct(), "tokens"))
    often = index.join(wanted, "token").groupBy("token").agg(F.count("*").alias("often"))
    rare = shared.join(often, "token", "left").groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"), F.collect_set("token").alias("all_of"))  # tokens of one name
    rare = broadcast_if_small(ws.stage(rare.join(asked.select("query_id", "quals"), "query_id"), "rarest"))
    siblings = index.join(rare, "token").filter((F.size(F.array_except("all_of", "stems")) == 0) & theirs)

    found = inside.unionByName(open_).select("query_id", "file", "many", F.lit(False).alias("added"))
    new = F.col("many") | F.col("picked").isNull() | ~F.array_contains("picked", F.col("query_id"))
    for extra in (more, siblings):
        found = found.union(extra.filter(new).select("query_id", "file", "many", F.lit(True)))
    together = found.filter("many").groupBy("query_id", "file").agg(F.bool_and("added").alias("added"))
    return found.filter("not many").select("query_id", "file", "added").union(together)


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,;:)\]]+$", "")


def file_scope(questions: DataFrame, files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, path) of the one file that a question names: by its path, by a file name, or by a name without extension.

    A name counts only where one file has it. files: path, file_name, those in scope. Everything is an equality join of
    what the questions say with keys of the files.
    """
    ws = Workspace(questions.sparkSession, "file-scope")
    q = F.coalesce(F.col(text_col), F.lit(""))
    found = lambda pattern: F.transform(F.regexp_extract_all(q, F.lit(pattern), F.lit(1)), _stripped)
    words = F.filter(F.split(F.lower(q), "[^a-z0-9]+"), lambda t: (F.length(t) >= 4) & ~t.isin(T.STOPWORDS))
    said = None
    for form, keys in enumerate((found(PATH), found(FILE_NAME), words)):
        part = questions.select(id_col, F.lit(form).alias("form"), F.posexplode(keys).alias("at", "key"))
        said = part if said is None else said.unionByName(part)
    stem = F.trim(F.lower(F.when(F.locate(".", "file_name") > 1, F.regexp_extract("file_name", r"(?s)^(.*)\.[^.]*$", 1)).otherwise(F.col("file_name"))))
    keyed = [files.select(F.lit(form).alias("form"), key.alias("key"), "path") for form, key in enumerate((F.col("path"), F.col("file_name"), stem))]
    names = keyed[0].union(keyed[1]).union(keyed[2])
    hits = names.join(broadcast_if_small(ws.stage(said.filter("key <> ''"), "said")), ["form", "key"])
    one = hits.groupBy(id_col, "form", "at", "key").agg(F.min("path").alias("path"), F.max("path").alias("other")).filter("path = other")
    return one.groupBy(id_col).agg(F.min_by("path", F.struct("form", "at")).alias("path"))


def paths_by_name(files: DataFrame, names: DataFrame) -> DataFrame:
    """(file_name, path), distinct, of exactly these names."""
    return files.join(broadcast_if_small(names.select("file_name").distinct()), "file_name", "left_semi").select("file_name", "path").distinct()


def mentions_files(questions: DataFrame, files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of the questions that share a significant token with the name of any file."""
    ws = Workspace(questions.sparkSession, "mentions")
    asked = ws.stage(questions.select(id_col, F.explode(T.significant_tokens(F.col(text_col))).alias("token")), "asked")
    vocabulary = files.select(F.explode(T.significant_tokens(T.split_camel(F.col("file_name")))).alias("token")).distinct()
    return vocabulary.join(broadcast_if_small(asked), "token").select(id_col).distinct()


def merge_context(*blocks: Column) -> Column:
    """The blocks that there are, a line break between them; null if there is none."""
    return F.nullif(F.concat_ws("\n", *blocks), F.lit(""))


def common_name_tokens(matched: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(id, token): the stems of significant tokens that the names of all files matched to a question have."""
    t = matched.select(id_col, F.explode(name_stems(F.col(name_col))).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))
    return t.join(matched.groupBy(id_col).agg(F.count("*").alias("n")), [id_col, "n"]).select(id_col, "token")


def compatible_files(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(file, folder): files of which a folder has another of the same family of extensions, or of the same extension outside of the families."""
    kinds = folders.select("folder", T.family_key(F.col("file_name")).alias("family")).distinct()
    return files.select("file", T.family_key(F.col("file_name")).alias("family")).join(kinds, "family").select("file", "folder")


def compound(parts: DataFrame, most: int = 4) -> DataFrame:
    """(id, parts, answer, sources) of messages that ask for several things: each part's answer in turn, each source once.

    parts: (id, whole, n, part, answer, sources), the answers being those of the usual way. Blank parts, repeated ones and
    the message itself are no parts; with fewer than two left a message isn't compound and has no row, nor has one of which
    no part was answered. At most ``most`` parts are answered, the first ones.
    """
    p = parts.withColumn("part", T.strip(F.coalesce("part", F.lit("")))).filter("part <> ''").filter(F.lower("part") != F.lower(T.strip(F.coalesce("whole", F.lit("")))))
    first = F.min_by(F.struct("answer", "sources"), F.struct("n", "answer"))
    p = p.groupBy("id", "part").agg(F.min("n").alias("n"), first.alias("a"))
    p = p.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("n", "part"))).filter(F.col("r") <= most)
    rows = p.groupBy("id").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list(F.struct("r", "a"))).alias("all")).filter("parts >= 2")
    told = F.filter("all", lambda x: T.strip(F.coalesce(x["a"]["answer"], F.lit(""))) != "")
    rows = rows.withColumn("told", told).filter(F.size("told") > 0)
    sources = F.flatten(F.transform("told", lambda x: F.coalesce(x["a"]["sources"], F.array().cast("array<string>"))))
    return rows.select("id", "parts", F.array_join(F.transform("told", lambda x: x["a"]["answer"]), "\n\n").alias("answer"), F.array_distinct(sources).alias("sources"))
