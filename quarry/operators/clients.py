"""Clients: identifiers, matches in texts and questions, membership, rosters.

Texts and identifiers are compared lower-cased and single-spaced. An identifier
occurs where the characters on both sides are no letters or digits. Instead of
looking for every identifier in every text, a text is cut into runs of as many
words as identifiers have, and these are joined with the identifiers by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.workspace import Workspace, broadcast_if_small

# Words that don't name a client by themselves, and legal forms.
GENERIC = (
    "the and for of ltd llp llc inc pvt private limited corporation corp company co plc gmbh sons group holdings enterprises ventures associates industries "
    "textiles bakery stores store services solutions traders trading foods retail systems technologies tech global india international"
).split()
LEGAL_FORMS = "pvt private ltd limited llp llc inc corp corporation co company".split()
# Fixed values end.
WORD, GAP = r"[\p{L}\p{Nd}]+", r"[^\p{L}\p{Nd}]+"
#: Distinct first words of identifiers that are looked for in texts before runs are made.
FIRST_WORDS = 2000
NONE, SCOPED, CLARIFY = "NONE", "SCOPED", "CLARIFY"


def _core(c: Column) -> Column:
    """Normalised, without outer characters that are no letters or digits."""
    return F.regexp_replace(T.token_norm(c), f"^{GAP}|{GAP}$", "")


def identifiers(clients: DataFrame, least: int = 3) -> DataFrame:
    """(client_id, norm) from (client_id, name) and any further ``aliases`` (an array): the name, its short form, the aliases.

    Identifiers of fewer than ``least`` characters are ignored, repeated ones of a client count once.
    """
    own = F.array(F.col("name"), T.short_company(F.col("name")))
    every = F.concat(own, F.coalesce("aliases", F.array().cast("array<string>"))) if "aliases" in clients.columns else own
    return clients.select("client_id", F.explode(every).alias("x")).select("client_id", _core(F.col("x")).alias("norm")).filter(F.length("norm") >= least).distinct()


def _spots(parts: Column, firsts: list[str] | None) -> Column:
    """Where a run may begin: at each word, or only at words that a key begins with."""
    first = F.when(F.get(parts, F.lit(0)).rlike(f"^{WORD}$"), 1).otherwise(2)
    spots = F.when(first <= F.size(parts), F.sequence(first, F.size(parts), F.lit(2)))
    return spots if firsts is None else F.filter(spots, lambda i: F.get(parts, i - 1).isin(firsts))


def _runs(parts: Column, spots: Column, words: int) -> Column:
    """Distinct runs of so many words from these places, with what stands between them."""
    whole = F.filter(spots, lambda i: i <= F.size(parts) - (2 * words - 2))
    # Element by element: slice() would read the whole array for each run.
    return F.array_distinct(F.transform(whole, lambda i: F.concat(*(F.get(parts, i + k) for k in range(-1, 2 * words - 2)))))


def occurrences(texts: DataFrame, keys: DataFrame, id_col: str, text_col: str, key_col: str) -> DataFrame:
    """Rows (id, all columns of keys), once for each key that occurs in the text as whole words.

    Only the distinct word counts of keys come to the driver, and their distinct first words if these are up to
    FIRST_WORDS: then runs begin at such words only; with more of them, at every word. Null and empty texts have no rows.
    """
    keys = Workspace(texts.sparkSession, "occurrences").stage(keys, "keys")  # read three times below
    sizes = sorted(r["n"] for r in keys.select(F.size(F.regexp_extract_all(key_col, F.lit(f"({WORD})"), F.lit(1))).alias("n")).distinct().collect() if r["n"])
    if not sizes:
        return texts.select(id_col).join(keys, F.lit(False))
    own = keys.select(F.get(F.regexp_extract_all(key_col, F.lit(f"({WORD})"), F.lit(1)), F.lit(0)).alias("w")).filter("w is not null").distinct()
    firsts = [r["w"] for r in own.limit(FIRST_WORDS + 1).collect()]
    # Without a filter on the parts, which would take every text apart twice.
    cut = texts.select(id_col, F.regexp_extract_all(T.token_norm(F.col(text_col)), F.lit(f"({WORD}|{GAP})"), F.lit(1)).alias("parts"))
    cut = cut.select(id_col, "parts", _spots(F.col("parts"), firsts if len(firsts) <= FIRST_WORDS else None).alias("spots"))
    none = F.array().cast("array<string>")
    runs = cut.select(id_col, F.explode(F.concat(*(F.coalesce(_runs(F.col("parts"), F.col("spots"), n), none) for n in sizes))).alias(key_col))
    return runs.join(broadcast_if_small(keys), key_col)


def matches(texts: DataFrame, idents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, client_id) of each client with an identifier in the text."""
    return occurrences(texts, idents, id_col, text_col, "norm").select(id_col, "client_id").distinct()


def membership(files: DataFrame, idents: DataFrame, pinned: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, client_id, state): pinned files keep their client; exactly one match assigns; none or several leave null.

    pinned: (id, client_id). State is pinned, assigned, unmatched or conflicted.
    """
    hits = matches(files, idents, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("n"), F.min("client_id").alias("hit"))
    f = files.select(id_col).join(hits, id_col, "left").join(pinned.select(id_col, F.col("client_id").alias("pin")), id_col, "left")
    state = F.when(F.col("pin").isNotNull(), "pinned").when(F.col("n") == 1, "assigned").when(F.col("n") > 1, "conflicted").otherwise("unmatched")
    return f.select(id_col, F.coalesce("pin", F.when(F.col("n") == 1, F.col("hit"))).alias("client_id"), state.alias("state"))


def name_tokens(idents: DataFrame, least: int = 4) -> DataFrame:
    """(client_id, token, owners): distinctive words of a client's identifiers, and how many clients have each."""
    t = idents.select("client_id", F.explode(F.split("norm", " ")).alias("t")).select("client_id", _core(F.col("t")).alias("token"))
    t = t.filter((F.length("token") >= least) & ~F.col("token").isin(GENERIC)).distinct()
    return t.join(t.groupBy("token").agg(F.count("*").alias("owners")), "token")


def question_matches(questions: DataFrame, idents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, client_id): identifiers and words of one client only; words that clients share where neither is found.

    Texts meet each different identifier or word once, and only what counts for a question is joined with the clients,
    so a word of very many clients costs nothing where the question names one of its own.
    """
    ws = Workspace(questions.sparkSession, "question-matches")
    words = name_tokens(idents).select("client_id", F.col("token").alias("norm"), (F.col("owners") > 1).alias("shared"))
    keys = ws.stage(idents.select("client_id", "norm", F.lit(False).alias("shared")).unionByName(words).distinct(), "named")
    said = occurrences(questions, keys.select("norm", "shared").distinct(), id_col, text_col, "norm").select(id_col, "norm", "shared")
    said = ws.stage(said, "said")
    own, others = said.filter("not shared"), said.filter("shared")
    counts = own.unionByName(others.join(own.select(id_col).distinct(), id_col, "left_anti"))
    return counts.join(keys, ["norm", "shared"]).select(id_col, "client_id").distinct()


def entity_key(name: Column) -> Column:
    """Equal for spellings of one entity: words of two letters or more that are no legal forms; null if none is left."""
    words = F.split(F.regexp_replace(T.token_norm(name), "[^a-z0-9]+", " "), " ")
    return F.nullif(F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(LEGAL_FORMS)), " "), F.lit(""))


def resolve(questions: DataFrame, hits: DataFrame, clients: DataFrame, id_col: str) -> DataFrame:
    """(id, scope, client_id, n_named): one named client scopes, several ask back, unless they are spellings of one entity.

    Spellings of one entity scope to the client of the smallest id. ``questions`` may
    carry ``broaden`` (the question asks to look everywhere) and ``focus`` with
    ``continues`` (the chat's client, kept by a follow-up that names none).
    """
    named = hits.join(clients.select("client_id", entity_key(F.col("name")).alias("key")), "client_id")
    n = named.groupBy(id_col).agg(F.count("*").alias("n"), F.min("client_id").alias("first"), (F.count_if(F.col("key").isNull()) == 0).alias("all_keyed"), F.count_distinct("key").alias("keys"))
    q = questions.select(id_col, *((F.coalesce("broaden", F.lit(False)) if "broaden" in questions.columns else F.lit(False)).alias("broaden"),), (F.when(F.col("continues"), F.col("focus")) if "focus" in questions.columns else F.lit(None).cast(clients.schema["client_id"].dataType)).alias("carried"))
    r = q.join(n, id_col, "left")
    one = (F.col("n") == 1) | (F.col("all_keyed") & (F.col("keys") == 1))
    scope = F.when(F.col("broaden"), NONE).when(one, SCOPED).when(F.col("n") > 1, CLARIFY).when(F.col("carried").isNotNull(), SCOPED).otherwise(NONE)
    r = r.withColumn("scope", scope)
    return r.select(id_col, "scope", F.when(F.col("scope") == SCOPED, F.when(F.col("n") >= 1, F.col("first")).otherwise(F.col("carried"))).alias("client_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_named"))


def roster(clients: DataFrame, idents: DataFrame, assigned: DataFrame, live: DataFrame, id_col: str) -> DataFrame:
    """Per client its identifiers in order, all assigned files, the live ones, and whether it is active (has a live file)."""
    i = idents.groupBy("client_id").agg(F.array_sort(F.collect_set("norm")).alias("identifiers"))
    n = assigned.join(live.select(id_col).distinct().withColumn("alive", F.lit(True)), id_col, "left").groupBy("client_id").agg(F.count("*").alias("files"), F.count("alive").alias("live_files"))
    c = clients.select("client_id", "name").join(i, "client_id", "left").join(n, "client_id", "left")
    zero = F.lit(0).cast("long")
    return c.select("client_id", "name", F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"), F.coalesce("files", zero).alias("files"), F.coalesce("live_files", zero).alias("live_files"), (F.coalesce("live_files", zero) > 0).alias("active"))


def create(clients: DataFrame, idents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clients and identifiers with new clients (client_id, name) added; a client's name and its short form identify it."""
    return clients.unionByName(new.select(clients.columns)), add_identifiers(idents, identifiers(new))


def rename(clients: DataFrame, names: DataFrame) -> DataFrame:
    """names: (client_id, name)."""
    n = names.select("client_id", F.col("name").alias("__name"))
    return clients.join(n, "client_id", "left").select(*(F.coalesce("__name", "name").alias("name") if c == "name" else F.col(c) for c in clients.columns))


def delete(tables: list[DataFrame], gone: DataFrame) -> list[DataFrame]:
    """Every table without the rows of the clients that go (client_id)."""
    return [t.join(broadcast_if_small(gone.select("client_id").distinct()), "client_id", "left_anti") for t in tables]


def add_identifiers(idents: DataFrame, new: DataFrame, least: int = 3) -> DataFrame:
    """Identifiers (client_id, norm) with others added, normalised; short ones and repeated ones are ignored."""
    n = new.select("client_id", _core(F.col("norm")).alias("norm")).filter(F.length("norm") >= least)
    return idents.select("client_id", "norm").unionByName(n).distinct()


def remove_identifiers(idents: DataFrame, gone: DataFrame) -> DataFrame:
    return idents.join(gone.select("client_id", _core(F.col("norm")).alias("norm")), ["client_id", "norm"], "left_anti")
