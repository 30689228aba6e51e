"""Text expressions: tokens, cleaning, names, snippets.

Lengths count code points. Every function takes and returns Columns and stays
within the JVM's built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell files apart.
STOPWORDS = (
    "document documents copy final draft scan scanned file files untitled image screenshot test amount total detail details info information thing things "
    "bill bills payment payments fees paid unpaid balance account accounts cost price charge charges "
    "what when where which whom whose there here your yours mine have with from into about this that these those them they their then than "
    "will would could should shall please want need does done tell show give gave find list more most much many like also just only very some such each every over under between both"
).split()
DOC_TYPE_WORDS = "invoice invoices statement statements receipt receipts bill bills notice notices letter form return returns agreement lease contract report summary document scan final copy note record records file docs".split()
LEGAL_SUFFIXES = "private pvt limited ltd llp llc inc incorporated corporation corp company co plc gmbh sons".split()
COMPANY_WORDS = "llc inc llp ltd co corp corporation company group the".split()
NULLISH = ["null", "none", "n/a", "na", "not found", "not stated"]
TEMPLATE_WORDS = "template templates sample samples example examples boilerplate placeholder demo blank".split()
TEMPLATE_NAME = r"(?i)(?:^|[^a-z0-9])(template|sample|example|boilerplate|placeholder|lorem|starter|demo|blank|_default)(?:[^a-z0-9]|$)"
SUPERSEDED_NAME = r"(?i)(?:^|[^a-z0-9])(draft|superseded|obsolete|old|backup|previous|prev|copy|v[0-9]+)(?:[^a-z0-9]|$)"
LEDGER_NAME = r"(?i)(tracker|ledger|outstanding|receivable|arrears|dues|statement[ _-]?of[ _-]?account|fees?[ _-]?(status|due|outstanding|pending))"
PAYMENT_STATUS = r"(?i)\b(unpaid|paid|pending|outstanding|overdue|owe[ds]?|owing|settled|cleared|due|dues|receivable|payable|arrears|balance)\b"
ENTITY_BREADTH = r"(?i)\b(all the|all of|same|different|distinct|separate|apart|each|every|how many|list|which|compare|both|versus|vs)\b"
EXTENSION_FAMILIES = {
    "document": "pdf docx doc rtf odt txt md pages epub tex",
    "image": "jpg jpeg png gif heic heif webp tiff tif svg bmp ico raw cr2 nef",
    "video": "mp4 mov mkv avi webm m4v flv wmv mpg mpeg",
    "audio": "mp3 wav flac m4a ogg aac wma opus",
    "archive": "zip tar gz tgz 7z rar bz2 xz iso dmg",
    "code": "js ts jsx tsx py java go rb rs c cpp cc h hpp sh json yaml yml xml kt swift scala php lua r",
    "sheet": "xls xlsx csv numbers tsv ods",
    "slides": "ppt pptx key odp",
}
# Fixed values end.


def split_camel(c: Column) -> Column:
    """Blanks between lower and upper case, and between letters and digits."""
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    c = F.regexp_replace(c, "([A-Za-z])([0-9])", "$1 $2")
    return F.regexp_replace(c, "([0-9])([A-Za-z])", "$1 $2")


def overlap_tokens(c: Column) -> Column:
    """Distinct runs of four or more letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]{4,})"), F.lit(1)))


def significant_tokens(c: Column) -> Column:
    """Tokens that tell something apart: with a letter, no stopword; identifiers of letters and digits stay whole."""
    low = F.lower(F.coalesce(c, F.lit("")))
    parts = F.regexp_extract_all(split_camel(low), F.lit("([a-z0-9]{4,})"), F.lit(1))
    whole = F.regexp_extract_all(low, F.lit("([a-z0-9]{4,})"), F.lit(1))
    stop = lambda t: t.isin(STOPWORDS)
    a = F.filter(parts, lambda t: t.rlike("[a-z]") & ~stop(t))
    b = F.filter(whole, lambda t: t.rlike("[a-z]") & t.rlike("[0-9]") & ~stop(t))
    return F.array_union(a, b)


def stem(t: Column) -> Column:
    """Without one final s, for tokens of five letters or more that don't end in ss."""
    return F.when((F.length(t) >= 5) & t.endswith("s") & ~t.endswith("ss"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def stems(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, stem))


def clean_text(c: Column) -> Column:
    """Line ends as \\n, no control characters but tab and newline, at most one blank line, no runs of three blanks."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, " {3,}", " ")
    return F.regexp_replace(c, r"^[ \t\n]+|[ \t\n]+$", "")


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; empty without one, if nothing follows or if nothing comes before."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def extension_family(name: Column) -> Column:
    ext = extension(name)
    out = F.when(F.lit(False), "")
    for family, members in EXTENSION_FAMILIES.items():
        out = out.when(ext.isin(members.split()), family)
    return out.otherwise("other")


def family_key(name: Column) -> Column:
    """Files are compatible if their keys are equal: the family, or the very extension outside of the families."""
    family = extension_family(name)
    return F.when(family == "other", F.concat(F.lit("."), extension(name))).otherwise(family)


def strip(c: Column) -> Column:
    """Without control characters and blanks at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def token_norm(c: Column) -> Column:
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def name_norm(c: Column) -> Column:
    """A party's name for comparison: no dots, commas or company words."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[.,]", " ")
    return squeeze(F.regexp_replace(c, r"\b(" + "|".join(COMPANY_WORDS) + r")\b", " "))


def short_company(c: Column) -> Column:
    """The name without trailing legal suffixes; null if there is none to take off."""
    words = F.split(squeeze(c), " ")
    is_legal = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "").isin(LEGAL_SUFFIXES)
    # Walk from the end: the first word always stays.
    n = F.size(words)
    state = F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), n, lambda end, i: F.when((end == i) & (i > 1) & is_legal(F.get(words, i - 1)), i - 1).otherwise(end))
    return F.when(state < n, F.array_join(F.slice(words, 1, state), " "))


def snippet(c: Column, size: int = 320) -> Column:
    c = F.trim(c)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substr(c, F.lit(1), F.lit(size)), F.lit("…")))


def snippet_around(text_col: str, word: str, before: int = 40, after: int = 70, head: int = 120) -> Column:
    c = F.col(text_col)
    at = F.locate(word.lower(), F.lower(c))
    first = F.greatest(at - before, F.lit(1))
    last = F.least(at + len(word) - 1 + after, F.length(c))
    mid = F.concat(F.when(first > 1, F.lit("…")).otherwise(F.lit("")), F.substr(c, first, last - first + 1), F.when(last < F.length(c), F.lit("…")).otherwise(F.lit("")))
    return F.when(at > 0, mid).otherwise(F.when(F.length(c) > head, F.concat(F.substr(c, F.lit(1), F.lit(head)), F.lit("…"))).otherwise(c))


def title(c: Column, size: int = 60) -> Column:
    """A thread's title: one line, cut with an ellipsis."""
    c = squeeze(c)
    return F.when(F.length(c) > size, F.concat(F.trim(F.substr(c, F.lit(1), F.lit(size))), F.lit("…"))).otherwise(c)


def safe_label(c: Column) -> Column:
    """A label that can't forge lines, fences or tags in a prompt."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F\x{2028}\x{2029}]", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[=`]{2,}", "="), "[<>]", " "))
    return F.when(s == "", "unknown").when(F.length(s) > 200, F.concat(F.substr(s, F.lit(1), F.lit(200)), F.lit("…"))).otherwise(s)


def safe_preview(c: Column, size: int) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F\x{2028}\x{2029}]", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[=`]{3,}", "="), " {2,}", " "))
    return F.when(F.length(s) > size, F.concat(F.substr(s, F.lit(1), F.lit(size)), F.lit("…"))).otherwise(s)


def folder_name(c: Column) -> Column:
    """A folder's name without control characters, blanks for illegal ones, squeezed, without dots at the end, 60 characters at most."""
    s = squeeze(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F]", ""), r'[\\/:*?"<>|]', " "))
    return F.trim(F.substr(F.regexp_replace(s, r"[. ]+$", ""), F.lit(1), F.lit(60)))


def folder_hint(path: Column) -> Column:
    """The last three folders of a path."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.slice(dirs, F.greatest(F.size(dirs) - 2, F.lit(1)), F.lit(3)), "/")


def is_nullish(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(NULLISH)


def guard_formula(c: Column) -> Column:
    """A leading = + - @ gets an apostrophe, unless the cell is a number."""
    return F.when(c.rlike(r"^[=+\-@]") & ~c.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]+)?%?$"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cell(c: Column) -> Column:
    c = guard_formula(F.coalesce(c, F.lit("")))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)


def ics_escape(c: Column) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(c, "([;,])", r"\\$1"), "\r?\n", r"\\n")


def ics_fold(c: Column) -> Column:
    """A line in pieces of 75 characters; the blank that begins each further piece counts."""
    return F.when(F.length(c) <= 75, c).otherwise(F.concat(F.substr(c, F.lit(1), F.lit(75)), F.regexp_replace(F.substr(c, F.lit(76), F.length(c)), r"(?s)(.{1,74})", "\r\n $1")))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
