"""Reorganising folders: name tokens, groups by file family, checks of groups, scope and destinations.

Members of a group are (group, id, file_name, vec) with unit vectors. Checks of all
pairs of a group work on blocks of members, one pair of blocks to a task, and return
one row for a pair of blocks; no pair of members becomes a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T

# Words of file names that machines or file states give.
NOISE = (
    "the and for with from into onto this that these those your yours mine his her its their am pm "
    "img image imgs images photo photos pic pics picture pictures dsc dscn screenshot screenshots screen shot shots "
    "copy final draft version untitled new old temp backup "
    "jpg jpeg png gif bmp webp tiff tif svg heic heif raw pdf doc docx txt md rtf odt pages epub "
    "mp3 mp4 mov wav avi mkv webm flac ogg zip rar tar gz tgz bz2 7z ppt pptx key odp xls xlsx csv tsv numbers "
    "html htm css json xml yaml yml exe dmg iso app"
).split()
# Fixed values end.
MAX_DECISIONS = 50
CUTOFF, SOLO_CUTOFF, OVERRIDE, ALL_PAIRS = 0.60, 0.80, 0.85, 0.75
BLOCK = 512


def name_tokens(name: Column) -> Column:
    """Distinct lower-cased runs of letters of three or more in a name without its extension, but for noise words."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=.)\.[^.]*$", "")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(base), F.lit("([a-z]{3,})"), F.lit(1)), lambda t: ~t.isin(NOISE)))


def split_by_family(members: DataFrame) -> DataFrame:
    """Groups cut by file family; files of no family stay with those of their own extension."""
    name = F.col("file_name")
    family = T.extension_family(name)
    return members.withColumn("group", F.concat_ws("|", F.col("group").cast("string"), F.when(family == "other", F.concat(F.lit("other:"), T.extension(name))).otherwise(family)))


def pair_checks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per group its size, its least similarity of a pair (1 for a loner), and whether all pairs share a name token."""
    n = members.groupBy("group").agg(F.count("*").alias("members"))
    m = members.join(n, "group").select("group", "id", "members", name_tokens(F.col("file_name")).alias("tokens"), F.col("vec").cast("array<double>").alias("vec"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    m = m.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def check(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        a, b = np.flatnonzero(f["own"] == key[1]), np.flatnonzero(f["own"] == key[2])
        least, share = 1.0, True
        if len(a) and len(b):
            x = np.stack(f["vec"].to_numpy())
            words = {w: i for i, w in enumerate(sorted({w for t in f["tokens"] for w in t}))}
            has = np.zeros((len(f), len(words) + 1), dtype=np.float32)
            for i, t in enumerate(f["tokens"]):
                has[i, [words[w] for w in t]] = 1
            sim, common = np.clip(x[a] @ x[b].T, -1, 1), has[a] @ has[b].T
            if key[1] == key[2]:
                np.fill_diagonal(sim, 1.0)
                np.fill_diagonal(common, 1.0)
            least, share = float(sim.min()), bool((common > 0).all())
        return pd.DataFrame({"group": [key[0]], "least": [least], "share": [share]})

    part = m.groupBy("group", "lo", "hi").applyInPandas(check, "group string, least double, share boolean")
    return part.groupBy("group").agg(F.round(F.min("least"), 6).alias("least"), F.every("share").alias("share")).join(n.select(F.col("group").cast("string").alias("group"), "members"), "group")


def token_gates(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group, share, share_named): whether all pairs of a group's names share a token, and whether those do of which a file has nothing but its name.

    members: group, id, file_name, name_only; pairs of blocks as in ``pair_checks``.
    """
    n = members.groupBy("group").agg(F.count("*").alias("members"))
    m = members.join(n, "group").select("group", "id", "members", F.coalesce("name_only", F.lit(False)).alias("name_only"), name_tokens(F.col("file_name")).alias("tokens"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    m = m.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    m = m.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def check(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        words = {w: i for i, w in enumerate(sorted({w for t in f["tokens"] for w in t}))}
        has = np.zeros((len(f), len(words) + 1), dtype=np.float32)
        for i, t in enumerate(f["tokens"]):
            has[i, [words[w] for w in t]] = 1
        share = has @ has.T > 0
        np.fill_diagonal(share, True)
        own, only = f["own"].to_numpy(), f["name_only"].to_numpy(bool)
        if key[1] != key[2]:
            share |= own[:, None] == own
        return pd.DataFrame({"group": [key[0]], "share": [bool(share.all())], "share_named": [bool((share | ~(only[:, None] | only)).all())]})

    part = m.groupBy("group", "lo", "hi").applyInPandas(check, "group string, share boolean, share_named boolean")
    return part.groupBy("group").agg(F.every("share").alias("share"), F.every("share_named").alias("share_named"))


def judge_groups(checked: DataFrame, confidence: Column, cutoff: float = CUTOFF, pairs: float = ALL_PAIRS) -> DataFrame:
    """A verdict per group: too small, too loose, below the cutoff, without common names where the naming is unsure, or accepted.

    The effective confidence is the mean of the naming's confidence and the cohesion.
    """
    effective = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * confidence + 0.5 * F.col("least")))
    verdict = (
        F.when(F.col("members") < 2, "loner")
        .when(F.col("least") < pairs, "loose")
        .when(effective < cutoff, "below_cutoff")
        .when((confidence < SOLO_CUTOFF) & ~F.col("share"), "no_common_token")
        .otherwise("accepted")
    )
    return checked.withColumn("effective", F.round(effective, 7)).withColumn("verdict", verdict)


def judge_loners(proposals: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """proposals: folder, id, confidence, has_preview. Per folder whether its files may go there, and if cohesion needn't be tested.

    A single file needs more confidence; a group in which all are sure and some had text to read overrides cohesion.
    """
    n = proposals.groupBy("folder").agg(F.count("*").alias("n"))
    kept = proposals.join(n, "folder").filter(F.col("confidence") >= F.when(F.col("n") == 1, SOLO_CUTOFF).otherwise(cutoff))
    return kept.groupBy("folder").agg(F.count("*").alias("files"), (F.every(F.col("confidence") >= OVERRIDE) & F.bool_or("has_preview")).alias("overrides"))


def scope(decisions: DataFrame, subfolders: DataFrame, most: int = MAX_DECISIONS, n: int = 2) -> DataFrame:
    """decisions: (folder, decisions); subfolders: (folder, sub, files). Whether a folder can be done in one pass, and else its largest subfolders."""
    largest = W.partitionBy("folder").orderBy(F.desc("files"), "sub")
    top = subfolders.filter("files > 0").withColumn("r", F.row_number().over(largest)).filter(F.col("r") <= n)
    hints = top.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "sub", "files"))), lambda s: F.concat(s["sub"], F.lit(" ("), s["files"].cast("string"), F.lit(")"))).alias("hints"))
    d = decisions.join(hints, "folder", "left").withColumn("allowed", F.col("decisions") <= most)
    return d.withColumn("hints", F.when(~F.col("allowed"), F.coalesce("hints", F.array().cast("array<string>"))))


def destinations(proposals: DataFrame, existing: DataFrame) -> DataFrame:
    """proposals: (ord, name); existing: (folder). Names equal but for case share one folder: the existing one, else the first spelling's."""
    key = F.lower(T.folder_name(F.col("name")))
    p = proposals.withColumn("key", key)
    first = p.groupBy("key").agg(F.min_by(T.folder_name(F.col("name")), "ord").alias("fresh"))
    have = existing.groupBy(F.lower("folder").alias("key")).agg(F.min("folder").alias("folder"))
    out = p.join(first, "key").join(have, "key", "left")
    return out.select("ord", F.coalesce("folder", "fresh").alias("destination"), F.col("folder").isNull().alias("is_new"))
