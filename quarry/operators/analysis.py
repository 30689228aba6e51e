"""Where the loose files of folders belong: folder profiles, the analysis of target folders, and the plan of moves.

Files are (id, path, vec, name_only); a target is a folder whose own (loose) files are to be put in order, among its
subfolders or in new ones. Many targets are analysed at once; every step is a join or an aggregation by folder, and each
loose file ends with one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import reorg, spanning
from quarry.operators.retrieval import first_chunks, mean_by_file, norm
from quarry.plans.workspace import Workspace

# Names that are never analysed, and names of folders that say nothing.
DENIED_FOLDERS = ".git .hg .svn node_modules .idea .vscode target build dist __pycache__ .ds_store restricted".split()
DENIED_FILES = [".DS_Store", "Thumbs.db", ".gitignore", ".gitattributes"]
GENERIC_FOLDERS = [
    "documents", "document", "docs", "doc", "files", "file", "mixed", "miscellaneous", "misc", "other", "others", "stuff", "various", "general", "uncategorized", "random", "assorted",
    "personal", "personal documents", "personal files",
]
# Fixed values end.
PROFILE_DEPTH, PROFILE_FILES = 4, 200
FIT = 0.70
MOST_LOOSE = 1000


def _denied_folder(name: Column) -> Column:
    return name.startswith(".") | F.lower(name).isin(DENIED_FOLDERS)


def _denied_file(name: Column) -> Column:
    return name.startswith(".") | name.isin(DENIED_FILES)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def under_folders(files: DataFrame, depth: int = PROFILE_DEPTH) -> DataFrame:
    """Each file once for every folder that it is in, up to ``depth`` levels above it, as (folder, ...).

    Denied and hidden files are left out, and a folder sees nothing through a denied or hidden one below it.
    """
    parts = F.split("path", "/")
    f = files.withColumn("parts", parts).filter(~_denied_file(F.element_at("parts", -1))).withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(depth)))).filter(F.col("up") < F.size("parts"))
    above = F.greatest(F.size("parts") - F.col("up"), F.lit(0))  # Spark may compute it before the filter
    between = F.slice("parts", above + 1, F.col("up") - 1)
    folder = F.array_join(F.slice("parts", F.lit(1), above), "/")
    return f.filter(~F.exists(between, _denied_folder)).withColumn("folder", folder).filter("folder <> ''").drop("parts", "up")


def denied_under(path: Column, root: Column) -> Column:
    """Whether a file is skipped in a walk from a root: hidden or denied itself, or in such a folder below the root.

    What lies above the root says nothing. A path that isn't below the root is looked at whole.
    """
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    parts = F.split(F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1, F.length(path))).otherwise(path), "/")
    between = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return _denied_file(F.element_at(parts, -1)) | F.exists(between, _denied_folder)


def shallow(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, path, is_dir): the loose files and subfolders directly in each folder; links, hidden and denied names left out.

    entries: (path, is_dir, is_link). Join and filter are by the parent folder, nothing below it is read.
    """
    name = base_name(F.col("path"))
    kept = entries.filter(~F.coalesce("is_link", F.lit(False)) & (name != "")).filter(~F.when(F.col("is_dir"), _denied_folder(name)).otherwise(_denied_file(name)))
    return kept.withColumn("folder", parent(F.col("path"))).join(folders.select("folder").distinct(), "folder").select("folder", "path", "is_dir")


def profiles(files: DataFrame, depth: int = PROFILE_DEPTH, most: int = PROFILE_FILES, folders: DataFrame | None = None) -> DataFrame:
    """(folder, files, families, vec): a folder's first files in the order of their paths, their families of extensions, and the mean of their vectors.

    vec is null where no file has a vector. A folder's files are cut into salted parts before they are ranked, so that a
    folder that holds most of all files is no single task. ``folders`` (folder) are those asked for.
    """
    ws = Workspace(files.sparkSession, "profiles")
    inside = under_folders(files.select("path", F.col("vec").cast("array<double>").alias("vec")), depth)
    if folders is not None:
        inside = inside.join(folders.select("folder").distinct(), "folder", "left_semi")
    some = ws.stage(first_chunks(inside, "folder", "path", most), "files")
    families = some.groupBy("folder").agg(F.count("*").alias("files"), F.array_sort(F.collect_set(T.family_key(base_name(F.col("path"))))).alias("families"))
    centre = mean_by_file(some.filter("vec is not null"), "folder", "vec")
    return families.join(centre, "folder", "left")


def _similarity(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)), 6))


def fit(loose: DataFrame, profile: DataFrame, least: float = FIT) -> DataFrame:
    """(id, folder, sim): for each loose file (id, target, file_name, vec) the subfolder of its target that is most like it.

    Only subfolders with a file of a compatible extension count; files and folders meet by target and family.
    """
    p = profile.filter("vec is not null").select("folder", parent(F.col("folder")).alias("target"), F.explode("families").alias("family"), F.col("vec").alias("centre"))
    f = loose.filter("vec is not null").select("id", "target", T.family_key(F.col("file_name")).alias("family"), "vec")
    s = f.join(p, ["target", "family"]).select("id", "folder", _similarity("vec", "centre").alias("sim")).filter(F.col("sim") >= least)
    best = s.groupBy("id").agg(F.max("sim").alias("sim"))
    return s.join(best, ["id", "sim"]).groupBy("id", "sim").agg(F.min("folder").alias("folder")).select("id", "folder", "sim")


def analyse(files: DataFrame, targets: DataFrame, least_fit: float = FIT, distance: float = spanning.CLUSTER_DISTANCE, all_pairs: float = reorg.ALL_PAIRS, most_loose: int = MOST_LOOSE) -> DataFrame:
    """A row for each loose file of the targets (target): id, target, file_name, vec, name_only, outcome, folder, sim, cluster, widest, reason.

    In this order, a file is ``out_of_scope`` (its target has too many loose files), has ``no_vector``, is a ``fit`` to a
    subfolder, a member of a ``cluster`` (near, of one family, all pairs alike) or a ``loner`` (alone, or of a group
    that was dissolved as its pairs are too unlike).
    """
    ws = Workspace(files.sparkSession, "analysis")
    size = norm("vec")
    f = files.select(F.col("id").cast("long").alias("id"), "path", F.col("vec").cast("array<double>").alias("vec"), F.coalesce("name_only", F.lit(False)).alias("name_only")).withColumn("file_name", base_name(F.col("path")))
    f = f.withColumn("vec", F.when(size > 1e-12, F.transform("vec", lambda x: x / size)).otherwise(F.col("vec")))
    loose = f.filter(~_denied_file(F.col("file_name"))).withColumn("target", parent(F.col("path"))).join(targets.select("target").distinct(), "target", "left_semi")
    n = loose.groupBy("target").agg(F.count("*").alias("loose"))
    loose = ws.stage(loose.join(n, "target").select("id", "target", "file_name", "vec", "name_only", "loose"), "loose")
    scoped = loose.filter(F.col("loose") <= most_loose)
    near = under_folders(f.select("path"), PROFILE_DEPTH).select("folder").distinct()
    subfolders = near.filter(~_denied_folder(base_name(F.col("folder")))).withColumn("target", parent(F.col("folder"))).join(targets.select("target").distinct(), "target", "left_semi")
    fitted = ws.stage(fit(scoped, profiles(f, folders=subfolders), least_fit), "fits")
    rest = ws.stage(scoped.filter("vec is not null").join(fitted, "id", "left_anti").withColumn("group", F.col("target")), "rest")
    grouped = spanning.clusters(rest, distance, ws)
    grouped = rest.drop("group").join(grouped.select("id", "cluster", "widest"), "id")
    family = T.family_key(F.col("file_name"))
    grouped = ws.stage(grouped.withColumn("group", F.concat_ws("|", F.col("cluster").cast("string"), family)), "groups")
    several = grouped.join(grouped.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1"), "group")
    checked = ws.stage(reorg.pair_checks(several).select("group", "least", "members"), "checked")
    grouped = grouped.join(checked, "group", "left").select("id", F.when(F.col("least") >= all_pairs, F.col("group")).alias("cluster"), F.when(F.col("least") >= all_pairs, F.col("widest")).alias("widest"), F.coalesce(F.col("least") < all_pairs, F.lit(False)).alias("dissolved"))
    d = loose.join(fitted, "id", "left").join(grouped, "id", "left")
    outcome = F.when(F.col("loose") > most_loose, "out_of_scope").when(F.col("vec").isNull(), "no_vector").when(F.col("folder").isNotNull(), "fit").when(F.col("cluster").isNotNull(), "cluster").otherwise("loner")
    reason = F.when(F.col("loose") > most_loose, "too many loose files").when(F.col("vec").isNull(), "no vector").when(F.col("folder").isNotNull(), "like its contents").when(F.col("cluster").isNotNull(), "related files").when(F.col("dissolved"), "dissolved").otherwise("alone")
    return d.select("id", "target", "file_name", "vec", "name_only", outcome.alias("outcome"), "folder", "sim", "cluster", "widest", reason.alias("reason"))


def _generic(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(GENERIC_FOLDERS)


def build_plan(analysis: DataFrame, names: DataFrame, judgments: DataFrame, subfolders: DataFrame, cutoff: float = reorg.CUTOFF, solo: float = reorg.SOLO_CUTOFF, override: float = reorg.OVERRIDE, cohesive: float = spanning.GROUP_SIMILARITY) -> DataFrame:
    """(id, outcome, destination, is_new, source, reason, confidence): one row for each analysed file, moved, dropped with a reason, or left.

    names: (cluster, name, confidence), a model's names of clusters. judgments: (id, placement, folder_name, confidence,
    has_preview) of loners, placement being existing, new or leave. subfolders: (target, name) that exist.

    Names that are unusable or generic drop their files; so do clusters whose names-only members share no token (all
    members, where the naming is unsure) or whose mean of naming and cohesion is below the cutoff. Loners that are sent
    to one new folder need edges of a similarity that span them, unless all are surely judged and some could be read; a
    loner without peers needs more confidence. Names equal but for case are one folder: the existing one, else as first
    spelt, by clusters before loners and then by id.
    """
    ws = Workspace(analysis.sparkSession, "plan")
    a = ws.stage(analysis, "analysis")
    have = subfolders.groupBy("target", F.lower("name").alias("key")).agg(F.min("name").alias("existing"))
    no = lambda kind: F.lit(None).cast(kind)
    # Fits.
    fits = a.filter("outcome = 'fit'").select("id", F.when(F.col("sim") < cutoff, "dropped").otherwise("move").alias("outcome"), F.col("folder").alias("destination"), F.lit(False).alias("is_new"), F.lit("fit").alias("source"), F.when(F.col("sim") < cutoff, "below cutoff").otherwise("fits").alias("reason"), F.col("sim").alias("confidence"))
    # Clusters.
    named = names.select("cluster", T.folder_name(F.col("name")).alias("name"), F.coalesce(F.nanvl(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("naming"))
    c = ws.stage(a.filter("outcome = 'cluster'").join(named, "cluster", "left"), "clusters")
    gates = reorg.token_gates(c.select(F.col("cluster").alias("group"), "id", "file_name", "name_only")).withColumnRenamed("group", "cluster")
    c = c.join(gates, "cluster", "left").withColumn("effective", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("naming") + 0.5 * F.greatest(F.lit(0.0), 1 - F.col("widest")))))
    shares = F.when(F.col("naming") < solo, F.col("share")).otherwise(F.col("share_named"))
    why = F.when(F.col("name").isNull(), "not named").when(F.col("name") == "", "unusable name").when(_generic(F.col("name")), "generic name").when(~shares, "no common token").when(F.col("effective") < cutoff, "below cutoff").otherwise("group")
    c = c.select("id", "target", "name", why.alias("reason"), F.col("effective").alias("confidence"), F.lit("cluster").alias("source"), F.lit(0).alias("turn"), F.min("id").over(reorg.W.partitionBy("cluster")).alias("at"))
    # Loners.
    j = judgments.select("id", F.lower("placement").alias("placement"), F.col("folder_name").alias("asked"), T.folder_name(F.coalesce("folder_name", F.lit(""))).alias("name"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), F.coalesce("has_preview", F.lit(False)).alias("has_preview"))
    judged = ws.stage(a.filter("outcome = 'loner'").select("id", "target", "file_name", "vec", "name_only").join(j, "id", "left"), "judged")
    new = judged.filter("placement = 'new' and name <> ''").withColumn("group", F.concat_ws("/", "target", F.lower("name")))
    g = new.groupBy("group").agg(F.count("*").alias("members"), (F.every(F.col("confidence") >= override) & F.bool_or("has_preview")).alias("sure"), F.count_if(F.col("confidence") >= F.lit(cutoff)).alias("staying"))
    spans = spanning.cohesion(new.select("group", "id", "file_name", "vec", "name_only"), cohesive, ws).select("group", "spans")
    n = new.join(g, "group").join(spans, "group")
    why = (
        F.when(_generic(F.col("name")), "generic name")
        .when((F.col("members") >= 2) & ~F.col("spans") & ~F.col("sure"), "not coherent")
        .when(F.col("confidence") < F.when(F.col("members") == 1, solo).otherwise(cutoff), "below cutoff")
        .when((F.col("members") >= 2) & (F.col("staying") == 1) & (F.col("confidence") < solo), "peers dropped")
        .otherwise("group")
    )
    n = n.select("id", "target", "name", why.alias("reason"), "confidence", F.lit("new").alias("source"), F.lit(1).alias("turn"), F.col("id").alias("at"))
    # Destinations of new folders.
    both = ws.stage(c.unionByName(n).withColumn("key", F.lower("name")), "named")
    fresh = both.filter("reason = 'group'").groupBy("target", "key").agg(F.min_by("name", F.struct("turn", "at")).alias("fresh"))
    both = both.join(fresh, ["target", "key"], "left").join(have, ["target", "key"], "left")
    moves = F.col("reason") == "group"
    where = F.concat_ws("/", "target", F.coalesce("existing", "fresh"))
    outcome = F.when(moves, "move").when(F.col("reason") == "not named", "left").otherwise("dropped")
    both = both.select("id", outcome.alias("outcome"), F.when(moves, where).alias("destination"), F.when(moves, F.col("existing").isNull()).alias("is_new"), "source", "reason", "confidence")
    # Other loners.
    other = judged.filter("coalesce(placement, '') <> 'new' or name = ''").withColumn("key", F.lower("asked")).join(have, ["target", "key"], "left")
    why = F.when(F.col("placement").isNull(), "not judged").when(F.col("placement") == "leave", "leave").when(F.col("placement") == "new", "unusable name").when(F.col("confidence") < cutoff, "below cutoff").when(F.col("existing").isNull(), "no such folder").otherwise("fits")
    outcome = F.when(why == "fits", "move").when(why.isin("leave", "not judged"), "left").otherwise("dropped")
    other = other.select("id", outcome.alias("outcome"), F.when(why == "fits", F.concat_ws("/", "target", "existing")).alias("destination"), F.when(why == "fits", F.lit(False)).alias("is_new"), F.lit("existing").alias("source"), why.alias("reason"), "confidence")
    rest = a.filter("outcome in ('out_of_scope', 'no_vector')").select("id", F.lit("left").alias("outcome"), no("string").alias("destination"), no("boolean").alias("is_new"), no("string").alias("source"), "reason", no("double").alias("confidence"))
    fits = fits.withColumn("destination", F.when(F.col("outcome") == "move", F.col("destination"))).withColumn("is_new", F.when(F.col("outcome") == "move", F.col("is_new")))
    return fits.unionByName(both).unionByName(other).unionByName(rest)
