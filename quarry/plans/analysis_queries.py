"""Queries on the analysis of folders: embeddings stand in for files, five folders are to be put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import analysis as A
from quarry.operators import spanning as S
from quarry.plans.registry import query, table

#: The vectors are nearly at random: limits at which some of them are near each other.
NEAR, LIKE, PAIRS, SPAN = 0.68, 0.3, 0.25, 0.32
NAME = "CASE vec_id % 3 WHEN 0 THEN 'lease ' WHEN 1 THEN 'tax bill ' ELSE 'IMG ' END || vec_id || CASE vec_id % 5 WHEN 4 THEN '.png' WHEN 3 THEN '.zzz' ELSE '.pdf' END"
UNIT = """
e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, vec_id % 7 = 0 AS name_only, {name} AS file_name, CASE vec_id % 5 WHEN 4 THEN 'image' WHEN 3 THEN '.zzz' ELSE 'document' END AS family,
  CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS token, '/t' || label % 5 AS target, CASE WHEN vec_id % 4 = 0 THEN '/t' || label % 5 || '/sub' || label END AS sub FROM embeddings),
f AS (SELECT * EXCLUDE (v), list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v, coalesce(sub || CASE WHEN id % 8 = 0 THEN '/deep' ELSE '' END, target) || '/' || file_name AS path FROM e)
""".format(name=NAME)
#: Edges of the members m (grp, id, v, name_only, token), the least bottleneck between any two, and the forest: edges that are their ends' bottleneck.
TREES = """
p AS (SELECT a.grp, a.id AS a, b.id AS b, CAST(round((1 - list_inner_product(a.v, b.v)) * 1000000) AS BIGINT) AS micro FROM m a JOIN m b ON a.grp = b.grp AND a.id < b.id WHERE (NOT (a.name_only OR b.name_only)) OR (a.token = b.token AND a.token > 0)),
x AS (SELECT * FROM p WHERE micro <= 680000), y AS (SELECT grp, a, b, micro FROM x UNION ALL SELECT grp, b, a, micro FROM x),
r(a, b, micro) AS (SELECT a, b, micro FROM y UNION SELECT r.a, y.b, greatest(r.micro, y.micro) FROM r JOIN y ON r.b = y.a WHERE r.a <> y.b),
z AS (SELECT a, b, min(micro) AS micro FROM r GROUP BY ALL),
t AS (SELECT x.* FROM x JOIN z USING (a, b, micro))
"""
LOOSE = "m AS (SELECT target AS grp, * FROM f WHERE sub IS NULL)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    s = lambda c: c.cast("string")
    name = F.concat(F.when(k % 3 == 0, "lease ").when(k % 3 == 1, "tax bill ").otherwise("IMG "), s(k), F.when(k % 5 == 4, ".png").when(k % 5 == 3, ".zzz").otherwise(".pdf"))
    folder = F.concat(F.lit("/t"), s(F.col("label") % 5), F.when(k % 4 == 0, F.concat(F.lit("/sub"), s(F.col("label")), F.when(k % 8 == 0, "/deep").otherwise(""))).otherwise(""))
    return table(spark, sf_dir, "embeddings").select(k.alias("id"), F.concat(folder, F.lit("/"), name).alias("path"), F.col("embedding").cast("array<double>").alias("vec"), (k % 7 == 0).alias("name_only"), name.alias("file_name"), "label")


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).filter("id % 4 <> 0").withColumn("group", F.concat(F.lit("/t"), (F.col("label") % 5).cast("string")))


def _targets(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("/t"), F.col("id").cast("string")).alias("target"))


@query(f"""WITH RECURSIVE {UNIT}, {LOOSE}, {TREES} SELECT grp AS "group", a, b, micro FROM t""")
def gated_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum spanning forest of each folder's near files; files with nothing but a name need a token in common."""
    return S.forest(_loose(spark, sf_dir), NEAR)


@query(
    f"""WITH RECURSIVE {UNIT}, m AS (SELECT target || '/' || id % 20 AS grp, * FROM f WHERE sub IS NULL), {TREES}, n AS (SELECT grp, count(*) AS members FROM m GROUP BY grp), w AS (SELECT grp, count(*) AS edges, max(micro) AS micro FROM t GROUP BY grp)
SELECT grp AS "group", members, members - coalesce(edges, 0) AS trees, 1 - micro / 1000000 AS loosest, members - coalesce(edges, 0) <= 1 AS spans FROM n LEFT JOIN w USING (grp)"""
)
def group_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether edges of a similarity span each of some small groups."""
    m = _loose(spark, sf_dir).withColumn("group", F.concat("group", F.lit("/"), (F.col("id") % 20).cast("string")))
    return S.cohesion(m, SPAN)


PROFILES = """
under AS (SELECT sub AS folder, path, family, v FROM f WHERE sub IS NOT NULL UNION ALL SELECT sub || '/deep', path, family, v FROM f WHERE sub IS NOT NULL AND id % 8 = 0 UNION ALL SELECT target, path, family, v FROM f),
u AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY path) AS nth FROM under QUALIFY nth <= 200),
o AS (SELECT folder, i, avg(v[i]) AS x FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), os AS (SELECT folder, sqrt(sum(x * x)) AS size FROM o GROUP BY folder),
c AS (SELECT folder, list(x / size ORDER BY i) AS vec FROM o JOIN os USING (folder) GROUP BY folder),
k AS (SELECT folder, count(*) AS files, list(DISTINCT family ORDER BY family) AS families FROM u GROUP BY folder)
"""


@query(f"""WITH {UNIT}, {PROFILES} SELECT folder, files, array_to_string(families, ',') AS families, round(vec[1], 6) AS x0, round(vec[64], 6) AS x63 FROM k JOIN c USING (folder)""")
def folder_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in each folder, up to four levels down, by its first 200 files."""
    f = _files(spark, sf_dir)
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    p = A.profiles(f.withColumn("vec", F.transform("vec", lambda x: x / size)))
    return p.select("folder", "files", F.array_join("families", ",").alias("families"), F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(F.get("vec", F.lit(63)), 6).alias("x63"))


ANALYSIS = f"""
loose AS (SELECT * FROM f WHERE sub IS NULL),
fits AS (SELECT id, c.folder, round(list_inner_product(l.v, c.vec), 6) AS sim FROM loose l JOIN k ON k.folder LIKE l.target || '/sub%' AND k.folder NOT LIKE '%/deep' AND list_contains(k.families, l.family) JOIN c ON c.folder = k.folder),
fit AS (SELECT id, folder, sim FROM fits WHERE sim >= {LIKE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, folder) = 1),
m AS (SELECT target AS grp, * FROM loose WHERE id NOT IN (SELECT id FROM fit)), {TREES},
cl AS (SELECT m.id, least(m.id, coalesce(min(z.b), m.id)) || '|' || m.family AS g, coalesce(max(z.micro), 0) AS wide, least(m.id, coalesce(min(z.b), m.id)) AS root FROM m LEFT JOIN z ON z.a = m.id GROUP BY m.id, m.family),
cw AS (SELECT root, max(wide) / 1000000 AS widest FROM cl GROUP BY root),
size AS (SELECT g, count(*) AS n FROM cl GROUP BY g),
pairs AS (SELECT a.g, min(list_inner_product(x.v, y.v)) AS least FROM cl a JOIN cl b ON a.g = b.g AND a.id < b.id JOIN f x ON x.id = a.id JOIN f y ON y.id = b.id GROUP BY a.g),
an AS (SELECT l.id, l.target, l.label, l.token, l.name_only, CASE WHEN fit.id IS NOT NULL THEN 'fit' WHEN n > 1 AND round(least, 6) >= {PAIRS} THEN 'cluster' ELSE 'loner' END AS outcome, fit.folder, fit.sim, CASE WHEN n > 1 AND round(least, 6) >= {PAIRS} THEN cl.g END AS cluster, cw.widest,
  CASE WHEN fit.id IS NOT NULL THEN 'like its contents' WHEN n > 1 AND round(least, 6) >= {PAIRS} THEN 'related files' WHEN n > 1 THEN 'dissolved' ELSE 'alone' END AS reason
  FROM loose l LEFT JOIN fit ON fit.id = l.id LEFT JOIN cl ON cl.id = l.id LEFT JOIN size USING (g) LEFT JOIN pairs USING (g) LEFT JOIN cw USING (root))
"""


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analyse(_files(spark, sf_dir), _targets(spark), LIKE, NEAR, PAIRS)


@query(f"""WITH RECURSIVE {UNIT}, {PROFILES}, {ANALYSIS} SELECT id, target, outcome, folder, sim, cluster, reason FROM an""")
def folder_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each loose file of five folders belongs, and why."""
    return _analysis(spark, sf_dir).select("id", "target", "outcome", "folder", "sim", "cluster", "reason")


PLAN = """
named AS (SELECT DISTINCT cluster, CAST(split_part(cluster, '|', 1) AS BIGINT) AS r FROM an WHERE cluster IS NOT NULL),
nm AS (SELECT cluster, CASE r % 4 WHEN 0 THEN 'Leases' WHEN 1 THEN 'Misc' ELSE 'Tax bills' END AS name, CASE WHEN r % 2 = 0 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS naming FROM named WHERE r % 4 <> 3),
gate AS (SELECT a.cluster, bool_and(a.token = b.token AND a.token > 0) AS share, bool_and(NOT (a.name_only OR b.name_only) OR (a.token = b.token AND a.token > 0)) AS share_named FROM an a JOIN an b ON a.cluster = b.cluster AND a.id < b.id GROUP BY a.cluster),
ce AS (SELECT an.id, target, name, naming, share, share_named, greatest(0, least(1, 0.5::DOUBLE * naming + 0.5::DOUBLE * greatest(0, 1 - widest))) AS confidence, min(an.id) OVER (PARTITION BY an.cluster) AS "at" FROM an LEFT JOIN nm USING (cluster) LEFT JOIN gate USING (cluster) WHERE outcome = 'cluster'),
c1 AS (SELECT id, target, name, confidence, 'cluster' AS source, 0 AS turn, "at", CASE WHEN name IS NULL THEN 'not named' WHEN lower(name) = 'misc' THEN 'generic name' WHEN NOT (CASE WHEN naming < 0.8 THEN share ELSE share_named END) THEN 'no common token' WHEN confidence < 0.6 THEN 'below cutoff' ELSE 'group' END AS reason FROM ce),
j AS (SELECT id, target, token, name_only, CASE id % 6 WHEN 0 THEN 'existing' WHEN 3 THEN 'leave' WHEN 5 THEN NULL ELSE 'new' END AS placement, (50 + id % 5 * 10) / 100::DOUBLE AS confidence, id % 3 = 0 AS has_preview,
  CASE WHEN id % 6 = 0 THEN CASE WHEN id % 9 = 0 THEN 'nowhere' ELSE 'sub' || label END WHEN id % 6 = 1 THEN 'Group ' || id % 12 WHEN id % 6 = 4 THEN CASE WHEN id % 5 = 0 THEN '' ELSE 'stuff' END WHEN id % 5 < 2 THEN 'LEASES' ELSE 'group ' || id % 12 END AS name FROM an WHERE outcome = 'loner'),
nw AS (SELECT * FROM j WHERE placement = 'new' AND name <> ''),
gm AS (SELECT target, lower(name) AS key, count(*) AS members, bool_and(confidence >= 0.85) AND bool_or(has_preview) AS sure, count(*) FILTER (confidence >= 0.6) AS staying FROM nw GROUP BY ALL),
ge AS (SELECT a.id AS a, b.id AS b FROM nw a JOIN nw b ON a.target = b.target AND lower(a.name) = lower(b.name) AND a.id <> b.id JOIN f fa ON fa.id = a.id JOIN f fb ON fb.id = b.id
  WHERE round((1 - list_inner_product(fa.v, fb.v)) * 1000000) <= 680000 AND (NOT (a.name_only OR b.name_only) OR (a.token = b.token AND a.token > 0))),
gr(a, b) AS (SELECT a, b FROM ge UNION SELECT gr.a, ge.b FROM gr JOIN ge ON gr.b = ge.a),
gc AS (SELECT nw.target, lower(name) AS key, least(id, coalesce(min(b), id)) AS root FROM nw LEFT JOIN gr ON gr.a = id GROUP BY nw.target, lower(name), id),
gs AS (SELECT target, key, count(DISTINCT root) = 1 AS spans FROM gc GROUP BY ALL),
n1 AS (SELECT id, nw.target, name, confidence, 'new' AS source, 1 AS turn, id AS "at", CASE WHEN lower(name) = 'stuff' THEN 'generic name' WHEN members >= 2 AND NOT spans AND NOT sure THEN 'not coherent' WHEN confidence < CASE WHEN members = 1 THEN 0.8 ELSE 0.6 END THEN 'below cutoff'
  WHEN members >= 2 AND staying = 1 AND confidence < 0.8 THEN 'peers dropped' ELSE 'group' END AS reason FROM nw JOIN gm ON gm.target = nw.target AND gm.key = lower(name) JOIN gs ON gs.target = nw.target AND gs.key = lower(name)),
both_ AS (SELECT * FROM c1 UNION ALL BY NAME SELECT * FROM n1),
fresh AS (SELECT target, lower(name) AS key, arg_min(name, turn * 1000000 + "at") AS fresh FROM both_ WHERE reason = 'group' GROUP BY ALL),
o1 AS (SELECT id, target, label, placement, j.name, confidence, CASE WHEN placement IS NULL THEN 'not judged' WHEN placement = 'leave' THEN 'leave' WHEN placement = 'new' THEN 'unusable name' WHEN confidence < 0.6 THEN 'below cutoff' WHEN j.name = 'nowhere' THEN 'no such folder' ELSE 'fits' END AS reason FROM j JOIN (SELECT id, label FROM f) USING (id) WHERE placement IS NULL OR placement <> 'new' OR name = '')
"""


@query(
    f"""WITH RECURSIVE {UNIT}, {PROFILES}, {ANALYSIS}, {PLAN}
SELECT id, CASE WHEN sim < 0.6 THEN 'dropped' ELSE 'move' END AS outcome, CASE WHEN sim >= 0.6 THEN folder END AS destination, CASE WHEN sim >= 0.6 THEN false END AS is_new, 'fit' AS source, CASE WHEN sim < 0.6 THEN 'below cutoff' ELSE 'fits' END AS reason, round(sim, 6) AS confidence FROM an WHERE outcome = 'fit'
UNION ALL SELECT id, CASE reason WHEN 'group' THEN 'move' WHEN 'not named' THEN 'left' ELSE 'dropped' END, CASE WHEN reason = 'group' THEN b.target || '/' || fresh END, CASE WHEN reason = 'group' THEN true END, source, reason, round(confidence, 6) FROM both_ b LEFT JOIN fresh ON fresh.target = b.target AND fresh.key = lower(b.name)
UNION ALL SELECT id, CASE WHEN reason = 'fits' THEN 'move' WHEN reason IN ('leave', 'not judged') THEN 'left' ELSE 'dropped' END, CASE WHEN reason = 'fits' THEN target || '/sub' || label END, CASE WHEN reason = 'fits' THEN false END, 'existing', reason, CASE WHEN placement IS NULL THEN NULL ELSE round(confidence, 6) END FROM o1"""
)
def folder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each loose file after a model has named clusters and judged loners: one row a file."""
    a = _analysis(spark, sf_dir)
    r = F.split_part("cluster", F.lit("|"), F.lit(1)).cast("long")
    names = a.filter("cluster is not null").select("cluster").distinct().withColumn("r", r).filter("r % 4 <> 3")
    names = names.select("cluster", F.when(F.col("r") % 4 == 0, "Leases").when(F.col("r") % 4 == 1, "Misc").otherwise("Tax: bills.").alias("name"), F.when(F.col("r") % 2 == 0, 0.9).otherwise(0.7).alias("confidence"))
    k = F.col("id")
    s = lambda c: c.cast("string")
    asked = (
        F.when(k % 6 == 0, F.when(k % 9 == 0, "nowhere").otherwise(F.concat(F.lit("SUB"), s(F.col("label")))))
        .when(k % 6 == 1, F.concat(F.lit("Group "), s(k % 12)))
        .when(k % 6 == 4, F.when(k % 5 == 0, " ? ").otherwise("stuff"))
        .otherwise(F.when(k % 5 < 2, "LEASES").otherwise(F.concat(F.lit("group "), s(k % 12))))
    )
    f = _files(spark, sf_dir)
    judged = f.filter("id % 6 <> 5").select("id", F.when(k % 6 == 0, "existing").when(k % 6 == 3, "leave").otherwise("NEW").alias("placement"), asked.alias("folder_name"), ((50 + k % 5 * 10) / 100).alias("confidence"), (k % 3 == 0).alias("has_preview"))
    subs = f.filter("id % 4 = 0").select(F.concat(F.lit("/t"), s(F.col("label") % 5)).alias("target"), F.concat(F.lit("sub"), s(F.col("label"))).alias("name")).distinct()
    return A.build_plan(a, names, judged, subs, cohesive=SPAN).withColumn("confidence", F.round("confidence", 6))
