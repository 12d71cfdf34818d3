"""Queries on snapshots, line counts and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import snapshot as S
from auditlake.plans.registry import query
from auditlake.plans.views import alike, duck, view

_SNAP = ["snap_base", "snap_tip"]
DIFF = """+ rows_ AS (SELECT coalesce(a.path, b.path) AS path, a.path AS old_path, a.oid AS old_oid, b.oid AS new_oid, a.mode AS old_mode, b.mode AS new_mode, a.text AS old_text, b.text AS new_text,
  CASE WHEN a.oid IS NULL THEN 'A' WHEN b.oid IS NULL THEN 'D' WHEN (a.mode = '120000') <> (b.mode = '120000') THEN 'T' WHEN a.oid <> b.oid OR a.mode <> b.mode THEN 'M' ELSE '=' END AS status
  FROM snap_base a FULL JOIN snap_tip b ON a.path = b.path), diff AS (SELECT status, path, old_path, old_oid, new_oid, old_mode, new_mode FROM rows_ WHERE status <> '=')"""


def _diff(spark, sf, **more):
    return S.snapshot_diff(view(spark, sf, "snap_base"), view(spark, sf, "snap_tip"), **more)


@query("snapshot_diff", duck(_SNAP, DIFF + " SELECT * FROM diff"))
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query(
    "flatten",
    duck(["tree_entries"], """+ walk AS (SELECT name AS path, mode, child_oid AS oid, child_kind AS kind FROM tree_entries WHERE tree_oid = 'root'
    UNION ALL SELECT concat(w.path, '/', t.name), t.mode, t.child_oid, t.child_kind FROM walk w JOIN tree_entries t ON t.tree_oid = w.oid WHERE w.kind = 'tree') SELECT 'root' AS root, * FROM walk""", True),
)
def flatten(spark, sf):
    return S.flatten(spark.createDataFrame([("root",)], "root string"), view(spark, sf, "tree_entries"))


@query("detect_renames", duck(_SNAP, DIFF + """, d AS (SELECT *, row_number() OVER (PARTITION BY old_oid ORDER BY path) AS n FROM diff WHERE status = 'D'), a AS (SELECT *, row_number() OVER (PARTITION BY new_oid ORDER BY path) AS n FROM diff WHERE status = 'A'),
  r AS (SELECT a.path, d.path AS gone, d.old_oid, a.new_oid, d.old_mode, a.new_mode FROM d JOIN a ON a.new_oid = d.old_oid AND a.n = d.n)
  SELECT * FROM diff WHERE NOT (status = 'D' AND path IN (SELECT gone FROM r)) AND NOT (status = 'A' AND path IN (SELECT path FROM r)) UNION ALL SELECT 'R', path, gone, old_oid, new_oid, old_mode, new_mode FROM r"""))
def detect_renames(spark, sf):
    return S.detect_renames(_diff(spark, sf))


@query("rename_counts", duck(_SNAP, DIFF + """, d AS (SELECT old_oid AS oid, count(*) AS n FROM diff WHERE status = 'D' GROUP BY 1), a AS (SELECT new_oid AS oid, count(*) AS n FROM diff WHERE status = 'A' GROUP BY 1)
  SELECT oid, least(d.n, a.n) AS renames FROM d JOIN a USING (oid)"""))
def rename_counts(spark, sf):
    """Per content, as many renames as the fewer of its deleted and added paths."""
    return S.detect_renames(_diff(spark, sf)).where("status = 'R'").groupBy(F.col("new_oid").alias("oid")).agg(F.count("*").alias("renames"))


def _texts(spark, sf, name):
    return view(spark, sf, name).select("path", "mode", "oid", "text")


_D = "(SELECT '' AS pair, path, old_text AS text FROM rows_ WHERE status = 'D')"
_A = "(SELECT '' AS pair, path, new_text AS text FROM rows_ WHERE status = 'A')"


@query("similar_renames", duck(_SNAP, DIFF + f", {alike(_D, _A, 'near')} SELECT gone AS d, path AS a, score FROM near"))
def similar_renames(spark, sf):
    """Deleted and added texts alike by half, those of equal content too."""
    rows = _diff(spark, sf)
    pick = lambda status, snap: rows.where(f"status = '{status}'").select("path").join(view(spark, sf, snap).select("path", "text"), "path")
    return S.similar_renames(pick("D", "snap_base"), pick("A", "snap_tip"))


@query("find_copies", duck(_SNAP, DIFF + """, kept AS (SELECT new_oid AS oid, min(path) AS old_path FROM rows_ WHERE status = '=' GROUP BY 1)
  SELECT 'C' AS status, path, kept.old_path, oid AS old_oid, new_oid, new_mode FROM diff JOIN kept ON oid = new_oid WHERE status = 'A'"""))
def find_copies(spark, sf):
    return S.find_copies(_diff(spark, sf, keep_unchanged=True))


RENAMED = DIFF + """, d AS (SELECT *, row_number() OVER (PARTITION BY old_oid ORDER BY path) AS n FROM diff WHERE status = 'D'), a AS (SELECT *, row_number() OVER (PARTITION BY new_oid ORDER BY path) AS n FROM diff WHERE status = 'A'),
  r AS (SELECT a.path, d.path AS gone, d.old_oid, a.new_oid, d.old_mode, a.new_mode FROM d JOIN a ON a.new_oid = d.old_oid AND a.n = d.n),
  renamed AS (SELECT * FROM diff WHERE NOT (status = 'D' AND path IN (SELECT gone FROM r)) AND NOT (status = 'A' AND path IN (SELECT path FROM r)) UNION ALL SELECT 'R', path, gone, old_oid, new_oid, old_mode, new_mode FROM r)"""


_LEFT = """(SELECT '' AS pair, path, {0}_text AS text FROM rows_ WHERE status = '{1}' AND {0}_mode <> '120000' AND NOT contains({0}_text, chr(0)) AND path NOT IN (SELECT {2} FROM r))"""
CHANGED = RENAMED + f""", {alike(_LEFT.format("old", "D", "gone"), _LEFT.format("new", "A", "path"), "near")},
  changed AS (SELECT * FROM renamed WHERE NOT (status = 'D' AND path IN (SELECT gone FROM near)) AND NOT (status = 'A' AND path IN (SELECT path FROM near))
    UNION ALL SELECT 'R', n.path, gone, d.old_oid, a.new_oid, d.old_mode, a.new_mode FROM near n JOIN diff d ON d.path = gone AND d.status = 'D' JOIN diff a ON a.path = n.path AND a.status = 'A')"""


@query("changed_files", duck(_SNAP, CHANGED + " SELECT status, path, old_path, lpad(coalesce(old_mode, '0'), 6, '0') AS old_mode, lpad(coalesce(new_mode, '0'), 6, '0') AS new_mode FROM changed"))
def changed_files(spark, sf):
    mode = lambda c: F.lpad(F.coalesce(c, F.lit("0")), 6, "0").alias(c)
    return S.changed_files(_texts(spark, sf, "snap_base"), _texts(spark, sf, "snap_tip")).select("status", "path", "old_path", mode("old_mode"), mode("new_mode"))


@query("non_text", duck(_SNAP, DIFF + " SELECT path, coalesce(old_mode NOT IN ('100644', '100755'), false) OR coalesce(new_mode NOT IN ('100644', '100755'), false) OR (ord(substr(path, 5, 1)) % 2 = 0 AND new_mode IS NOT NULL) AS non_text FROM rows_ WHERE status <> '='"))
def non_text(spark, sf):
    rows = _diff(spark, sf)
    old = view(spark, sf, "snap_base").select("path", F.col("text").alias("old_text"))
    new = view(spark, sf, "snap_tip").select("path", F.when(F.ascii(F.substring("path", 5, 1)) % 2 == 0, F.concat(F.lit("\0"), "text")).otherwise(F.col("text")).alias("new_text"))
    return rows.join(old, "path", "left").join(new, "path", "left").select("path", S.non_text("old_mode", "new_mode", "old_text", "new_text").alias("non_text"))
