"""Queries on the commit graph and on receiving."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import history as H
from auditlake.operators import receive as R
from auditlake.plans.registry import query
from auditlake.plans.views import duck, view

REACH = """+ reach(start, node) AS (SELECT DISTINCT oid, oid FROM heads UNION SELECT r.start, e.parent FROM reach r JOIN edges e ON e.child = r.node)"""
PAIR_REACH = """+ reach(start, node) AS (SELECT x, x FROM (SELECT incoming AS x FROM pairs UNION SELECT target FROM pairs) WHERE x IS NOT NULL UNION SELECT r.start, e.parent FROM reach r JOIN edges e ON e.child = r.node),
gen AS (SELECT id, max(d) AS generation FROM depth GROUP BY id),
depth(id, d) AS (SELECT id, 0 FROM commits WHERE p1 IS NULL AND p2 IS NULL UNION SELECT e.child, d.d + 1 FROM depth d JOIN edges e ON e.parent = d.id)"""
GEN = """+ depth(id, d) AS (SELECT id, 0 FROM commits WHERE p1 IS NULL AND p2 IS NULL UNION SELECT e.child, d.d + 1 FROM depth d JOIN edges e ON e.parent = d.id),
gen AS (SELECT id, max(d) AS generation FROM depth GROUP BY id)"""
PLAN = PAIR_REACH.split("gen AS")[0] + GEN[2:] + """,
base AS (SELECT p.cust, arg_max(c.id, (generation, c.time, c.id)) AS merge_base FROM pairs p JOIN reach a ON a.start = p.incoming JOIN reach b ON b.start = p.target AND b.node = a.node JOIN gen ON gen.id = a.node JOIN commits c ON c.id = a.node GROUP BY p.cust),
plan AS (SELECT p.repo AS bundle_id, p.cust, p.target_ref, p.target, p.incoming, base.merge_base,
  CASE WHEN p.target IS NULL THEN 'target_missing' WHEN p.target = p.incoming THEN 'already_present' WHEN f.start IS NOT NULL THEN 'fast_forward_ok' WHEN k.start IS NOT NULL THEN 'target_ahead' ELSE 'diverged_merge_required' END AS status
  FROM pairs p LEFT JOIN base USING (cust) LEFT JOIN reach f ON f.start = p.incoming AND f.node = p.target LEFT JOIN reach k ON k.start = p.target AND k.node = p.incoming),
merge AS (SELECT bundle_id, target_ref, CASE cust % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'conflicted' ELSE 'unknown' END AS status FROM plan WHERE cust % 7 <> 0)"""
_V = ["pairs", "edges", "commits"]


def _starts(spark, sf):
    return view(spark, sf, "heads").select(F.col("oid").alias("start"))


@query("ancestors", duck(["heads", "edges"], REACH + " SELECT start, node FROM reach", True))
def ancestors(spark, sf):
    return H.ancestors(_starts(spark, sf), view(spark, sf, "edges"))


@query(
    "commit_range",
    duck(["heads", "edges", "ranked"], """+ ends AS (SELECT h.oid AS tip, r.id AS hidden FROM heads h LEFT JOIN ranked r ON r.cust = h.cust AND r.r = 3),
    reach(start, node) AS (SELECT x, x FROM (SELECT tip AS x FROM ends UNION SELECT hidden FROM ends) WHERE x IS NOT NULL UNION SELECT r.start, e.parent FROM reach r JOIN edges e ON e.child = r.node)
    SELECT tip AS range_id, node FROM ends JOIN reach ON start = tip EXCEPT SELECT tip, node FROM ends JOIN reach ON start = hidden""", True),
)
def commit_range(spark, sf):
    third = view(spark, sf, "ranked").where("r = 3").select("cust", F.col("id").alias("hidden"))
    ranges = view(spark, sf, "heads").join(third, "cust", "left").select(F.col("oid").alias("range_id"), F.col("oid").alias("tip"), "hidden")
    return H.commit_range(ranges, view(spark, sf, "edges"))


def _pairs(spark, sf):
    return view(spark, sf, "pairs")


@query("is_descendant", duck(_V, PAIR_REACH.split(",\ngen")[0] + " SELECT cust, incoming AS a, target AS b, r.start IS NOT NULL AS descends FROM pairs LEFT JOIN reach r ON r.start = incoming AND r.node = target AND incoming <> target", True))
def is_descendant(spark, sf):
    return H.is_descendant(_pairs(spark, sf).select("cust", F.col("incoming").alias("a"), F.col("target").alias("b")), view(spark, sf, "edges"))


@query("range_guard", duck(_V, PAIR_REACH.split(",\ngen")[0] + " SELECT cust AS range_id, incoming AS tip, target AS base, r.start IS NOT NULL AS linear FROM pairs LEFT JOIN reach r ON r.start = incoming AND r.node = target", True))
def range_guard(spark, sf):
    return H.range_guard(_pairs(spark, sf).select(F.col("cust").alias("range_id"), F.col("incoming").alias("tip"), F.col("target").alias("base")), view(spark, sf, "edges"))


@query("topological", duck(_V, GEN + " SELECT id, repo, generation, row_number() OVER (PARTITION BY repo ORDER BY generation, time, id) - 1 AS position FROM commits JOIN gen USING (id)", True))
def topological(spark, sf):
    return H.topological(view(spark, sf, "commits"), view(spark, sf, "edges")).select("id", "repo", "generation", "position")


@query("merge_base", duck(_V, PLAN + " SELECT cust, incoming AS a, target AS b, merge_base FROM plan", True))
def merge_base(spark, sf):
    return H.merge_base(_pairs(spark, sf).select("cust", F.col("incoming").alias("a"), F.col("target").alias("b")), view(spark, sf, "commits"), view(spark, sf, "edges"))


VISIT = """+ keys(bundle_id, node, k) AS (SELECT bundle_id, oid, [cast({head} AS int)] FROM heads UNION SELECT x.bundle_id, e.parent, list_append(k, cast({index} AS int)) FROM keys x JOIN edges e ON e.child = x.node),
best AS (SELECT bundle_id, node AS id, min(k) AS k FROM keys GROUP BY ALL)"""


@query("visit_order", duck(["heads", "edges"], VISIT.format(head="head_index", index="parent_index") + " SELECT bundle_id, id, k[1] AS head_index, row_number() OVER (PARTITION BY bundle_id, k[1] ORDER BY k) AS commit_order FROM best", True))
def visit_order(spark, sf):
    return H.visit_order(view(spark, sf, "heads"), view(spark, sf, "commits"), view(spark, sf, "edges"))


@query(
    "display_order",
    duck(["heads", "edges", "commits"], VISIT.format(head="-head_index", index="-parent_index") + """ SELECT bundle_id, id, row_number() OVER (PARTITION BY bundle_id ORDER BY part, k, time DESC, id) AS row
      FROM (SELECT bundle_id, id, 0 AS part, k, NULL AS time FROM best UNION ALL SELECT repo, id, 1, [], time FROM commits WHERE id NOT IN (SELECT id FROM best)) x""", True),
)
def display_order(spark, sf):
    return H.display_order(view(spark, sf, "heads"), view(spark, sf, "commits"), view(spark, sf, "edges"))


@query(
    "boundary",
    duck(["edges", "commits"], """SELECT DISTINCT parent AS id, CASE WHEN parent % 3 = 0 THEN '<prerequisite commit unavailable>' ELSE p.message END AS subject
      FROM edges JOIN commits s ON s.id = child JOIN commits p ON p.id = parent WHERE s.time >= '1996-01-01' AND p.time < '1996-01-01'"""),
)
def boundary(spark, sf):
    commits = view(spark, sf, "commits").withColumn("subject", F.col("message"))
    return H.boundary(commits.where("time >= '1996-01-01'"), view(spark, sf, "edges"), commits.where("id % 3 <> 0"))


@query(
    "decorations",
    duck(["decor_refs", "all_heads"], """+ l AS (SELECT repo, oid AS id, 1 AS rank, substr(ref_name, 12) AS label FROM decor_refs WHERE ref_name LIKE 'refs/heads/%' UNION ALL SELECT repo, oid, 2, 'tag: ' || substr(ref_name, 11) FROM decor_refs WHERE ref_name LIKE 'refs/tags/%'
      UNION ALL SELECT bundle_id, oid, 0, 'HEAD -> ' || substr(reference, 12) FROM all_heads UNION ALL SELECT repo + 100, oid, 1, concat('copy', oid % 3) FROM decor_refs WHERE ref_name LIKE 'refs/tags/%')
      SELECT repo, id, string_agg(label, ', ' ORDER BY rank, label) AS labels FROM (SELECT repo, id, label, min(rank) AS rank FROM l GROUP BY ALL) GROUP BY repo, id"""),
)
def decorations(spark, sf):
    """Each repository has a copy, with all of its commits and refs of its own to some of them."""
    refs, commits = view(spark, sf, "decor_refs"), view(spark, sf, "commits").select("repo", "id")
    copied = refs.where("ref_name like 'refs/tags/%'").select((F.col("repo") + 100).alias("repo"), F.concat(F.lit("refs/heads/copy"), (F.col("oid") % 3).cast("string")).alias("ref_name"), "oid")
    heads = view(spark, sf, "heads").withColumnRenamed("bundle_id", "repo")
    return H.decorations(refs.unionByName(copied), heads, commits.unionByName(commits.withColumn("repo", F.col("repo") + 100)))


@query(
    "assume_present",
    duck(["heads", "edges", "ranked", "commits"], REACH + """, revs AS (SELECT h.oid AS range_id, h.cust, c.id AS oid FROM heads h JOIN commits c ON c.cust = h.cust)
    SELECT range_id, revs.oid AS pos, revs.oid FROM revs JOIN reach ON start = range_id AND node = revs.oid LEFT JOIN ranked r ON r.cust = revs.cust AND r.r = 3 WHERE r.id IS NULL OR r.id <> revs.oid""", True),
)
def assume_present(spark, sf):
    heads = view(spark, sf, "heads")
    third = view(spark, sf, "ranked").where("r = 3").select("cust", F.col("id").alias("base"))
    tips = heads.join(third, "cust", "left").select(F.col("oid").alias("range_id"), F.col("oid").alias("tip"), "base")
    revs = heads.select("cust", F.col("oid").alias("range_id")).join(view(spark, sf, "commits").select("cust", F.col("id").alias("oid")), "cust").select("range_id", F.col("oid").alias("pos"), "oid")
    twice = revs.unionByName(revs.withColumn("pos", F.col("pos") + 1_000_000_000))
    return H.assume_present(twice, tips, view(spark, sf, "edges"))


# Each package is received by two repositories that lack commits of their own: those whose id 50, or 30, divides.
LACKING = """+ here AS (SELECT repo + s AS repo, id FROM commits, unnest([0, 100]) t(s) WHERE id % (CASE s WHEN 0 THEN 50 ELSE 30 END) <> 0), pre AS (SELECT repo AS bundle_id, id AS oid FROM commits WHERE id % 40 = 0),
    tips AS (SELECT bundle_id, bundle_id + s AS repo, oid FROM heads, unnest([0, 100]) t(s)),
    c(bundle_id, repo, side, oid) AS (SELECT bundle_id, tips.repo, 'tip', oid FROM tips JOIN here ON here.repo = tips.repo AND here.id = oid UNION SELECT bundle_id, h.repo, 'pre', oid FROM pre JOIN here h ON h.id = oid AND h.repo % 100 = bundle_id
      UNION SELECT c.bundle_id, c.repo, c.side, e.parent FROM c JOIN edges e ON e.child = c.oid JOIN here h ON h.id = e.parent AND h.repo = c.repo),
    walked AS (SELECT bundle_id, repo, oid FROM c WHERE side = 'tip' EXCEPT SELECT bundle_id, repo, oid FROM c WHERE side = 'pre'),
    lost AS (SELECT bundle_id, repo, 'head' AS kind, oid FROM tips WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.repo = tips.repo AND h.id = oid)
      UNION ALL SELECT DISTINCT w.bundle_id, w.repo, 'parent', e.parent FROM walked w JOIN edges e ON e.child = w.oid WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.repo = w.repo AND h.id = e.parent) AND (w.bundle_id, e.parent) NOT IN (SELECT (bundle_id, oid) FROM pre))"""


def _lacking(spark, sf):
    commits, heads = view(spark, sf, "commits"), view(spark, sf, "heads")
    twice = lambda rows, c: rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(100)))).withColumn("repo", F.col(c) + F.col("s"))
    here = twice(commits, "repo").where(F.col("id") % F.when(F.col("s") == 0, 50).otherwise(30) != 0)
    prereqs = commits.where("id % 40 = 0").select(F.col("repo").alias("bundle_id"), F.col("id").alias("oid"))
    return H.dangling(twice(heads, "bundle_id").select("bundle_id", "repo", "oid"), prereqs, here, view(spark, sf, "edges"))


@query("dangling", duck(["heads", "edges", "commits"], LACKING + " SELECT * FROM lost", True))
def dangling(spark, sf):
    return _lacking(spark, sf)


@query("needed_by", duck(["heads", "edges", "commits"], LACKING + """, first(bundle_id, oid, k) AS (SELECT bundle_id, oid, head_index FROM heads UNION SELECT f.bundle_id, e.parent, k FROM first f JOIN edges e ON e.child = f.oid),
    least AS (SELECT bundle_id, oid, min(k) AS k FROM first GROUP BY ALL)
    SELECT lost.*, reference FROM lost JOIN least l ON l.bundle_id = lost.bundle_id AND l.oid = lost.oid JOIN heads h ON h.bundle_id = lost.bundle_id AND h.head_index = l.k""", True))
def needed_by(spark, sf):
    """Which head needs each commit that a repository lacks."""
    return H.needed_by(_lacking(spark, sf), view(spark, sf, "heads"), view(spark, sf, "edges"))


@query(
    "resolve_refs",
    duck(["heads"], "SELECT bundle_id AS repo, concat('refs/', k, '/', cust) AS ref_name, CASE WHEN k = 'tag' THEN concat('t', oid) WHEN k = 'lost' THEN NULL ELSE oid::varchar END AS target_oid, CASE WHEN k <> 'lost' THEN oid::varchar END AS commit_oid, NULL AS error FROM heads, unnest(['plain', 'sym', 'deep', 'tag', 'lost']) t(k)"),
)
def resolve_refs(spark, sf):
    h = view(spark, sf, "heads").select(F.col("bundle_id").alias("repo"), "cust", F.col("oid").cast("string").alias("o"))
    name = lambda k: F.concat(F.lit(f"refs/{k}/"), "cust")
    none = F.lit(None).cast("string")
    row = lambda k, oid, sym: h.select("repo", name(k).alias("ref_name"), oid.alias("target_oid"), sym.alias("symbolic_target"))
    refs = row("plain", F.col("o"), none).unionByName(row("sym", none, name("plain"))).unionByName(row("deep", none, name("sym"))).unionByName(row("tag", F.concat(F.lit("t"), "o"), none)).unionByName(row("lost", none, name("nowhere")))
    tags = h.select(F.concat(F.lit("t"), "o").alias("oid"), F.concat(F.lit("u"), "o").alias("target_oid")).unionByName(h.select(F.concat(F.lit("u"), "o"), F.col("o")).toDF("oid", "target_oid"))
    return H.resolve_refs(refs, tags, view(spark, sf, "commits"))


@query("range_labels", duck(["all_heads"], """SELECT bundle_id, CASE WHEN count(*) FILTER (cust % 100 = 1) = 0 THEN '-' WHEN count(*) FILTER (cust % 100 = 1) = 1 THEN min(oid) FILTER (cust % 100 = 1)::varchar ELSE concat('multiple prerequisites (', count(*) FILTER (cust % 100 = 1), ')') END AS range_start,
  CASE WHEN count(*) FILTER (cust % 10 = 1) = 0 THEN '-' WHEN count(*) FILTER (cust % 10 = 1) = 1 THEN min(oid) FILTER (cust % 10 = 1)::varchar ELSE concat('multiple heads (', count(*) FILTER (cust % 10 = 1), ')') END AS range_end FROM all_heads GROUP BY bundle_id"""))
def range_labels(spark, sf):
    rows = view(spark, sf, "all_heads")
    return H.range_labels(rows.select("bundle_id").distinct(), rows.where("cust % 100 = 1"), rows.where("cust % 10 = 1"))


@query("commit_entries", duck(["commits"], "SELECT id, CASE WHEN id % 4 = 0 THEN '<no subject>' ELSE message END AS subject, CASE WHEN id % 5 = 0 THEN '<no message>' ELSE message END AS message, CASE WHEN id % 6 = 0 THEN '<unknown>' ELSE concat('c', cust) END AS author FROM commits"))
def commit_entries(spark, sf):
    c = view(spark, sf, "commits").select("id", F.when(F.col("id") % 4 != 0, F.col("message")).alias("subject"), F.when(F.col("id") % 5 == 0, "  ").otherwise(F.concat("message", F.lit("  "))).alias("message"), F.when(F.col("id") % 6 == 0, "").otherwise(F.concat(F.lit("c"), "cust")).alias("author"))
    return H.commit_entries(c)


@query(
    "head_base",
    duck(["heads", "edges"], REACH + """, pre AS (SELECT bundle_id, parent AS oid FROM heads JOIN edges ON child = oid AND parent_index = 0 WHERE bundle_id % 3 <> 0 AND (bundle_id % 3 = 2 OR cust = (SELECT min(cust) FROM heads x WHERE x.bundle_id = heads.bundle_id AND x.oid IN (SELECT child FROM edges)))),
    per AS (SELECT bundle_id, count(*) AS n, min(oid) AS only_one FROM pre GROUP BY 1),
    hits AS (SELECT h.bundle_id, h.oid, count(*) AS hits, min(node) AS hit FROM heads h JOIN reach ON start = h.oid JOIN pre ON pre.bundle_id = h.bundle_id AND pre.oid = node GROUP BY ALL)
    SELECT h.bundle_id, h.oid, CASE WHEN n IS NULL THEN e.parent WHEN n = 1 THEN only_one WHEN hits = 1 THEN hit END AS base_oid,
      CASE WHEN n > 1 AND hits IS NULL THEN 'no prerequisite is an ancestor' WHEN n > 1 AND hits > 1 THEN 'several prerequisites are ancestors' END AS error
    FROM heads h LEFT JOIN per USING (bundle_id) LEFT JOIN edges e ON e.child = h.oid AND e.parent_index = 0 LEFT JOIN hits ON hits.bundle_id = h.bundle_id AND hits.oid = h.oid""", True),
)
def head_base(spark, sf):
    heads, edges = view(spark, sf, "heads"), view(spark, sf, "edges")
    own = heads.join(edges.where("parent_index = 0").select(F.col("child").alias("oid"), "parent"), "oid").where("bundle_id % 3 <> 0")
    least = own.groupBy("bundle_id").agg(F.min("cust").alias("least"))
    pre = own.join(least, "bundle_id").where("bundle_id % 3 = 2 or cust = least").select("bundle_id", F.col("parent").alias("oid"))
    return H.head_base(heads, pre, edges).select("bundle_id", "oid", "base_oid", "error")


# Receiving


@query("incoming_refs", duck(["heads"], "SELECT bundle_id, reference, " + ", ".join(f"concat('refs/{k}/', bundle_id, '/', substr(reference, 6)) AS {n}" for k, n in (("sync/incoming", "incoming_ref"), ("heads/incoming", "branch_ref"), ("sync/merge-test", "merge_test_ref"), ("sync/fetch-staging", "staging_ref"))) + " FROM heads"))
def incoming_refs(spark, sf):
    return R.incoming_refs(view(spark, sf, "heads").select("bundle_id", "reference"))


def _plan(spark, sf):
    rows = _pairs(spark, sf).select(F.col("repo").alias("bundle_id"), "cust", "target_ref", "target", "incoming")
    plan = R.receive_plan(rows, view(spark, sf, "commits"), view(spark, sf, "edges"))
    k = F.col("cust") % 3
    merge = plan.where("cust % 7 <> 0").select("bundle_id", "target_ref", F.when(k == 0, "clean").when(k == 1, "conflicted").otherwise("unknown").alias("status"))
    return plan, merge


@query("receive_plan", duck(_V, PLAN + " SELECT bundle_id, cust, target_ref, target, incoming, merge_base, status FROM plan", True))
def receive_plan(spark, sf):
    return _plan(spark, sf)[0]


@query("plan_summary", duck(_V, PLAN + " SELECT bundle_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.STATUSES) + ", count(*) AS total FROM plan GROUP BY bundle_id", True))
def plan_summary(spark, sf):
    return R.plan_summary(_plan(spark, sf)[0])


UPDATES = """+ refs AS (SELECT repo, target_ref AS ref_name, target::varchar AS oid FROM pairs WHERE target IS NOT NULL),
updates AS (SELECT repo AS bundle_id, repo, target_ref AS ref_name, CASE WHEN cust % 41 = 0 AND repo % 3 = 0 THEN 'stale' ELSE target::varchar END AS expected_old, incoming::varchar AS new_oid FROM pairs),
checked AS (SELECT u.*, r.oid, r.oid IS NOT DISTINCT FROM expected_old AS holds FROM updates u LEFT JOIN refs r USING (repo, ref_name)),
good AS (SELECT repo, ref_name, new_oid FROM checked WHERE bundle_id NOT IN (SELECT bundle_id FROM checked WHERE NOT holds))"""


def _updates(spark, sf):
    p = _pairs(spark, sf)
    refs = p.where("target is not null").select("repo", F.col("target_ref").alias("ref_name"), F.col("target").cast("string").alias("oid"))
    updates = p.select(F.col("repo").alias("bundle_id"), "repo", F.col("target_ref").alias("ref_name"), F.when((F.col("cust") % 41 == 0) & (F.col("repo") % 3 == 0), "stale").otherwise(F.col("target").cast("string")).alias("expected_old"), F.col("incoming").cast("string").alias("new_oid"))
    return refs, updates


@query("apply_updates", duck(["pairs"], UPDATES + " SELECT coalesce(r.repo, g.repo) AS repo, coalesce(r.ref_name, g.ref_name) AS ref_name, coalesce(new_oid, oid) AS oid FROM refs r FULL JOIN good g ON g.repo = r.repo AND g.ref_name = r.ref_name"))
def apply_updates(spark, sf):
    return R.apply_updates(*_updates(spark, sf))[0]


@query("failed_updates", duck(["pairs"], UPDATES + " SELECT bundle_id, repo, ref_name, expected_old, oid AS actual FROM checked WHERE NOT holds"))
def failed_updates(spark, sf):
    return R.apply_updates(*_updates(spark, sf))[1]


AFTER = UPDATES + """, after AS (SELECT coalesce(r.repo, g.repo) AS repo, coalesce(r.ref_name, g.ref_name) AS ref_name, coalesce(new_oid, oid) AS oid FROM refs r FULL JOIN good g ON g.repo = r.repo AND g.ref_name = r.ref_name)"""


@query("roll_back", duck(["pairs"], AFTER + """
  SELECT bundle_id, u.repo, u.ref_name, CASE WHEN a.oid IS DISTINCT FROM new_oid THEN 'untouched' WHEN expected_old IS NULL THEN 'deleted' ELSE 'restored' END AS outcome, 'update' AS stage,
    CASE WHEN a.oid IS DISTINCT FROM new_oid THEN concat('ref is at ', coalesce(a.oid, 'none'), ', not at the applied ', new_oid) END AS reason FROM updates u LEFT JOIN after a ON a.repo = u.repo AND a.ref_name = u.ref_name"""))
def roll_back(spark, sf):
    refs, updates = _updates(spark, sf)
    return R.roll_back(R.apply_updates(refs, updates)[0], updates)[1]


@query("rolled_back_refs", duck(["pairs"], AFTER + """, undone AS (SELECT u.repo, u.ref_name, u.expected_old FROM updates u JOIN after a ON a.repo = u.repo AND a.ref_name = u.ref_name AND a.oid = new_oid)
  SELECT a.repo, a.ref_name, CASE WHEN u.ref_name IS NULL THEN a.oid ELSE u.expected_old END AS oid FROM after a LEFT JOIN undone u ON u.repo = a.repo AND u.ref_name = a.ref_name WHERE u.ref_name IS NULL OR u.expected_old IS NOT NULL"""))
def rolled_back_refs(spark, sf):
    refs, updates = _updates(spark, sf)
    return R.roll_back(R.apply_updates(refs, updates)[0], updates)[0]


@query("plan_targets", duck(_V, PLAN + " SELECT bundle_id, target_ref, CASE WHEN target IS NOT NULL THEN concat(CASE WHEN cust % 2 = 0 THEN 't' ELSE '' END, target) END AS target_oid, target::varchar AS target, incoming::varchar AS incoming, merge_base::varchar AS merge_base, status FROM plan", True))
def plan_targets(spark, sf):
    """The plan from refs as they are: half of them name a tag of their commit."""
    p = _pairs(spark, sf)
    text = lambda c: F.col(c).cast("string")
    there = p.where("target is not null")
    refs = there.select("repo", F.col("target_ref").alias("ref_name"), F.when(F.col("cust") % 2 == 0, F.concat(F.lit("t"), text("target"))).otherwise(text("target")).alias("target_oid"), F.lit(None).cast("string").alias("symbolic_target"))
    tags = there.select(F.concat(F.lit("t"), text("target")).alias("oid"), text("target").alias("target_oid")).distinct()
    resolved = H.resolve_refs(refs, tags, view(spark, sf, "commits"))
    incoming = R.with_targets(p.select(F.col("repo").alias("bundle_id"), "repo", "target_ref", "incoming"), resolved).withColumn("target", F.col("target").cast("long"))
    plan = R.receive_plan(incoming, view(spark, sf, "commits"), view(spark, sf, "edges"))
    return plan.select("bundle_id", "target_ref", "target_oid", text("target").alias("target"), text("incoming").alias("incoming"), text("merge_base").alias("merge_base"), "status")


@query("already_applied", duck(["all_heads", "pairs"], """+ r AS (SELECT repo + s AS repo, target_ref, CASE WHEN s = 0 THEN target ELSE incoming END AS now FROM pairs, unnest([0, 100]) t(s))
  SELECT bundle_id, bundle_id + s AS repo, bool_and(coalesce(now = oid, false) AND (s = 0 OR bundle_id % 2 = 0 OR oid % 7 <> 0)) AS applied FROM all_heads, unnest([0, 100]) t(s) LEFT JOIN r ON target_ref = reference AND r.repo = bundle_id + s GROUP BY ALL"""))
def already_applied(spark, sf):
    """Two repositories with refs of the same names: what the pairs name as their target, and as incoming; of the second, half lack commits."""
    p, heads, commits = _pairs(spark, sf), view(spark, sf, "all_heads"), view(spark, sf, "commits").select("repo", "id")
    refs = p.select("repo", F.col("target_ref").alias("ref_name"), F.col("target").alias("oid")).unionByName(p.select((F.col("repo") + 100).alias("repo"), F.col("target_ref").alias("ref_name"), F.col("incoming").alias("oid")))
    here = commits.unionByName(commits.where("repo % 2 = 0 or id % 7 <> 0").withColumn("repo", F.col("repo") + 100))
    asked = heads.withColumn("repo", F.explode(F.array("bundle_id", F.col("bundle_id") + 100)))
    return R.already_applied(asked, refs, here)


@query("plan_actions", duck(_V, PLAN + """ SELECT bundle_id, target_ref, status, CASE WHEN status IN ('target_missing', 'fast_forward_ok') THEN concat('would update ', target_ref, ' from ', coalesce(substr(target::varchar, 1, 12), '-'), ' to ', substr(incoming::varchar, 1, 12), ' (merge policy; no merge commit needed)')
  WHEN status = 'already_present' THEN concat('would keep ', target_ref, ' unchanged (already up to date)') WHEN status = 'target_ahead' THEN concat('would keep ', target_ref, ' unchanged (target already ahead; merge commit not needed)')
  ELSE concat('would merge ', target_ref, ' with incoming head (merge policy)') END AS action FROM plan""", True))
def plan_actions(spark, sf):
    return R.plan_actions(_plan(spark, sf)[0], "merge", True)


@query("duplicate_tips", duck(["pairs"], "SELECT repo AS bundle_id, target_ref, incoming // 8 AS oid, count(*) OVER (PARTITION BY repo, incoming // 8) AS n_same, count(*) OVER (PARTITION BY repo, incoming // 8) > 1 AS duplicate FROM pairs"))
def duplicate_tips(spark, sf):
    return R.duplicate_tips(_pairs(spark, sf).select(F.col("repo").alias("bundle_id"), "target_ref", F.expr("incoming div 8").alias("oid")))


@query("no_heads", duck(["all_heads"], "SELECT DISTINCT bundle_id FROM all_heads WHERE bundle_id NOT IN (SELECT bundle_id FROM all_heads WHERE cust % 50 = 1)"))
def no_heads(spark, sf):
    rows = view(spark, sf, "all_heads")
    return R.no_heads(rows.select("bundle_id").distinct(), rows.where("cust % 50 = 1"))


@query("keep_incoming", duck(["pairs"], """+ names AS (SELECT repo, target_ref, incoming, unnest([concat('refs/sync/incoming/', repo, substr(target_ref, 5)), concat('refs/heads/incoming/', repo, substr(target_ref, 5))]) AS ref_name FROM pairs WHERE repo % 4 <> 1)
  SELECT repo, target_ref AS ref_name, target AS oid FROM pairs WHERE target IS NOT NULL UNION ALL SELECT repo, ref_name, incoming FROM names
  UNION ALL SELECT repo, concat('refs/sync/incoming/', repo, substr(target_ref, 5)), 0 FROM pairs WHERE cust % 3 = 0 AND repo % 4 = 1"""))
def keep_incoming(spark, sf):
    """Incoming names and branch mirrors, some already set; packages of every fourth repository are only analysed."""
    p = _pairs(spark, sf)
    incoming = R.incoming_refs(p.select(F.col("repo").alias("bundle_id"), "repo", F.col("target_ref").alias("reference"), F.col("incoming").alias("oid"), "cust"))
    refs = p.where("target is not null").select("repo", F.col("target_ref").alias("ref_name"), F.col("target").alias("oid"))
    old = incoming.where("cust % 3 = 0").select("repo", F.col("incoming_ref").alias("ref_name"), F.lit(0).cast("long").alias("oid"))
    analysed = p.where("repo % 4 = 1").select(F.col("repo").alias("bundle_id"), "repo").distinct()
    return R.keep_incoming(refs.unionByName(old), incoming, True, analysed)


MERGE = """+ m AS (SELECT *, CASE WHEN ours IS NOT DISTINCT FROM theirs THEN 'same' WHEN base IS NOT DISTINCT FROM ours THEN 'take-theirs' WHEN base IS NOT DISTINCT FROM theirs THEN 'take-ours' WHEN base IS NULL THEN 'add/add'
  WHEN ours IS NULL OR theirs IS NULL THEN 'modify/delete' ELSE 'both-modified' END AS kind FROM merge_input)"""


@query("merge_paths", duck(["merge_input"], MERGE + " SELECT doc_id, kind, sha256(CASE WHEN kind IN ('same', 'take-ours') THEN ours WHEN kind = 'take-theirs' THEN theirs END) AS merged FROM m"))
def merge_paths(spark, sf):
    return R.merge_paths(view(spark, sf, "merge_input")).select("doc_id", "kind", F.sha2(F.col("merged").cast("binary"), 256).alias("merged"))


@query("mergeability", duck(["merge_input"], MERGE + " SELECT bundle_id, CASE WHEN count(*) FILTER (kind IN ('add/add', 'modify/delete', 'both-modified')) > 0 THEN 'conflicted' ELSE 'clean' END AS status, coalesce(array_to_string(list_sort(list(path) FILTER (kind IN ('add/add', 'modify/delete', 'both-modified'))), ','), '') AS conflict_paths FROM m GROUP BY bundle_id"))
def mergeability(spark, sf):
    return R.mergeability(R.merge_paths(view(spark, sf, "merge_input"))).withColumn("conflict_paths", F.concat_ws(",", "conflict_paths"))
