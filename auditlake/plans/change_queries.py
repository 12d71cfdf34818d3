"""Queries on what commits change: renames, line counts, patches, and on merging three snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import history as H
from auditlake.operators import lines as L
from auditlake.operators import receive as R
from auditlake.operators import snapshot as S
from auditlake.operators.iterate import checkpointed
from auditlake.plans.registry import query
from auditlake.plans.views import alike, duck, view

_REV = ["rev_files", "rev_pairs", "rev_commits"]


def _lines(t: str) -> str:
    return f"(length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN {t} = '' OR substr({t}, -1) = chr(10) THEN 0 ELSE 1 END)"


def _pieces(t: str) -> str:
    """Lines with their newlines, the last without one if it has none."""
    return f"list_filter(list_concat(list_transform(string_split({t}, chr(10))[:-2], lambda x: concat(x, chr(10))), string_split({t}, chr(10))[-1:]), lambda x: x <> '')"


# Equal contents are numbered by path on either side and paired; what is left is paired by likeness. M rows change as the view
# edits texts; the lines of an R row are counted as sets, which tells a script's length as long as common lines keep their order.
CHANGES = f"""+ old AS (SELECT pair, what, f.* FROM rev_pairs p JOIN rev_files f ON f.commit = old_commit), new AS (SELECT pair, what, f.* FROM rev_pairs p JOIN rev_files f ON f.commit = new_commit),
diff AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.what, b.what) AS what, coalesce(a.path, b.path) AS path, a.path AS old_path, a.oid AS old_oid, b.oid AS new_oid, a.mode AS old_mode, b.mode AS new_mode, a.text AS old_text, b.text AS new_text, b.commit AS new_commit, coalesce(a.doc_id, b.doc_id) AS doc_id,
  CASE WHEN a.oid IS NULL THEN 'A' WHEN b.oid IS NULL THEN 'D' WHEN (a.mode = '120000') <> (b.mode = '120000') THEN 'T' WHEN a.oid <> b.oid OR a.mode <> b.mode THEN 'M' ELSE '=' END AS status FROM old a FULL JOIN new b ON a.pair = b.pair AND a.path = b.path),
d AS (SELECT *, row_number() OVER (PARTITION BY pair, old_oid ORDER BY path) AS n FROM diff WHERE status = 'D'), a AS (SELECT *, row_number() OVER (PARTITION BY pair, new_oid ORDER BY path) AS n FROM diff WHERE status = 'A'),
same AS (SELECT d.pair, d.path AS gone, a.path FROM d JOIN a ON a.pair = d.pair AND a.new_oid = d.old_oid AND a.n = d.n),
left_d AS (SELECT pair, path, old_text AS text FROM d WHERE old_mode <> '120000' AND NOT contains(old_text, chr(0)) AND NOT EXISTS (SELECT 1 FROM same WHERE same.pair = d.pair AND same.gone = d.path)),
left_a AS (SELECT pair, path, new_text AS text FROM a WHERE new_mode <> '120000' AND NOT contains(new_text, chr(0)) AND NOT EXISTS (SELECT 1 FROM same WHERE same.pair = a.pair AND same.path = a.path)),
{alike("left_d", "left_a", "near")},
r AS (SELECT a.pair, a.what, a.path, d.path AS old_path, d.old_oid, a.new_oid, d.old_mode, a.new_mode, d.old_text, a.new_text, 'R' AS status, a.doc_id FROM (SELECT pair, gone, path FROM same UNION ALL SELECT pair, gone, path FROM near) m JOIN d ON d.pair = m.pair AND d.path = m.gone JOIN a ON a.pair = m.pair AND a.path = m.path),
changes AS (SELECT pair, what, status, path, old_path, old_oid, new_oid, old_mode, new_mode, old_text, new_text, doc_id FROM diff x WHERE status <> '=' AND NOT (status = 'D' AND EXISTS (SELECT 1 FROM r WHERE r.pair = x.pair AND r.old_path = x.path)) AND NOT (status = 'A' AND EXISTS (SELECT 1 FROM r WHERE r.pair = x.pair AND r.path = x.path))
  UNION ALL SELECT pair, what, status, path, old_path, old_oid, new_oid, old_mode, new_mode, old_text, new_text, doc_id FROM r),
told AS (SELECT *, coalesce(old_mode = '120000', false) OR coalesce(new_mode = '120000', false) OR coalesce(contains(old_text, chr(0)), false) OR coalesce(contains(new_text, chr(0)), false) AS non_text, pair LIKE '%/r3' AS third, pair LIKE '%#1' OR pair LIKE '%/r2' AS second FROM changes),
kept AS (SELECT pair, path, sum(least(o.n, w.n)) AS kept FROM (SELECT pair, path, line, count(*) AS n FROM (SELECT pair, path, unnest({_pieces("old_text")}) AS line FROM r WHERE old_oid <> new_oid) GROUP BY ALL) o
  JOIN (SELECT pair, path, line, count(*) AS n FROM (SELECT pair, path, unnest({_pieces("new_text")}) AS line FROM r WHERE old_oid <> new_oid) GROUP BY ALL) w USING (pair, path, line) GROUP BY ALL),
stats AS (SELECT told.*,
  CASE WHEN non_text OR status = 'D' THEN 0 WHEN status = 'A' THEN {_lines("new_text")} WHEN status = 'R' THEN CASE WHEN old_oid = new_oid THEN 0 ELSE {_lines("new_text")} - kept END
    ELSE (CASE WHEN NOT third AND doc_id % 5 IN (0, 1) THEN 1 ELSE 0 END) + (CASE WHEN NOT second AND doc_id % 3 = 0 THEN 1 ELSE 0 END) END::bigint AS additions,
  CASE WHEN non_text OR status = 'A' THEN 0 WHEN status = 'D' THEN {_lines("old_text")} WHEN status = 'R' THEN CASE WHEN old_oid = new_oid THEN 0 ELSE {_lines("old_text")} - kept END
    ELSE CASE WHEN NOT third AND doc_id % 5 IN (1, 2) AND old_text <> '' THEN 1 ELSE 0 END END::bigint AS deletions FROM told LEFT JOIN kept USING (pair, path))"""


def _changes(spark, sf, what):
    pairs = view(spark, sf, "rev_pairs").where(F.col("what") == what).select("pair", "old_commit", "new_commit")
    return S.changed_texts(pairs, view(spark, sf, "rev_files"))


def _firsts(spark, sf):
    return view(spark, sf, "rev_commits").select("id", "first_parent")


def _head_list(spark, sf):
    c = view(spark, sf, "rev_commits").where("n > 1")
    return c.select("bundle_id", (F.col("n") - 2).alias("head_index"), F.col("id").alias("oid"), F.concat("bundle_id", F.lit("/r1")).alias("base_oid"))


@query("renamed_files", duck(_REV, CHANGES + " SELECT pair AS commit, status, path, old_path, old_oid, new_oid, old_mode, new_mode FROM changes WHERE what = 'commit'"))
def renamed_files(spark, sf):
    """Each commit's changes with renames, all commits at once."""
    return _changes(spark, sf, "commit").select(F.col("pair").alias("commit"), "status", "path", "old_path", "old_oid", "new_oid", "old_mode", "new_mode")


@query("commit_line_stats", duck(_REV, CHANGES + " SELECT pair AS commit, path, additions, deletions FROM stats WHERE what = 'commit'"))
def commit_line_stats(spark, sf):
    return S.commit_line_stats(_firsts(spark, sf), view(spark, sf, "rev_files"))


@query("head_line_stats", duck(_REV, CHANGES + " SELECT split_part(pair, '#', 1) AS bundle_id, split_part(pair, '#', 2)::int - 1 AS head_index, path, additions, deletions FROM stats WHERE what = 'head'").replace("concat(bundle_id, '#', n - 2)", "concat(bundle_id, '#', n - 1)"))
def head_line_stats(spark, sf):
    return S.head_line_stats(_head_list(spark, sf), view(spark, sf, "rev_files"))


@query("bundle_line_stats", duck(_REV, CHANGES + " SELECT split_part(pair, '#', 1) AS bundle_id, path, sum(additions) AS additions, sum(deletions) AS deletions FROM stats WHERE what = 'head' GROUP BY ALL").replace("concat(bundle_id, '#', n - 2)", "concat(bundle_id, '#', n - 1)"))
def bundle_line_stats(spark, sf):
    return S.bundle_line_stats(S.head_line_stats(_head_list(spark, sf), view(spark, sf, "rev_files")))


@query("line_counts", duck(["line_pairs"], "SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN (old_text <> new_text)::int WHEN 3 THEN 0 ELSE 1 END AS additions, CASE doc_id % 4 WHEN 1 THEN (lines > 0)::int WHEN 2 THEN (old_text <> new_text)::int ELSE 0 END AS deletions FROM line_pairs"))
def line_counts(spark, sf):
    """A line put before a text, its first line replaced, or moved to the end, which takes a longest common subsequence to tell."""
    return L.line_counts(view(spark, sf, "line_pairs").select("doc_id", "old_text", "new_text")).select("doc_id", "additions", "deletions")


# Patches


def _patches(spark, sf):
    rows = L.patches(_changes(spark, sf, "commit")).where("not non_text")
    return rows.select(F.col("pair").alias("commit"), F.split_part("pair", F.lit("/"), F.lit(1)).alias("bundle_id"), "path", "patch")


def _patch_lines(spark, sf):
    lines = F.split("patch", "\n")
    return _patches(spark, sf).select(F.struct("commit", "path").alias("patch_id"), F.posexplode(F.slice(lines, 1, F.size(lines) - 1)).alias("pos", "line"))


def _marked(t: str, sign: str) -> str:
    return f"len(regexp_extract_all({t}, '(?m)^{sign}'))"


PATCHED = CHANGES + f""", p AS (SELECT *, {_lines('old_text')} AS old_n, {_lines('new_text')} AS new_n,
  additions - (CASE WHEN status = 'A' THEN {_marked('new_text', '[+][+]')} ELSE 0 END) AS added,
  deletions - (CASE WHEN status = 'D' THEN {_marked('old_text', '--')} WHEN status IN ('M', 'R') AND deletions > 0 AND starts_with(old_text, '--') THEN 1 ELSE 0 END) AS deleted,
  CASE WHEN status IN ('M', 'R') AND additions + deletions > 0 THEN least(3, {_lines('old_text')} - deletions) ELSE 0 END AS context FROM stats WHERE what = 'commit' AND NOT non_text)"""


@query("patches", None)
def patches(spark, sf):
    return _patches(spark, sf)


@query("classify_patch", duck(_REV, PATCHED + " SELECT pair AS commit, path, added, deleted, context, (additions + deletions > 0)::int AS hunks FROM p"))
def classify_patch(spark, sf):
    """Lines of each kind of every patch."""
    n = lambda k: F.count_if(F.col("kind") == k)
    kinds = _patch_lines(spark, sf).withColumn("kind", S.line_kind())
    return kinds.groupBy("patch_id").agg(n("added").alias("added"), n("deleted").alias("deleted"), n("context").alias("context"), n("hunk").alias("hunks")).select("patch_id.*", "added", "deleted", "context", "hunks")


@query("hunk_starts", duck(_REV, PATCHED + " SELECT pair AS commit, path, CASE WHEN status = 'A' OR old_n = 0 THEN 0 ELSE 1 END AS old_start, CASE WHEN status = 'D' OR new_n = 0 THEN 0 ELSE 1 END AS new_start FROM p WHERE additions + deletions > 0"))
def hunk_starts(spark, sf):
    return _patch_lines(spark, sf).withColumn("s", S.hunk_starts()).where("s is not null").select("patch_id.*", "s.old_start", "s.new_start")


@query("number_patch", duck(_REV, PATCHED + " SELECT pair AS commit, path, added + context AS new_lines, deleted + context AS old_lines, CASE WHEN added + context > 0 THEN 1 END AS first_new, CASE WHEN deleted + context > 0 THEN 1 END AS first_old, CASE WHEN added + context > 0 THEN added + context END AS last_new FROM p"))
def number_patch(spark, sf):
    """How many lines of each patch have numbers, and the first and last of them."""
    rows = S.number_patch(_patch_lines(spark, sf)).groupBy("patch_id")
    return rows.agg(F.count("new_line").alias("new_lines"), F.count("old_line").alias("old_lines"), F.min("new_line").alias("first_new"), F.min("old_line").alias("first_old"), F.max("new_line").alias("last_new")).select("patch_id.*", "new_lines", "old_lines", "first_new", "first_old", "last_new")


@query("patch_sidecar", None)
def patch_sidecar(spark, sf):
    rows = _patches(spark, sf)
    return S.patch_sidecar(rows.withColumn("path", F.concat_ws(":", "commit", "path")))


@query("find_change", duck(_REV, CHANGES + """, named AS (SELECT pair, unnest(list_distinct([path, old_path])) AS want, status, path, non_text FROM told WHERE what = 'commit'),
  asked AS (SELECT DISTINCT c.id AS commit, f.path AS want FROM rev_commits c JOIN rev_files f ON f.bundle_id = c.bundle_id),
  best AS (SELECT pair, want, arg_min(struct_pack(status, path, non_text), ((path <> want)::int, path)) AS c FROM named WHERE want IS NOT NULL GROUP BY ALL)
  SELECT commit, asked.want, c.status, c.path, CASE WHEN c IS NULL THEN 'not-changed' WHEN c.non_text THEN 'non-text' ELSE 'text' END AS outcome FROM asked LEFT JOIN best ON best.pair = commit AND best.want = asked.want"""))
def find_change(spark, sf):
    """Every commit asked for every path of its bundle, by new and old names."""
    diffs = _changes(spark, sf, "commit").select(F.col("pair").alias("commit"), "status", "path", "old_path", F.col("non_text").alias("is_non_text"))
    asked = view(spark, sf, "rev_commits").select("bundle_id", F.col("id").alias("commit")).join(view(spark, sf, "rev_files").select("bundle_id", F.col("path").alias("want")).distinct(), "bundle_id")
    return S.find_change(asked.select("commit", "want"), diffs)


# Commit chains and audits


def _rev_edges(spark, sf):
    return _firsts(spark, sf).where("first_parent is not null").select(F.col("id").alias("child"), F.col("first_parent").alias("parent"), F.lit(0).alias("parent_index"))


def _rev_graph(spark, sf):
    return view(spark, sf, "rev_commits").select("id", F.col("bundle_id").alias("repo"), F.col("n").alias("time"), "tree_oid", "subject", "message", "author")


@query("commit_chain", duck(["rev_commits"], "SELECT bundle_id AS range_id, n - 2 AS position, id AS oid, tree_oid, first_parent AS parents, subject, author, author AS committer FROM rev_commits WHERE n > 1"))
def commit_chain(spark, sf):
    c = view(spark, sf, "rev_commits")
    ranges = c.where("n = 3").select(F.col("bundle_id").alias("range_id"), F.col("id").alias("tip"), F.concat("bundle_id", F.lit("/r1")).alias("hidden"))
    chain = H.commit_chain(ranges, _rev_graph(spark, sf).withColumn("committer", F.col("author")), _rev_edges(spark, sf))
    return chain.select("range_id", "position", "oid", "tree_oid", F.concat_ws(",", "parent_oids").alias("parents"), "subject", "author", "committer")


@query("head_entries", duck(_REV, CHANGES + """, h AS (SELECT bundle_id, n - 2 AS head_index, n FROM rev_commits WHERE n > 1)
  SELECT h.bundle_id, head_index, c.n - 2 AS position, c.id, c.subject, count(s.path) AS files, coalesce(sum(additions), 0) AS additions, coalesce(sum(deletions), 0) AS deletions
  FROM h JOIN rev_commits c ON c.bundle_id = h.bundle_id AND c.n > 1 AND c.n <= h.n LEFT JOIN stats s ON s.what = 'commit' AND s.pair = c.id GROUP BY ALL"""))
def head_entries(spark, sf):
    rows = H.head_entries(_head_list(spark, sf), _rev_graph(spark, sf), _rev_edges(spark, sf), S.commit_line_stats(_firsts(spark, sf), view(spark, sf, "rev_files")))
    total = lambda c: F.coalesce(F.aggregate("files", F.lit(0).cast("long"), lambda s, x: s + x[c]), F.lit(0)).alias(c)
    return rows.select("bundle_id", "head_index", "position", "id", "subject", F.size("files").alias("files"), total("additions"), total("deletions"))


# Merging

_FORK = ["forked", "fork_refs"]
MERGED = """+ told AS (SELECT *, CASE WHEN ours IS NOT DISTINCT FROM theirs THEN 'same' WHEN base IS NOT DISTINCT FROM ours THEN 'take-theirs' WHEN base IS NOT DISTINCT FROM theirs THEN 'take-ours' WHEN base IS NULL THEN 'add/add' WHEN ours IS NULL OR theirs IS NULL THEN 'modify/delete' ELSE 'both-modified' END AS kind FROM forked WHERE base IS NOT NULL OR ours IS NOT NULL OR theirs IS NOT NULL),
resolved AS (SELECT *, kind IN ('add/add', 'modify/delete') OR (kind = 'both-modified' AND (k % 3 = 1 AND doc_id % 5 = 0 AND theirs LIKE '%theirs tail' OR text = '' OR (NOT contains(text, chr(10))))) AS bad,
  CASE WHEN kind IN ('same', 'take-ours') THEN ours WHEN kind = 'take-theirs' THEN theirs ELSE concat('theirs head', chr(10), ours) END AS merged FROM told),
merge AS (SELECT r.bundle_id, r.k, r.target_ref, r.target, r.incoming, CASE WHEN r.k % 3 = 2 THEN 'unknown' WHEN count(*) FILTER (bad) > 0 THEN 'conflicted' ELSE 'clean' END AS status, coalesce(string_agg(path, ',' ORDER BY path) FILTER (bad), '') AS conflict_paths
  FROM fork_refs r LEFT JOIN resolved m ON m.bundle_id = r.bundle_id AND m.k = r.k AND r.k % 3 <> 2 GROUP BY r.bundle_id, r.k, r.target_ref, r.target, r.incoming)"""


def _fork_plan(spark, sf):
    refs = view(spark, sf, "fork_refs").select("bundle_id", "target_ref", "target", "incoming")
    return checkpointed(R.receive_plan(refs, view(spark, sf, "fork_commits").select("id", "repo", "time"), view(spark, sf, "fork_edges")))


def _fork_merge(spark, sf, plan):
    return R.simulate_merges(plan, view(spark, sf, "fork_files"), view(spark, sf, "fork_commits"))


@query("simulate_merges", duck(_FORK, MERGED + """ SELECT bundle_id, target_ref, status, CASE status WHEN 'unknown' THEN 'merge simulation failed: no common ancestor' WHEN 'clean' THEN 'merge simulation completed without conflicts' ELSE 'merge simulation produced index conflicts' END AS detail,
  concat('ours ', k) AS target_subject, concat('theirs ', k) AS incoming_subject, CASE WHEN status <> 'unknown' THEN concat('base ', k) END AS merge_base_subject, conflict_paths FROM merge"""))
def simulate_merges(spark, sf):
    checks, _ = _fork_merge(spark, sf, _fork_plan(spark, sf))
    return checks.select("bundle_id", "target_ref", "status", "detail", "target_subject", "incoming_subject", "merge_base_subject", F.concat_ws(",", "conflict_paths").alias("conflict_paths"))


@query("merged_snapshot", duck(_FORK, MERGED + " SELECT m.bundle_id, target_ref, path, '100644' AS mode, sha1(concat('blob ', strlen(merged), chr(0), merged)) AS oid FROM merge m JOIN resolved r ON r.bundle_id = m.bundle_id AND r.k = m.k WHERE status = 'clean' AND merged IS NOT NULL"))
def merged_snapshot(spark, sf):
    plan = _fork_plan(spark, sf)
    checks, paths = _fork_merge(spark, sf, plan)
    return R.merged_snapshot(checks, paths).select("bundle_id", "target_ref", "path", "mode", "oid")


def _level(name: str, depth: int, more: str = "") -> str:
    """DuckDB view of the trees of directories so many slashes deep, with the ids of trees below them."""
    return f"""{name} AS (SELECT bundle_id, k, dir, sha1(unhex(concat(hex(concat('tree ', strlen(c) // 2)), '00', c))) AS oid FROM (SELECT bundle_id, k, dir, string_agg(concat(hex(concat(mode, ' ', name)), '00', oid), '' ORDER BY CASE mode WHEN '40000' THEN concat(name, '/') ELSE name END) AS c
  FROM (SELECT bundle_id, k, dir, name, '100644' AS mode, oid FROM placed WHERE depth = {depth}{more}) GROUP BY ALL))"""


TREES = MERGED + """, placed AS (SELECT m.bundle_id, r.k, strlen(path) - strlen(replace(path, '/', '')) AS depth, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/?[^/]*$', '') AS dir, sha1(concat('blob ', strlen(merged), chr(0), merged)) AS oid
  FROM merge m JOIN resolved r ON r.bundle_id = m.bundle_id AND r.k = m.k WHERE status = 'clean' AND merged IS NOT NULL),
""" + ",\n".join([_level("t2", 2), _level("t1", 1, " UNION ALL SELECT bundle_id, k, regexp_replace(dir, '/[^/]*$', ''), regexp_extract(dir, '[^/]*$'), '40000', oid FROM t2"), _level("t0", 0, " UNION ALL SELECT bundle_id, k, '', dir, '40000', oid FROM t1")]) + """,
made AS (SELECT m.*, coalesce(t0.oid, '4b825dc642cb6eb9a060e54bf8d69288fbee4904') AS tree_oid, concat('receive merge for ', target_ref, chr(10), chr(10), 'Target: ', target, chr(10), 'Incoming: ', incoming, chr(10)) AS message FROM merge m LEFT JOIN t0 ON t0.bundle_id = m.bundle_id AND t0.k = m.k WHERE status = 'clean'),
stamped AS (SELECT *, concat('tree ', tree_oid, chr(10), 'parent ', target, chr(10), 'parent ', incoming, chr(10), 'author receive <receive@local> 0 +0000', chr(10), 'committer receive <receive@local> 0 +0000', chr(10), chr(10), message) AS content FROM made),
commits_made AS (SELECT *, sha1(concat('commit ', strlen(content), chr(0), content)) AS id FROM stamped)"""


@query("merge_commits", duck(_FORK, TREES + " SELECT bundle_id, target_ref, id, tree_oid, target AS first_parent, incoming AS second_parent, message FROM commits_made"))
def merge_commits(spark, sf):
    plan = _fork_plan(spark, sf)
    checks, paths = _fork_merge(spark, sf, plan)
    checks = checkpointed(checks)
    made = R.merge_commits(checks, R.merged_snapshot(checks, paths))
    return made.select("bundle_id", "target_ref", "id", "tree_oid", F.get("parent_oids", F.lit(0)).alias("first_parent"), F.get("parent_oids", F.lit(1)).alias("second_parent"), "message")


@query("merge_texts", duck(_FORK, MERGED + " SELECT bundle_id, path, NOT bad AS clean, CASE WHEN NOT bad THEN sha256(merged) END AS merged FROM resolved WHERE kind = 'both-modified'"))
def merge_texts(spark, sf):
    rows = R.merge_paths(view(spark, sf, "forked").drop("kind")).where("kind = 'both-modified'").drop("merged")
    return L.merge_texts(rows).select("bundle_id", "path", F.col("merged").isNotNull().alias("clean"), F.sha2(F.col("merged").cast("binary"), 256).alias("merged"))


@query("can_apply", duck(_FORK, MERGED + " SELECT bundle_id, true AS create_only, false AS forward, bool_and(status = 'clean') AS merge FROM merge GROUP BY bundle_id"))
def can_apply(spark, sf):
    plan = _fork_plan(spark, sf)
    checks = checkpointed(_fork_merge(spark, sf, plan)[0])
    one = lambda policy, name: R.can_apply(plan, checks, policy).withColumnRenamed("allowed", name)
    return one("create-refs-only", "create_only").join(one("fast-forward-only", "forward"), "bundle_id").join(one("merge", "merge"), "bundle_id")


@query("blocking_rows", duck(_FORK, MERGED + " SELECT bundle_id, target_ref, target, incoming, CASE status WHEN 'conflicted' THEN 'merge would conflict' ELSE 'mergeability check failed' END AS reason, 'merge required' AS next_step, conflict_paths FROM merge WHERE status <> 'clean'"))
def blocking_rows(spark, sf):
    plan = _fork_plan(spark, sf)
    rows = R.blocking_rows(plan, _fork_merge(spark, sf, plan)[0], "merge")
    return rows.select("bundle_id", "target_ref", "target", "incoming", "reason", "next_step", F.concat_ws(",", "conflict_paths").alias("conflict_paths"))


@query("planned_updates", duck(_FORK, TREES + " SELECT bundle_id, CASE s WHEN 1 THEN concat('refs/sync/merge-test/', bundle_id, '/heads/k', k) ELSE target_ref END AS ref_name, CASE s WHEN 2 THEN target END AS expected_old, id AS new_oid, s AS step FROM commits_made, unnest([1, 2]) t(s)"))
def planned_updates(spark, sf):
    plan = _fork_plan(spark, sf)
    checks, paths = _fork_merge(spark, sf, plan)
    checks = checkpointed(checks)
    made = R.merge_commits(checks, R.merged_snapshot(checks, paths)).select("bundle_id", "target_ref", F.col("id").alias("merge_oid"))
    return R.planned_updates(plan, made, "merge").select("bundle_id", "ref_name", "expected_old", "new_oid", "step")


@query("dry_run_document", duck(_FORK, MERGED + " SELECT bundle_id, 'v2' AS bundle_version, count(*) AS heads, bool_and(status = 'clean') AS can_apply, count(*) AS plan_rows, string_agg(concat(target_ref, '=', status), ',' ORDER BY target_ref) AS checks FROM merge GROUP BY bundle_id"))
def dry_run_document(spark, sf):
    """The document's own JSON, read back."""
    plan = _fork_plan(spark, sf)
    checks = checkpointed(_fork_merge(spark, sf, plan)[0])
    heads = plan.groupBy("bundle_id").agg(F.count("*").alias("n_heads"), F.lit("v2").alias("version"))
    pairs = plan.select(F.struct("bundle_id", "target_ref").alias("pair"), F.col("target").alias("old_commit"), F.col("incoming").alias("new_commit"))
    stats = S.line_stats(S.changed_texts(pairs, view(spark, sf, "fork_files"))).select("pair.bundle_id", "path", "additions", "deletions")
    docs = R.dry_run_document(heads, plan, checks, S.bundle_line_stats(stats), "merge")
    shape = "bundle_version string, would_import_heads long, can_apply_without_conflicts boolean, preflight_plan array<struct<target_ref string, status string>>, mergeability_checks array<struct<target_ref string, status string>>, line_stats array<struct<path string>>"
    d = docs.select("bundle_id", F.from_json("document", shape).alias("d"))
    checks_text = F.concat_ws(",", F.transform("d.mergeability_checks", lambda x: F.concat(x["target_ref"], F.lit("="), x["status"])))
    return d.select("bundle_id", "d.bundle_version", F.col("d.would_import_heads").alias("heads"), F.col("d.can_apply_without_conflicts").alias("can_apply"), F.size("d.preflight_plan").alias("plan_rows"), checks_text.alias("checks"))
