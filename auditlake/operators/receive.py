"""Receiving packages: incoming refs, plan, policy, planned updates, applying and rolling back.

Tables: incoming(bundle_id, target_ref, incoming, target), plan(bundle_id, target_ref, target, incoming, merge_base,
status), mergeability(bundle_id, target_ref, status, conflict_paths), refs(repo, ref_name, oid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from auditlake.functions.columns import object_id, short_oid
from auditlake.operators.history import merge_base
from auditlake.operators.iterate import checkpointed
from auditlake.operators.lines import merge_texts
from auditlake.operators.objects import build_trees

STATUSES = ["target_missing", "already_present", "fast_forward_ok", "target_ahead", "diverged_merge_required"]
DIVERGED = "diverged_merge_required"


def incoming_refs(heads: DataFrame) -> DataFrame:
    """heads(bundle_id, reference) with the four names under which a head is kept."""
    rest = F.regexp_replace("reference", "^refs/", "")
    at = lambda kind: F.concat(F.lit(f"refs/{kind}/"), F.col("bundle_id").cast("string"), F.lit("/"), rest)
    return heads.withColumns({"incoming_ref": at("sync/incoming"), "branch_ref": at("heads/incoming"), "merge_test_ref": at("sync/merge-test"), "staging_ref": at("sync/fetch-staging")})


def receive_plan(incoming: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """incoming with status and merge_base, tested in the order of STATUSES.

    One walk over pairs tells all: the merge base of two commits of which one descends from the other is the elder.
    """
    pairs = incoming.select(F.col("incoming").alias("a"), F.col("target").alias("b")).distinct()
    rows = incoming.join(merge_base(pairs, commits, edges).withColumnsRenamed({"a": "incoming", "b": "target"}), ["incoming", "target"], "left")
    at = lambda c: F.coalesce(F.col("merge_base") == F.col(c), F.lit(False))
    status = F.when(F.col("target").isNull(), STATUSES[0]).when(F.col("target") == F.col("incoming"), STATUSES[1]).when(at("target"), STATUSES[2]).when(at("incoming"), STATUSES[3]).otherwise(DIVERGED)
    return rows.withColumn("status", status)


def with_targets(incoming: DataFrame, resolved: DataFrame) -> DataFrame:
    """incoming(bundle_id, repo, target_ref, incoming) with target_oid, what the ref names, and target, the commit that is.

    resolved(repo, ref_name, target_oid, commit_oid) are refs followed and tags peeled; a missing ref has neither.
    """
    refs = resolved.select("repo", F.col("ref_name").alias("target_ref"), "target_oid", F.col("commit_oid").alias("target"))
    return incoming.join(refs, ["repo", "target_ref"], "left")


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("bundle_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def can_apply(plan: DataFrame, merge: DataFrame, policy: str) -> DataFrame:
    """(bundle_id, allowed) under create-refs-only, fast-forward-only or merge."""
    diverged = F.col("status") == DIVERGED
    if policy == "create-refs-only":
        return plan.groupBy("bundle_id").agg(F.lit(True).alias("allowed"))
    if policy == "fast-forward-only":
        return plan.groupBy("bundle_id").agg(F.bool_and(~diverged).alias("allowed"))
    checked = plan.join(merge.select("bundle_id", "target_ref", F.col("status").alias("merge_status")), ["bundle_id", "target_ref"], "left")
    return checked.groupBy("bundle_id").agg(F.bool_and(~diverged | (F.coalesce("merge_status", F.lit("")) == "clean")).alias("allowed"))


def blocking_rows(plan: DataFrame, merge: DataFrame, policy: str) -> DataFrame:
    """Rows that stand against the policy, with reason, next step and the paths in conflict."""
    rows = plan.where(F.col("status") == DIVERGED).join(merge.select("bundle_id", "target_ref", F.col("status").alias("merge_status"), "conflict_paths"), ["bundle_id", "target_ref"], "left")
    if policy == "create-refs-only":
        rows = rows.where(F.lit(False))
    if policy == "merge":
        rows = rows.where("merge_status is null or merge_status <> 'clean'")
    reason = (
        F.lit("diverged (non-fast-forward)")
        if policy != "merge"
        else F.when(F.col("merge_status") == "conflicted", "merge would conflict").when(F.col("merge_status") == "unknown", "mergeability check failed").otherwise("mergeability check missing")
    )
    return rows.select("bundle_id", "target_ref", "target", "incoming", "merge_base", reason.alias("reason"), F.lit("merge required").alias("next_step"), "conflict_paths")


def planned_updates(plan: DataFrame, merged: DataFrame, policy: str) -> DataFrame:
    """(bundle_id, ref_name, expected_old, new_oid, step): missing and forward rows advance; clean diverged rows under merge go by a test ref.

    merged(bundle_id, target_ref, merge_oid): merge commits of clean diverged rows.
    """
    if policy == "create-refs-only":
        plan = plan.where(F.lit(False))
    forward = plan.where(F.col("status").isin("target_missing", "fast_forward_ok")).select("bundle_id", F.col("target_ref").alias("ref_name"), F.col("target").cast("string").alias("expected_old"), F.col("incoming").cast("string").alias("new_oid"), F.lit(1).alias("step"))
    if policy != "merge":
        return forward
    rows = plan.where(F.col("status") == DIVERGED).join(merged, ["bundle_id", "target_ref"])
    test = F.concat(F.lit("refs/sync/merge-test/"), F.col("bundle_id").cast("string"), F.lit("/"), F.regexp_replace("target_ref", "^refs/", ""))
    one = lambda name, old, step: F.struct(name.alias("ref_name"), old.cast("string").alias("expected_old"), F.col("merge_oid").cast("string").alias("new_oid"), F.lit(step).alias("step"))
    both = rows.select("bundle_id", F.explode(F.array(one(test, F.lit(None), 1), one(F.col("target_ref"), F.col("target"), 2))).alias("u")).select("bundle_id", "u.*")
    return forward.unionByName(both)


def apply_updates(refs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The refs after all updates of each bundle whose every expected value holds, and the updates that fail.

    refs(repo, ref_name, oid), updates(bundle_id, repo, ref_name, expected_old, new_oid). Bundles that name one ref are
    taken in order of their ids: once one has moved the ref, the value that the others expect no longer stands.
    """
    checked = checkpointed(updates.join(refs, ["repo", "ref_name"], "left").withColumn("holds", F.col("oid").eqNullSafe(F.col("expected_old"))))
    passed = checked.groupBy("bundle_id").agg(F.bool_and("holds").alias("all_hold"))
    left = checkpointed(checked.join(passed.where("all_hold"), "bundle_id").select("bundle_id", "repo", "ref_name", "new_oid"))
    good = left.where("false")
    while not left.isEmpty():
        first = left.groupBy("repo", "ref_name").agg(F.min("bundle_id").alias("first"))
        won = left.join(first, ["repo", "ref_name"]).groupBy("bundle_id").agg(F.bool_and(F.col("first") == F.col("bundle_id")).alias("won")).where("won")
        now = checkpointed(left.join(won.select("bundle_id"), "bundle_id", "left_semi"))
        good = good.unionByName(now)
        beaten = left.join(now.select("repo", "ref_name"), ["repo", "ref_name"], "left_semi").select("bundle_id").distinct()
        left = checkpointed(left.join(beaten, "bundle_id", "left_anti"))
    good = checkpointed(good)
    moved = good.select("repo", "ref_name", F.col("bundle_id").alias("by"), "new_oid")
    after = refs.join(moved, ["repo", "ref_name"], "full").select("repo", "ref_name", F.coalesce("new_oid", "oid").alias("oid"))
    late = checked.where("holds").join(moved.drop("new_oid").withColumnRenamed("by", "winner"), ["repo", "ref_name"]).where("winner <> bundle_id").join(moved.drop("by").withColumnRenamed("new_oid", "now"), ["repo", "ref_name"])
    failed = checked.where("not holds").select("bundle_id", "repo", "ref_name", "expected_old", F.col("oid").alias("actual"))
    return after, failed.unionByName(late.select("bundle_id", "repo", "ref_name", "expected_old", F.col("now").alias("actual")))


def roll_back(refs: DataFrame, applied: DataFrame, stage: str = "update") -> tuple[DataFrame, DataFrame]:
    """The refs with applied updates undone where the new value still stands, and per update restored, deleted or untouched.

    The report names the stage at which applying failed, and why an update was left as it is.
    """
    rows = checkpointed(applied.join(refs, ["repo", "ref_name"], "left"))
    stands = F.coalesce(F.col("oid") == F.col("new_oid"), F.lit(False))
    outcome = F.when(~stands, "untouched").when(F.col("expected_old").isNull(), "deleted").otherwise("restored")
    now = F.coalesce(F.col("oid").cast("string"), F.lit("none"))
    reason = F.when(~stands, F.concat(F.lit("ref is at "), now, F.lit(", not at the applied "), F.col("new_oid").cast("string")))
    report = rows.select("bundle_id", "repo", "ref_name", outcome.alias("outcome"), F.lit(stage).alias("stage"), reason.alias("reason"))
    undone = rows.where(stands).select("repo", "ref_name", F.col("expected_old").alias("old"), F.lit(True).alias("undo"))
    after = refs.join(undone, ["repo", "ref_name"], "left").where("undo is null or old is not null").select("repo", "ref_name", F.when(F.col("undo"), F.col("old")).otherwise(F.col("oid")).alias("oid"))
    return after, report


def already_applied(heads: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(bundle_id, repo, applied): whether in a receiving repository every head's ref points at it and its commit exists.

    heads(bundle_id, repo, reference, oid) name the repository that each package is for, refs(repo, ref_name, oid) and
    commits(repo, id) what the repositories have; another repository's refs and commits do not count.
    """
    now = refs.select("repo", F.col("ref_name").alias("reference"), F.col("oid").alias("now"))
    here = commits.select("repo", F.col("id").alias("oid")).distinct().withColumn("here", F.lit(True))
    known = heads.join(now, ["repo", "reference"], "left").join(here, ["repo", "oid"], "left")
    return known.groupBy("bundle_id", "repo").agg(F.bool_and(F.coalesce((F.col("now") == F.col("oid")) & F.col("here"), F.lit(False))).alias("applied"))


def plan_actions(plan: DataFrame, policy: str, dry_run: bool) -> DataFrame:
    """plan's rows with the action's wording."""
    ref, say = F.col("target_ref"), (lambda dry, done: dry if dry_run else done)
    move = F.concat(F.lit(say("would update ", "updated ")), ref, F.lit(" from "), short_oid(F.col("target").cast("string")), F.lit(" to "), short_oid(F.col("incoming").cast("string")))
    kept = F.concat(F.lit(say("would keep ", "kept ")), ref)
    if policy == "create-refs-only":
        action = F.concat(F.lit(say("would", "did") + " keep "), ref, F.lit(" unchanged (create-refs-only mode)"))
    else:
        merge = policy == "merge"
        last = F.concat(F.lit(say("would", "did") + " merge "), ref, F.lit(" with incoming head (merge policy)")) if merge else F.concat(F.lit("cannot auto-update "), ref, F.lit(" (diverged history, manual merge required)"))
        action = (
            F.when(F.col("status").isin("target_missing", "fast_forward_ok"), F.concat(move, F.lit(" (merge policy; no merge commit needed)")) if merge else move)
            .when(F.col("status") == "already_present", F.concat(kept, F.lit(" unchanged (already up to date)")))
            .when(F.col("status") == "target_ahead", F.concat(kept, F.lit(" unchanged (target already ahead; merge commit not needed)" if merge else " unchanged (target already ahead of incoming)")))
            .otherwise(last)
        )
    return plan.select("bundle_id", "target_ref", "status", action.alias("action"))


def duplicate_tips(heads: DataFrame) -> DataFrame:
    """heads with how many heads of the bundle share the id."""
    n = F.count("*").over(W.Window.partitionBy("bundle_id", "oid"))
    return heads.withColumn("n_same", n).withColumn("duplicate", F.col("n_same") > 1)


def no_heads(bundles: DataFrame, heads: DataFrame) -> DataFrame:
    return bundles.join(heads.select("bundle_id"), "bundle_id", "left_anti")


def keep_incoming(refs: DataFrame, incoming: DataFrame, mirrors: bool = False, analysed: DataFrame | None = None) -> DataFrame:
    """refs(repo, ref_name, oid) with the incoming names set, whatever the policy decides afterwards.

    incoming(bundle_id, repo, incoming_ref, branch_ref, oid) are incoming_refs' rows; with mirrors, each has a branch of its own name too.
    A run that only analyses packages already applied, analysed(bundle_id, repo), writes none of theirs.
    """
    names = F.array("incoming_ref", F.when(F.lit(mirrors), F.col("branch_ref")))
    kept = incoming.join(analysed.select("bundle_id", "repo"), ["bundle_id", "repo"], "left_anti") if analysed is not None else incoming
    rows = kept.select("repo", F.explode(F.array_compact(names)).alias("ref_name"), "oid")
    return refs.join(rows.select("repo", "ref_name"), ["repo", "ref_name"], "left_anti").unionByName(rows.select(*refs.columns))


def merge_paths(rows: DataFrame) -> DataFrame:
    """rows(bundle_id, path, base, ours, theirs; null = absent) with kind and, where one side decides, `merged`."""
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    kind = (
        F.when(o.eqNullSafe(t), "same")
        .when(b.eqNullSafe(o), "take-theirs")
        .when(b.eqNullSafe(t), "take-ours")
        .when(b.isNull(), "add/add")
        .when(o.isNull() | t.isNull(), "modify/delete")
        .otherwise("both-modified")
    )
    merged = F.when(F.col("kind").isin("same", "take-ours"), o).when(F.col("kind") == "take-theirs", t)
    return rows.withColumn("kind", kind).withColumn("merged", merged)


def simulate_merges(plan: DataFrame, files: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the diverged rows of the plan: checks and, path by path, what a merge gives.

    files(commit, path, mode, oid, text), commits(id, subject). Checks: bundle_id, target_ref, the three ids and subjects,
    status clean, conflicted or unknown, detail, conflict_paths. Paths: bundle_id, target_ref, path, kind, mode, oid, conflict.
    """
    rows = checkpointed(plan.where(F.col("status") == DIVERGED).select("bundle_id", "target_ref", "target", "incoming", "merge_base"))
    key = ["bundle_id", "target_ref"]
    side = lambda commit, name: rows.where("merge_base is not null").select(*key, F.col(commit).alias("commit"), F.lit(name).alias("side")).join(files, "commit").drop("commit")
    each = side("merge_base", "b").unionByName(side("target", "o")).unionByName(side("incoming", "t"))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    names = {"b": "base", "o": "ours", "t": "theirs"}
    wide = each.groupBy(*key, "path").agg(*[of(s, c).alias(f"{n}_{c}") for s, n in names.items() for c in ("mode", "oid", "text")])
    what = lambda n: F.concat_ws(":", F.col(f"{n}_oid"), F.col(f"{n}_mode"))
    told = merge_paths(wide.withColumns({n: F.when(F.col(f"{n}_oid").isNotNull(), what(n)) for n in names.values()})).drop(*names.values(), "merged")
    plain = F.lit(True)
    for n in names.values():
        plain = plain & F.col(f"{n}_mode").isin("100644", "100755")
    both = F.col("kind") == "both-modified"
    text = lambda n: F.when(both & plain, F.col(f"{n}_text")).alias(n)
    tried = merge_texts(told.select(*[c for c in told.columns if not c.endswith("_text")], text("base"), text("ours"), text("theirs"))).drop(*names.values())
    new_id = F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length("merged").cast("string")).cast("binary"), F.lit(b"\0"), F.col("merged").cast("binary")))
    pick = lambda c, own: F.when(F.col("kind").isin("same", "take-ours"), F.col(f"ours_{c}")).when(F.col("kind") == "take-theirs", F.col(f"theirs_{c}")).when(both & plain & F.col("merged").isNotNull(), own)
    mode = F.when(F.col("ours_mode") == F.col("base_mode"), F.col("theirs_mode")).otherwise(F.col("ours_mode"))
    conflict = F.col("kind").isin("add/add", "modify/delete") | (both & (~plain | F.col("merged").isNull()))
    paths = checkpointed(tried.select(*key, "path", "kind", pick("mode", mode).alias("mode"), pick("oid", new_id).alias("oid"), conflict.alias("conflict")))
    bad = paths.groupBy(*key).agg(F.count_if("conflict").alias("n_bad"), F.array_sort(F.collect_set(F.when(F.col("conflict"), F.col("path")))).alias("conflict_paths"))
    named = rows
    for c in ("target", "incoming", "merge_base"):
        named = named.join(commits.select(F.col("id").alias(c), F.col("subject").alias(f"{c}_subject"), F.lit(True).alias(f"{c}_here")), c, "left")
    lost = F.coalesce("target_here", F.lit(False)) & F.coalesce("incoming_here", F.lit(False))
    why = F.when(F.col("target").isNull(), "target oid unavailable for merge simulation").when(~lost, "merge simulation failed: a commit is absent").when(F.col("merge_base").isNull(), "merge simulation failed: no common ancestor")
    n = F.coalesce("n_bad", F.lit(0))
    status = F.when(why.isNotNull(), "unknown").when(n > 0, "conflicted").otherwise("clean")
    detail = F.coalesce(why, F.when(n > 0, "merge simulation produced index conflicts").otherwise("merge simulation completed without conflicts"))
    none = F.expr("cast(array() as array<string>)")
    checks = named.join(bad, key, "left").select(*key, "target", "target_subject", "incoming", "incoming_subject", "merge_base", "merge_base_subject", status.alias("status"), detail.alias("detail"), F.coalesce("conflict_paths", none).alias("conflict_paths"))
    return checks, paths


def merged_snapshot(checks: DataFrame, paths: DataFrame) -> DataFrame:
    """(bundle_id, target_ref, path, mode, oid) of what each clean merge leaves."""
    clean = checks.where("status = 'clean'").select("bundle_id", "target_ref")
    return paths.where("oid is not null").join(clean, ["bundle_id", "target_ref"], "left_semi").select("bundle_id", "target_ref", "path", "mode", "oid")


def merge_commits(checks: DataFrame, snapshot: DataFrame, who: str = "receive <receive@local>", seconds: int = 0, zone: str = "+0000") -> DataFrame:
    """(bundle_id, target_ref, id, tree_oid, parent_oids, message, content): the commit object of each clean merge, whose snapshot may be empty.

    The tree is built from the merged snapshot's files, directories below it first (objects.build_trees), and the id is that of the
    commit's bytes. Who merges and when is the caller's to say, so that results repeat.
    """
    key = ("bundle_id", "target_ref")
    trees = build_trees(snapshot, key).where("dir = ''").select(*key, F.col("oid").alias("tree_oid"))
    say = F.concat(F.lit("receive merge for "), F.col("target_ref"), F.lit("\n\nTarget: "), F.col("target"), F.lit("\nIncoming: "), F.col("incoming"), F.lit("\n"))
    rows = checks.where("status = 'clean'").join(trees, list(key), "left").withColumns({"message": say, "tree_oid": F.coalesce("tree_oid", object_id(F.lit("tree"), F.lit(b"")))})
    stamp = f"{who} {seconds} {zone}"
    content = F.concat(F.lit("tree "), "tree_oid", F.lit("\nparent "), "target", F.lit("\nparent "), "incoming", F.lit(f"\nauthor {stamp}\ncommitter {stamp}\n\n"), "message")
    return rows.select(*key, object_id(F.lit("commit"), content).alias("id"), "tree_oid", F.array("target", "incoming").alias("parent_oids"), "message", content.alias("content"))


def dry_run_document(bundles: DataFrame, plan: DataFrame, checks: DataFrame, stats: DataFrame, policy: str) -> DataFrame:
    """(bundle_id, document): plan, merge checks and line stats of each of bundles(bundle_id, n_heads, version) as JSON, null values kept."""

    def listed(rows: DataFrame, name: str, *columns) -> DataFrame:
        return rows.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    kept = F.concat(F.lit("refs/sync/incoming/"), F.col("bundle_id").cast("string"), F.lit("/"), F.regexp_replace("target_ref", "^refs/", ""))
    oid = lambda c: F.col(c).cast("string").alias(f"{c}_oid")
    plan_rows = listed(plan, "preflight_plan", "target_ref", "status", oid("target"), oid("incoming"), oid("merge_base"), kept.alias("preserved_incoming_ref"))
    check_rows = listed(checks, "mergeability_checks", "target_ref", oid("target"), F.col("target_subject").alias("target_summary"), oid("incoming"), F.col("incoming_subject").alias("incoming_summary"), oid("merge_base"), F.col("merge_base_subject").alias("merge_base_summary"), "status", "detail", "conflict_paths")
    stat_rows = listed(stats, "line_stats", "path", "additions", "deletions")
    rows = bundles.join(can_apply(plan, checks, policy), "bundle_id", "left")
    for part in (plan_rows, check_rows, stat_rows):
        rows = rows.join(part, "bundle_id", "left")
    some = lambda part, name: F.coalesce(F.col(name), F.from_json(F.lit("[]"), part.schema[name].dataType)).alias(name)
    body = F.struct(F.col("version").alias("bundle_version"), F.col("n_heads").alias("would_import_heads"), F.coalesce("allowed", F.lit(True)).alias("can_apply_without_conflicts"), some(plan_rows, "preflight_plan"), some(check_rows, "mergeability_checks"), some(stat_rows, "line_stats"))
    return rows.select("bundle_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def mergeability(paths: DataFrame) -> DataFrame:
    """(bundle_id, status, conflict_paths) by paths alone: any path changed on both sides is a conflict."""
    bad = F.col("kind").isin("add/add", "modify/delete", "both-modified")
    return paths.groupBy("bundle_id").agg(F.when(F.count_if(bad) > 0, "conflicted").otherwise("clean").alias("status"), F.array_sort(F.collect_set(F.when(bad, F.col("path")))).alias("conflict_paths"))
