"""The commit graph: closures, ranges, order, merge bases, decorations, connectivity, chains.

Tables: commits(id, time, ...), edges(child, parent, parent_index), heads(bundle_id, head_index, oid, reference),
refs(repo, ref_name, target_oid, symbolic_target), tag_objects(oid, target_oid, target_kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.columns import decoration_label, decoration_rank
from auditlake.operators.chains import Reach, chain_places, crossings, first_visits, in_order, islands
from auditlake.operators.iterate import checkpointed, followed, generations

MISSING_SUBJECT = "<prerequisite commit unavailable>"


def ancestors(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node) for starts(start); a start is its own ancestor."""
    reach = Reach(edges)
    return reach.nodes(reach.labels(starts.select("start", F.col("start").alias("node"))))


def commit_range(ranges: DataFrame, edges: DataFrame) -> DataFrame:
    """(range_id, node): ancestors of each range's tips without those of its hidden commits. ranges(range_id, tip, hidden)."""
    reach = Reach(edges)
    side = lambda c: reach.labels(ranges.where(F.col(c).isNotNull()).select(F.col("range_id").alias("start"), F.col(c).alias("node")))
    return reach.nodes(side("tip"), side("hidden")).withColumnRenamed("start", "range_id")


def is_descendant(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(a, b) with `descends`: whether a is a strict descendant of b."""
    return _reaching(pairs, edges).withColumn("descends", F.coalesce((F.col("a") != F.col("b")) & F.col("reaches"), F.lit(False))).drop("reaches")


def range_guard(ranges: DataFrame, edges: DataFrame) -> DataFrame:
    """ranges(range_id, tip, base) with `linear`: the tip equals the base or descends from it."""
    found = _reaching(ranges.withColumnsRenamed({"tip": "a", "base": "b"}), edges)
    return found.withColumn("linear", F.coalesce((F.col("a") == F.col("b")) | F.col("reaches"), F.lit(False))).withColumnsRenamed({"a": "tip", "b": "base"}).drop("reaches")


def _reaching(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs with `reaches`, true where a is b or descends from it and null elsewhere."""
    reach, keys = Reach(edges), pairs.select("a", "b").where("a is not null and b is not null").distinct()
    labels = reach.labels(keys.select(F.col("a").alias("start"), F.col("a").alias("node")).distinct())
    found = reach.covered(labels, keys.select(F.col("a").alias("start"), F.col("b").alias("node")))
    return pairs.join(found.select(F.col("start").alias("a"), F.col("node").alias("b"), F.lit(True).alias("reaches")), ["a", "b"], "left")


def topological(commits: DataFrame, edges: DataFrame, by: str = "repo") -> DataFrame:
    """commits(id, time, by) with generation and position within `by`, parents first; ties go by generation, time, id."""
    gen = generations(commits.select(F.col("id").alias("node")), edges).withColumnRenamed("node", "id")
    return in_order(commits.join(gen, "id"), [by], F.col("generation"), F.col("time"), F.col("id")).withColumn("position", F.col("number") - 1).drop("number")


def merge_base(pairs: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(a, b) with merge_base: of common ancestors the greatest by (generation, time, id), null if unrelated.

    Of two ends on one chain the lower is their base. Others have in common, of each chain that both reach, what lies at or below the lower
    of their two positions. The commit there is the chain's best, so a pair forms one row for each such chain, and an end is walked once
    however many pairs it is in.
    """
    reach = Reach(edges, commits.select(F.col("id").alias("node")))
    at = lambda end: reach.places.toDF(end, f"chain_{end}", f"pos_{end}")
    ends = checkpointed(pairs.select("a", "b").where("a is not null and b is not null").distinct().join(at("a"), "a").join(at("b"), "b"))
    alone = F.col("chain_a") == F.col("chain_b")
    near = ends.where(alone).select("a", "b", F.when(F.col("pos_a") < F.col("pos_b"), F.col("a")).otherwise(F.col("b")).alias("merge_base"))
    keys = ends.where(~alone).select("a", "b")
    labels = reach.labels(keys.select(F.explode(F.array("a", "b")).alias("start")).distinct().withColumn("node", F.col("start")))
    side = lambda end, pos: labels.select(F.col("start").alias(end), "chain", F.col("pos").alias(pos))
    both = checkpointed(keys.join(side("a", "pos_a"), "a").join(side("b", "pos_b"), ["b", "chain"]).select("a", "b", "chain", F.least("pos_a", "pos_b").alias("pos")))
    gen = generations(commits.select(F.col("id").alias("node")), edges).join(commits.select(F.col("id").alias("node"), "time"), "node")
    met = reach.places.join(both.select("chain", "pos").distinct(), ["chain", "pos"]).join(gen, "node")
    best = both.join(met.select("chain", "pos", F.struct("generation", "time", "node").alias("best")), ["chain", "pos"]).groupBy("a", "b").agg(F.max("best").alias("best"))
    found = near.unionByName(best.select("a", "b", F.col("best.node").alias("merge_base")))
    return pairs.join(found, ["a", "b"], "left")


def _visits(heads: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(bundle_id, node, head_index, key, run) of present commits, over edges between such."""
    here = commits.select(F.col("id").alias("node"))
    present = edges.join(here.withColumnRenamed("node", "child"), "child", "left_semi").join(here.withColumnRenamed("node", "parent"), "parent", "left_semi")
    places = chain_places(here, present)
    return checkpointed(first_visits(heads.select("bundle_id", "head_index", F.col("oid").alias("node")), places, crossings(places, present)))


def visit_order(heads: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(bundle_id, id, head_index, commit_order): first visit of each commit by depth-first pre-order from heads in order.

    On an acyclic graph this is the order of the smallest path key [head, parent index, parent index, ...]; chains.first_visits finds it
    in as many rounds as such a path changes its chain. A commit reached from an earlier head keeps that head.
    """
    rows = in_order(_visits(heads, commits, edges), ["bundle_id", "head_index"], F.col("key"), F.col("run"))
    return rows.select("bundle_id", F.col("node").alias("id"), F.col("head_index").cast("int").alias("head_index"), F.col("number").alias("commit_order"))


def display_order(heads: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(bundle_id, id, row): depth-first from the last head and last parent first; commits of no head follow, newest first."""
    turned = heads.withColumn("head_index", -F.col("head_index").cast("int"))
    seen = _visits(turned, commits, edges.withColumn("parent_index", -F.col("parent_index")))
    rest = commits.join(seen.select(F.col("node").alias("id")), "id", "left_anti")
    shown = seen.select("bundle_id", F.col("node").alias("id"), F.lit(0).alias("part"), "key", "run")
    left = rest.select(F.col("repo").alias("bundle_id"), "id", F.lit(1).alias("part"), F.array((-F.unix_date(F.to_date("time"))).cast("long")).alias("key"), F.col("id").cast("long").alias("run"))
    rows = in_order(shown.unionByName(left), ["bundle_id"], F.col("part"), F.col("key"), F.col("run"))
    return rows.select("bundle_id", "id", F.col("number").alias("row"))


def boundary(shown: DataFrame, edges: DataFrame, all_commits: DataFrame) -> DataFrame:
    """(id, subject): parents of shown commits that are not shown, with their subject or a notice."""
    outside = edges.join(shown.select(F.col("id").alias("child")), "child", "left_semi").select(F.col("parent").alias("id")).distinct().join(shown.select("id"), "id", "left_anti")
    return outside.join(all_commits.select("id", "subject"), "id", "left").withColumn("subject", F.coalesce("subject", F.lit(MISSING_SUBJECT)))


def decorations(refs: DataFrame, heads: DataFrame, shown: DataFrame) -> DataFrame:
    """(repo, id, labels): branch (rank 1), tag: name (rank 2), HEAD -> branch (rank 0) of each repository's shown commits, best rank of each label.

    refs(repo, ref_name, oid), heads(repo, reference, oid), shown(repo, id): another repository's refs to the same commit do not count.
    """
    plain = refs.select("repo", F.col("oid").alias("id"), decoration_rank("ref_name").alias("rank"), decoration_label("ref_name").alias("label"))
    own = heads.where(F.col("reference").startswith("refs/heads/")).select("repo", F.col("oid").alias("id"), F.lit(0).alias("rank"), F.concat(F.lit("HEAD -> "), decoration_label("reference")).alias("label"))
    kept = plain.unionByName(own).where("rank is not null and label <> ''").join(shown.select("repo", "id"), ["repo", "id"], "left_semi").groupBy("repo", "id", "label").agg(F.min("rank").alias("rank"))
    return kept.groupBy("repo", "id").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"])).alias("labels"))


def assume_present(revs: DataFrame, tips: DataFrame, edges: DataFrame) -> DataFrame:
    """revs(range_id, pos, oid) that a receiver has: reachable from the range's tip, not its base, first of repeats. tips(range_id, tip, base)."""
    reach = Reach(edges)
    labels = reach.labels(tips.select(F.col("range_id").alias("start"), F.col("tip").alias("node")))
    bases = tips.where("base is not null").select("range_id", F.col("base").alias("oid")).distinct()
    known = reach.covered(labels, revs.select(F.col("range_id").alias("start"), F.col("oid").alias("node"), "pos"))
    kept = known.withColumnsRenamed({"start": "range_id", "node": "oid"}).join(bases, ["range_id", "oid"], "left_anti")
    return kept.groupBy("range_id", "oid").agg(F.min("pos").alias("pos")).select("range_id", "pos", "oid")


class _Walk:
    """What a package's heads reach and its prerequisites don't, over commits that its repository has; edges to others are `missing`."""

    def __init__(self, heads: DataFrame, prereqs: DataFrame, here: DataFrame, edges: DataFrame):
        place = lambda c: F.struct("repo", F.col(c).alias("oid"))
        own = checkpointed(here.join(heads.select("repo").distinct(), "repo", "left_semi"))
        edges = checkpointed(edges.select("child", "parent", F.col("parent_index") if "parent_index" in edges.columns else F.lit(0).alias("parent_index")))
        # Chains are formed once; each repository's are what it has of them.
        places = islands(chain_places(own.select(F.col("oid").alias("node")).distinct(), edges), own)
        known = own.select("repo", F.col("oid").alias("parent"), F.lit(True).alias("known"))
        told = checkpointed(edges.join(own.withColumnRenamed("oid", "child"), "child").join(known, ["repo", "parent"], "left"))
        self.missing = told.where("known is null").select("repo", "child", "parent")
        present = told.where("known").select(place("child").alias("child"), place("parent").alias("parent"), "parent_index")
        self.reach = Reach(present, places=places)
        side = lambda rows: self.reach.labels(rows.join(own, ["repo", "oid"], "left_semi").select(F.col("at").alias("start"), place("oid").alias("node")))
        self.shown, self.hidden = side(heads), side(prereqs)

    def nodes(self) -> DataFrame:
        """(at, repo, oid) of all those commits."""
        return checkpointed(self.reach.nodes(self.shown, self.hidden).select(F.col("start").alias("at"), "node.repo", "node.oid"))

    def lacking(self, heads: DataFrame) -> DataFrame:
        """(at, repo, oid): parents that such commits have and their repository has not, told from the edges to these alone."""
        ends = self.missing.join(heads.select("at", "repo").distinct(), "repo").select(F.col("at").alias("start"), F.struct("repo", F.col("child").alias("oid")).alias("node"), "repo", "parent")
        met = self.reach.covered(self.shown, ends)
        return met.join(self.reach.covered(self.hidden, met).select("start", "node").distinct(), ["start", "node"], "left_anti").select(F.col("start").alias("at"), "repo", F.col("parent").alias("oid")).distinct()


def dangling(heads: DataFrame, prereqs: DataFrame, commits: DataFrame, edges: DataFrame, tree_entries: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """References to what a package's repository lacks: (bundle_id, repo, kind, oid), kind head, parent, tree, entry or unknown; prerequisites may be absent.

    heads(bundle_id, repo, oid) name the repository that receives each package; commits(repo, id) and objects(repo, oid) are what
    repositories have, with the package's own among them. An object of another repository closes no gap. Trees are looked at if
    tree_entries(tree_oid, child_oid, child_kind) and objects are given; commits then have tree_oid. An entry whose child_kind is null
    is of unknown kind.
    """
    here = checkpointed(commits.select("repo", F.col("id").alias("oid")).distinct())
    own = checkpointed(heads.select(F.struct("bundle_id", "repo").alias("at"), "repo", "oid").distinct())
    known = prereqs.select("bundle_id", "oid").join(own.select("at.bundle_id", "at", "repo").distinct(), "bundle_id").select("at", "repo", "oid")
    lost = own.join(here, ["repo", "oid"], "left_anti").select("at", F.lit("head").alias("kind"), "oid")
    walk = _Walk(own, known, here, edges)
    parents = walk.lacking(own).join(known.select("at", "oid"), ["at", "oid"], "left_anti")
    found = lost.unionByName(parents.select("at", F.lit("parent").alias("kind"), "oid"))
    if tree_entries is not None:
        from auditlake.operators.objects import tree_objects

        met = checkpointed(tree_objects(walk.nodes().select(F.col("at").alias("bundle_id"), "oid"), commits.select("id", "tree_oid").distinct(), tree_entries).select(F.col("bundle_id").alias("at"), "bundle_id.repo", "oid", "kind"))
        absent = met.join(objects.select("repo", "oid").distinct(), ["repo", "oid"], "left_anti").where("kind is not null")
        told = absent.select("at", F.when(F.col("kind") == "tree", "tree").otherwise("entry").alias("kind"), "oid")
        odd = met.where("kind = 'tree'").select("at", F.col("oid").alias("tree_oid")).join(tree_entries.where("child_kind is null"), "tree_oid").select("at", F.lit("unknown").alias("kind"), F.col("child_oid").alias("oid")).distinct()
        found = found.unionByName(told).unionByName(odd)
    return found.select("at.*", "kind", "oid")


def needed_by(found: DataFrame, heads: DataFrame, edges: DataFrame) -> DataFrame:
    """found(bundle_id, kind, oid) of kind head or parent with `reference`: the first of the bundle's heads that reaches it.

    The first head goes down the chains, the least of those that meet there, so a bundle is walked once whatever its heads.
    """
    found, reach = checkpointed(found), Reach(edges)
    ends = heads.join(found.select("bundle_id").distinct(), "bundle_id", "left_semi")
    least = reach.least(ends.select("bundle_id", F.col("oid").alias("node"), F.struct("head_index", "reference").alias("key")))
    asked = found.select("bundle_id", "oid").distinct().join(reach.places.toDF("oid", "chain", "at"), "oid", "left").withColumns({"chain": F.coalesce("chain", "oid"), "at": F.coalesce("at", F.lit(0))})
    first = asked.join(least, ["bundle_id", "chain"]).where("at <= pos and at > floor").select("bundle_id", "oid", "key.reference")
    return found.join(first, ["bundle_id", "oid"], "left")


def resolve_refs(refs: DataFrame, tags: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, ref_name, target_oid, commit_oid, error): symbolic refs followed, tags peeled; a missing ref has nulls.

    Chains are followed by doubling: after k rounds 2 ** k links. A ref in a circle of symbolic refs is an error row.
    """
    at = lambda c: F.struct("repo", F.col(c).alias("name"))
    links = refs.select(at("ref_name").alias("node"), F.when(F.col("target_oid").isNull() & F.col("symbolic_target").isNotNull(), at("symbolic_target")).alias("next"))
    ends = followed(links).select(F.col("node.repo").alias("repo"), F.col("node.name").alias("ref_name"), F.col("root.name").alias("end"), "circular")
    found = ends.join(refs.select("repo", F.col("ref_name").alias("end"), "target_oid"), ["repo", "end"], "left").drop("end")
    peeled = followed(tags.select(F.col("oid").alias("node"), F.col("target_oid").alias("next"))).select(F.col("node").alias("target_oid"), F.col("root").alias("peeled"))
    known = commits.select(F.col("id").cast("string").alias("last")).distinct().withColumn("is_commit", F.lit(True))
    rows = found.join(peeled, "target_oid", "left").withColumn("last", F.coalesce("peeled", "target_oid")).join(known, "last", "left")
    error = F.when(F.col("circular"), "symbolic refs form a circle").when(F.col("target_oid").isNotNull() & F.col("is_commit").isNull(), "target is not a commit")
    return rows.select("repo", "ref_name", "target_oid", F.when(F.col("is_commit"), F.col("last")).alias("commit_oid"), error.alias("error"))


def commit_entries(commits: DataFrame) -> DataFrame:
    """commits with defaults for what is absent and messages right-trimmed."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return commits.withColumns({"subject": text("subject", "<no subject>"), "message": F.coalesce(F.nullif(F.rtrim("message"), F.lit("")), F.lit("<no message>")), "author": text("author", "<unknown>")})


def range_labels(bundles: DataFrame, prereqs: DataFrame, heads: DataFrame) -> DataFrame:
    """(bundle_id, range_start, range_end): the id, '-' for none, or how many."""

    def label(rows: DataFrame, what: str, name: str) -> DataFrame:
        n = F.count("*")
        return rows.groupBy("bundle_id").agg(F.when(n == 1, F.min(F.col("oid").cast("string"))).otherwise(F.concat(F.lit(f"multiple {what} ("), n.cast("string"), F.lit(")"))).alias(name))

    return bundles.select("bundle_id").join(label(prereqs, "prerequisites", "range_start"), "bundle_id", "left").join(label(heads, "heads", "range_end"), "bundle_id", "left").fillna("-", ["range_start", "range_end"])


def head_base(heads: DataFrame, prereqs: DataFrame, edges: DataFrame) -> DataFrame:
    """heads with base_oid and error: the first parent without prerequisites, the one prerequisite, or of several the single ancestor."""
    first = edges.where("parent_index = 0").select(F.col("child").alias("oid"), F.col("parent").alias("first_parent"))
    per = prereqs.groupBy("bundle_id").agg(F.count("*").alias("n"), F.min("oid").alias("only"))
    many = heads.join(per.where("n > 1").select("bundle_id"), "bundle_id", "left_semi").select("bundle_id", F.col("oid").alias("start")).distinct()
    reach = Reach(edges)
    labels = reach.labels(many.select("start", F.col("start").alias("node")).distinct())
    # A chain's prerequisites are counted from its oldest commit up, so a head's label tells how many lie below it, and no pair of the two is formed.
    asked = prereqs.join(per.where("n > 1").select("bundle_id"), "bundle_id", "left_semi").select("bundle_id", F.col("oid").alias("node"))
    hits = reach.counted(labels.join(many, "start"), asked).groupBy("bundle_id", F.col("start").alias("oid")).agg(F.sum("n").alias("hits"), F.min("least").alias("hit"))
    rows = heads.join(per, "bundle_id", "left").join(first, "oid", "left").join(hits, ["bundle_id", "oid"], "left")
    n, h = F.coalesce("n", F.lit(0)), F.coalesce("hits", F.lit(0))
    base = F.when(n == 0, F.col("first_parent")).when(n == 1, F.col("only")).when(h == 1, F.col("hit"))
    error = F.when((n > 1) & (h == 0), "no prerequisite is an ancestor").when((n > 1) & (h > 1), "several prerequisites are ancestors")
    return rows.withColumns({"base_oid": base, "error": error}).drop("n", "only", "first_parent", "hits", "hit")


def _parents(edges: DataFrame) -> DataFrame:
    """(id, parent_oids), first parent first."""
    return edges.groupBy(F.col("child").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("parent_index", "parent"))), lambda x: x["parent"]).alias("parent_oids"))


def commit_chain(ranges: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(range_id, position, oid, tree_oid, parent_oids, subject, author, committer) of each range's commits, parents first."""
    inside = checkpointed(commit_range(ranges, edges).withColumnRenamed("node", "id"))
    nodes = inside.select("id").distinct()
    links = edges.join(nodes.withColumnRenamed("id", "child"), "child", "left_semi").join(nodes.withColumnRenamed("id", "parent"), "parent", "left_semi")
    gen = generations(nodes.withColumnRenamed("id", "node"), links).withColumnRenamed("node", "id")
    rows = inside.join(commits, "id").join(gen, "id").join(_parents(edges), "id", "left")
    rows = in_order(rows, ["range_id"], F.col("generation"), F.col("time"), F.col("id"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select("range_id", (F.col("number") - 1).alias("position"), F.col("id").alias("oid"), "tree_oid", F.coalesce("parent_oids", F.array().cast(dict(rows.dtypes)["parent_oids"])).alias("parent_oids"), text("subject"), text("author"), text("committer"))


def head_entries(heads: DataFrame, commits: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """(bundle_id, head_index, position, commit columns, files): each head's commits beyond its base, oldest first, with line stats.

    heads(bundle_id, head_index, oid, base_oid), stats(commit, path, additions, deletions).
    """
    ranges = heads.select(F.struct("bundle_id", "head_index").alias("range_id"), F.col("oid").alias("tip"), F.col("base_oid").alias("hidden"))
    chain = commit_chain(ranges, commit_entries(commits.withColumn("committer", F.col("author"))), edges)
    files = stats.groupBy(F.col("commit").alias("oid")).agg(F.array_sort(F.collect_list(F.struct("path", "additions", "deletions"))).alias("files"))
    rows = chain.join(files, "oid", "left").join(commit_entries(commits).select(F.col("id").alias("oid"), "message"), "oid")
    none = F.array().cast(files.schema["files"].dataType)
    return rows.select("range_id.*", "position", F.col("oid").alias("id"), "tree_oid", "parent_oids", "subject", "message", "author", F.coalesce("files", none).alias("files"))
