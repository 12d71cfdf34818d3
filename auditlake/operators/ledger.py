"""Accounting of a package's entries: bases, chains, what blocks a transfer, the proof and its rules.

Tables: ledger(bundle_id, idx, offs, kind, out_size, base_offset, base_oid, oid), declared(bundle_id, declared).
An entry's oid is the id its object has once it is rebuilt. Every join and grouping has bundle_id in its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rows shown at either end of a ledger in summary mode.
EDGE = 20
#: Bytes before a pack's first entry.
PACK_HEADER = 12


def resolve_bases(ledger: DataFrame, baseline: DataFrame | None, mode: str = "baseline") -> DataFrame:
    """ledger with base_idx, resolved, resolved_via and note.

    An ofs-delta's base is the entry at its base offset; a ref-delta's the latest earlier entry with its base id, or in
    baseline mode an object of the receiver.
    """
    at = ledger.select("bundle_id", F.col("offs").alias("base_offset"), F.col("idx").alias("ofs_idx"))
    key = ["bundle_id", "idx"]
    # Entries under their own id and deltas under their base's, in order: the last entry before a delta is its base.
    named = ledger.where("oid is not null").select("bundle_id", F.col("oid").alias("id"), "idx", F.col("idx").alias("o_idx"))
    refs = ledger.where("kind = 'ref-delta'").select("bundle_id", F.col("base_oid").alias("id"), "idx", F.lit(None).cast("long").alias("o_idx"))
    before = W.Window.partitionBy("bundle_id", "id").orderBy("idx").rangeBetween(W.Window.unboundedPreceding, -1)
    asked = refs.withColumn("ask", F.lit(True)).unionByName(named.withColumn("ask", F.lit(False)))
    earlier = asked.withColumn("ref_idx", F.max("o_idx").over(before)).where("ask").select(*key, "ref_idx")
    found = ledger.join(at, ["bundle_id", "base_offset"], "left").join(earlier, key, "left")
    if mode == "baseline" and baseline is not None:
        known = baseline.select(F.col("oid").alias("base_oid")).distinct().withColumn("known", F.lit(True))
        found = found.join(known, "base_oid", "left")
    else:
        found = found.withColumn("known", F.lit(None).cast("boolean"))
    ofs, ref = F.col("kind") == "ofs-delta", F.col("kind") == "ref-delta"
    via = F.when(~ofs & ~ref, "in-pack").when(ofs & F.col("ofs_idx").isNotNull(), "in-pack").when(ref & F.col("ref_idx").isNotNull(), "in-pack").when(ref & F.col("known"), "baseline")
    note = F.when(ofs, F.concat(F.lit("ofs-delta references unresolved base at distance "), (F.col("offs") - F.col("base_offset")).cast("string"), F.lit(" (external dependency/thin pack)"))).when(ref, F.concat(F.lit("ref-delta references unresolved base object "), F.coalesce("base_oid", F.lit("")), F.lit(" (external dependency/thin pack)")))
    return found.withColumns({"base_idx": F.when(ofs, F.col("ofs_idx")).when(ref, F.col("ref_idx")), "resolved_via": via}).withColumns({"resolved": F.col("resolved_via").isNotNull(), "note": F.when(F.col("resolved_via").isNull(), note)}).select(*ledger.columns, "base_idx", "resolved", "resolved_via", "note")


def delta_chains(resolved: DataFrame, baseline_kinds: DataFrame | None = None, rounds: int = 32) -> DataFrame:
    """bundle_id, idx, depth and result_kind: the kind of the entry at the chain's root, null where the chain breaks.

    Pointers to bases are doubled each round, so a chain of length n takes log n joins. A chain that ends in an object of
    the receiver (resolved without base_idx) takes that object's kind, blob unless baseline_kinds(oid, kind) says otherwise.
    """
    from auditlake.operators.iterate import checkpointed

    delta = F.col("kind").isin("ofs-delta", "ref-delta")
    kinds = resolved.select("bundle_id", "idx", "kind", "resolved", "resolved_via", "base_oid", "base_idx")
    if baseline_kinds is not None:
        kinds = kinds.join(baseline_kinds.select(F.col("oid").alias("base_oid"), F.col("kind").alias("outer_kind")), "base_oid", "left")
    else:
        kinds = kinds.withColumn("outer_kind", F.lit("blob"))
    root = F.when(~delta, F.col("kind")).when(F.col("resolved_via") == "baseline", F.col("outer_kind"))
    now = checkpointed(kinds.select("bundle_id", "idx", F.when(F.col("resolved_via") == "in-pack", F.col("base_idx")).alias("next"), root.alias("result_kind"), F.when(delta, 1).otherwise(0).alias("depth")))
    for _ in range(rounds):
        if now.where("next is not null").isEmpty():
            return now.drop("next").select("bundle_id", "idx", "depth", "result_kind")
        that = now.select("bundle_id", F.col("idx").alias("next"), F.col("next").alias("n2"), F.col("result_kind").alias("k2"), F.col("depth").alias("d2"))
        now = checkpointed(now.join(that, ["bundle_id", "next"], "left").select("bundle_id", "idx", F.col("n2").alias("next"), F.coalesce("result_kind", "k2").alias("result_kind"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")))
    raise RuntimeError("a delta chain does not end: its bases form a cycle")


def blocked_at(resolved: DataFrame) -> DataFrame:
    """Per blocked bundle: blocked_idx, reason and the number of entries before it."""
    return resolved.where("not resolved").groupBy("bundle_id").agg(F.min("idx").alias("blocked_idx"), F.min_by("note", "idx").alias("reason")).withColumn("entries_before", F.col("blocked_idx"))


def cut_ledger(resolved: DataFrame) -> DataFrame:
    """The entries that were parsed: up to and with the first unresolved one of each bundle."""
    first = blocked_at(resolved).select("bundle_id", "blocked_idx")
    return resolved.join(first, "bundle_id", "left").where("blocked_idx is null or idx <= blocked_idx").drop("blocked_idx")


def framing_check(ledger: DataFrame, bundles: DataFrame) -> DataFrame:
    """bundles(bundle_id, declared, trailer_offset): how many entries are missing, the bytes between the last entry and the trailer, and after how many entries no other follows at once.

    ledger(bundle_id, offs, end_offs) has where each entry begins and ends; an entry without an end was not read. A pack's
    entries begin after its header.
    """
    read = ledger.where("end_offs is not null").select("bundle_id", "offs", "end_offs")
    # An entry's end must be where another begins, unless it is the last one's.
    begins = read.select("bundle_id", F.col("offs").alias("at")).distinct()
    ends = read.select("bundle_id", F.col("end_offs").alias("at")).unionByName(bundles.select("bundle_id", F.lit(PACK_HEADER).cast("long").alias("at")))
    loose = ends.join(begins, ["bundle_id", "at"], "left_anti").groupBy("bundle_id").agg(F.count("*").alias("loose"))
    per = read.groupBy("bundle_id").agg(F.count("*").alias("parsed"), F.max("end_offs").alias("last_end"))
    joined = bundles.join(per, "bundle_id", "left").join(loose, "bundle_id", "left").fillna(0, ["parsed", "loose"]).withColumns({"last_end": F.coalesce("last_end", F.lit(PACK_HEADER).cast("long"))}).withColumn("gaps", F.greatest(F.col("loose") - 1, F.lit(0)))
    status = F.when(F.col("parsed") < F.col("declared"), "entries missing").when(F.col("gaps") > 0, "gap between entries").when(F.col("last_end") < F.col("trailer_offset"), "trailing bytes").otherwise("ok")
    return joined.select("bundle_id", "declared", "parsed", (F.col("trailer_offset") - F.col("last_end")).alias("bytes_left"), "gaps", status.alias("status"))


def is_materialised():
    """Resolved, with id, kind, size and source."""
    return F.col("resolved") & F.col("oid").isNotNull() & F.col("kind").isNotNull() & F.col("out_size").isNotNull() & F.col("resolved_via").isNotNull()


def object_index(resolved: DataFrame) -> DataFrame:
    """Per bundle and oid the first materialised entry: first_entry_idx, kind, size_bytes, copies."""
    rows = resolved.where(is_materialised())
    return rows.groupBy("bundle_id", "oid").agg(F.min("idx").alias("first_entry_idx"), F.min_by("kind", "idx").alias("kind"), F.min_by("out_size", "idx").alias("size_bytes"), F.count("*").alias("copies"))


def index_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("bundle_id").agg(F.sum("copies").alias("materialised"), F.count("*").alias("unique_objects"), (F.sum("copies") - F.count("*")).alias("duplicates"))


def proof(resolved: DataFrame, declared: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Counters and verdict of each bundle, on its ledger as cut at the first unresolved entry.

    checks(bundle_id, checksum_verified) comes from the pack preflight; without it checksums count as verified.
    """
    cut = cut_ledger(resolved)
    ok = is_materialised()
    per = cut.groupBy("bundle_id").agg(
        F.count("*").alias("entries_parsed"),
        F.count_if(ok).alias("entries_materialized"),
        F.count_if(F.col("resolved_via") == "baseline").alias("baseline_resolutions_count"),
        F.coalesce(F.bool_or(F.col("resolved_via") == "baseline"), F.lit(False)).alias("thin_pack_detected"),
    )
    # Distinct ids are counted after a grouping of their own, which has no hot key but a hot bundle's partial counts.
    unique = cut.where(ok).select("bundle_id", "oid").distinct().groupBy("bundle_id").agg(F.count("*").alias("unique_objects_materialized"))
    first = blocked_at(resolved).select("bundle_id", "blocked_idx", "reason")
    rows = declared.select("bundle_id", F.col("declared").alias("entries_declared")).join(per, "bundle_id", "left").join(unique, "bundle_id", "left").join(first, "bundle_id", "left").fillna(0, ["entries_parsed", "entries_materialized", "baseline_resolutions_count", "unique_objects_materialized"]).fillna(False, ["thin_pack_detected"])
    rows = rows.join(checks, "bundle_id", "left").fillna(False, ["checksum_verified"]) if checks is not None else rows.withColumn("checksum_verified", F.lit(True))
    allowed = F.col("entries_materialized") == F.col("entries_declared")
    short = F.concat(F.lit("materialized entries below declared count: materialized="), F.col("entries_materialized").cast("string"), F.lit(", declared="), F.col("entries_declared").cast("string"))
    return rows.select(
        "bundle_id",
        F.when(~F.col("checksum_verified"), "failed").when(allowed, "ok").otherwise("blocked").alias("verification_status"),
        "entries_declared",
        "entries_parsed",
        "entries_materialized",
        "unique_objects_materialized",
        (F.col("entries_materialized") - F.col("unique_objects_materialized")).alias("duplicate_entry_count_materialized"),
        "checksum_verified",
        "thin_pack_detected",
        "baseline_resolutions_count",
        allowed.alias("transfer_allowed"),
        F.when(~allowed, F.coalesce("reason", short)).alias("blocked_reason"),
        "blocked_idx",
    )


def proof_violations(proofs: DataFrame, ledger_counts: DataFrame, index: DataFrame) -> DataFrame:
    """The first violated rule of each bundle, and all of them.

    ledger_counts(bundle_id, ledger_declared, ledger_entries), index(bundle_id, materialised, unique_objects, duplicates).
    """
    rows = proofs.join(ledger_counts, "bundle_id", "left").join(index, "bundle_id", "left").fillna(0, ["ledger_declared", "ledger_entries", "materialised", "unique_objects", "duplicates"])

    def differ(text: str, a: str, an: str, b: str, bn: str):
        return F.when(F.col(an) != F.col(bn), F.concat(F.lit(f"{text}: {a}="), F.col(an).cast("string"), F.lit(f", {b}="), F.col(bn).cast("string")))

    rules = F.array(
        differ("proof/ledger declared mismatch", "proof", "entries_declared", "ledger", "ledger_declared"),
        differ("proof/ledger parsed mismatch", "proof", "entries_parsed", "ledger", "ledger_entries"),
        differ("parsed entries below declared count", "parsed", "entries_parsed", "declared", "entries_declared"),
        differ("materialized entry count mismatch", "index", "materialised", "proof", "entries_materialized"),
        differ("unique object count mismatch", "index", "unique_objects", "proof", "unique_objects_materialized"),
        differ("duplicate materialized count mismatch", "index", "duplicates", "proof", "duplicate_entry_count_materialized"),
        F.when(~F.col("checksum_verified"), "pack checksum verification failed"),
        F.when(~F.col("transfer_allowed"), F.coalesce("blocked_reason", F.lit("transfer gate blocked"))),
    )
    broken = F.filter(rules, lambda r: r.isNotNull())
    return rows.select("bundle_id", "transfer_allowed", F.get(broken, F.lit(0)).alias("violation"), F.size(broken).cast("long").alias("n_violations"), F.when((F.size(broken) > 0) & (F.col("ledger_entries") > 0), F.col("ledger_entries") - 1).alias("last_idx"))


def ledger_sections(resolved: DataFrame, mode: str = "summary", edge: int = EDGE) -> DataFrame:
    """Rows of a ledger export, each with its section; none in mode none."""
    if mode == "none":
        return resolved.where(F.lit(False)).withColumn("section", F.lit("").cast("string"))
    if mode == "full":
        return resolved.withColumn("section", F.lit("entries"))
    last = W.Window.partitionBy("bundle_id")
    rows = resolved.withColumn("n", F.max("idx").over(last) + 1)
    sections = F.array_compact(F.array(F.when(F.col("idx") < edge, "first"), F.when(F.col("idx") >= F.col("n") - edge, "last"), F.when(~F.col("resolved"), "unresolved")))
    return rows.withColumn("section", F.explode(sections)).drop("n")


def ledger_counts(resolved: DataFrame, declared: DataFrame) -> DataFrame:
    per = resolved.groupBy("bundle_id").agg(F.count("*").alias("parsed"), F.count_if(~F.col("resolved")).alias("unresolved"))
    return declared.join(per, "bundle_id", "left").fillna(0, ["parsed", "unresolved"])


def encode_ledger(resolved: DataFrame) -> DataFrame:
    """Export rows; base as ofs:<distance>@<offset>, ofs:<distance> or oid:<oid>."""
    distance = (F.col("offs") - F.col("base_offset")).cast("string")
    base = F.when(F.col("kind") == "ofs-delta", F.when(F.col("base_idx").isNotNull(), F.concat(F.lit("ofs:"), distance, F.lit("@"), F.col("base_offset").cast("string"))).otherwise(F.concat(F.lit("ofs:"), distance))).when(F.col("base_oid").isNotNull(), F.concat(F.lit("oid:"), "base_oid"))
    return resolved.select("bundle_id", "idx", F.col("offs").alias("offset_bytes"), "kind", "out_size", base.alias("base"), F.when(F.col("resolved"), F.col("oid")).alias("result_oid"), "resolved", "resolved_via", "note")


def proof_summary(proofs: DataFrame) -> DataFrame:
    """Texts and gates of a proof's overview."""
    counts = F.col("entries_declared") == F.col("entries_parsed")
    ratio = lambda a: F.concat(F.col(a).cast("string"), F.lit("/"), F.col("entries_declared").cast("string"))
    ok = (F.lower("verification_status") == "ok") & counts & F.col("checksum_verified")
    transfer = F.when(F.col("transfer_allowed"), "allowed").otherwise(F.concat(F.lit("blocked ("), F.coalesce("blocked_reason", F.lit("entries not fully materialized")), F.lit(")")))
    return proofs.select(
        "bundle_id",
        F.when(ok, "OK").otherwise("FAILED").alias("status"),
        ratio("entries_parsed").alias("parsed"),
        ratio("entries_materialized").alias("materialized"),
        transfer.alias("transfer"),
        F.when(F.col("checksum_verified"), "match").otherwise("mismatch").alias("checksum"),
        F.when(F.col("thin_pack_detected"), "yes").otherwise("no").alias("thin"),
        F.col("baseline_resolutions_count").cast("string").alias("baseline_resolutions"),
    )


def supported_formats(repos: DataFrame) -> DataFrame:
    """repos(repo, object_format) with `supported`: only sha1, in any case, and the default."""
    return repos.withColumn("supported", F.lower(F.coalesce("object_format", F.lit("sha1"))) == "sha1")


def pack_preflight(bundles: DataFrame, pack: str = "pack") -> DataFrame:
    """bundles with the first failing rule on the pack's bytes, its version, declared count and checksums."""
    p = F.col(pack)
    n = F.octet_length(p)
    number = lambda at: F.conv(F.hex(F.substring(p, at, 4)), 16, 10).cast("long")
    version, count = F.when(n >= 12, number(5)), F.when(n >= 12, number(9))
    own = F.when(n >= 32, F.sha1(F.substr(p, F.lit(1), n - 20)))
    trailer = F.when(n >= 32, F.lower(F.hex(F.substr(p, n - 19, F.lit(20)))))
    rows = bundles.withColumns({"pack_version": version, "declared": count, "computed_checksum": own, "trailer_checksum": trailer, "magic": F.substring(p, 1, 4)})
    rule = (
        F.when(F.coalesce(n, F.lit(0)) < 32, "pack payload is too small")
        .when(F.col("magic") != F.lit(b"PACK"), "pack payload does not start with PACK header")
        .when(~F.col("pack_version").isin(2, 3), F.concat(F.lit("unsupported pack version: "), F.col("pack_version").cast("string")))
        .when(F.col("computed_checksum") != F.col("trailer_checksum"), F.concat(F.lit("pack trailer checksum mismatch: computed="), "computed_checksum", F.lit(", trailer="), "trailer_checksum"))
    )
    return rows.withColumns({"failure": rule, "checksum_verified": F.coalesce(F.col("computed_checksum") == F.col("trailer_checksum"), F.lit(False))}).drop("magic")
