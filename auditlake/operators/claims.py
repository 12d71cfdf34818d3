"""Claims about packages and their verification; documents as rows.

Tables: claims(bundle_id, schema_version, size_bytes, sha256, version, prereqs, heads, tip_ref, range_to), bundles(bundle_id,
size_bytes, sha256, version), claimed and actual rows with an ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify_integrity(claims: DataFrame, bundles: DataFrame) -> DataFrame:
    """The first rule a claim breaks, with what is claimed and what is so; both null when all hold.

    claims and bundles carry `prereqs` (ordered ids) and `heads` (ordered 'id ref' strings) as arrays.
    """
    b = bundles.select("bundle_id", *[F.col(c).alias(f"own_{c}") for c in ("size_bytes", "sha256", "version", "prereqs", "heads")])
    rows = claims.join(b, "bundle_id", "left")
    say = lambda what, c: F.concat(F.lit(f"{what}: metadata="), F.col(c).cast("string"), F.lit(", actual="), F.col(f"own_{c}").cast("string"))
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"own_{c}"))
    tip = F.concat_ws(" ", F.col("range_to").cast("string"), F.col("tip_ref"))
    rule = (
        F.when(F.coalesce("schema_version", F.lit("")) != "1", F.concat(F.lit("unsupported schema version: '"), F.coalesce("schema_version", F.lit("")), F.lit("'")))
        .when(F.col("own_sha256").isNull(), "bundle is missing")
        .when(differ("size_bytes"), say("bundle size mismatch", "size_bytes"))
        .when(differ("sha256"), say("bundle sha256 mismatch", "sha256"))
        .when(differ("version"), say("bundle header version mismatch", "version"))
        .when(differ("prereqs"), "bundle prerequisites mismatch between metadata and bundle header")
        .when(differ("heads"), "bundle heads mismatch between metadata and bundle header")
        .when(~F.array_contains("own_heads", tip), "metadata tip_ref/range_to_oid must match one bundle head entry")
    )
    return rows.select("bundle_id", rule.alias("failure"), rule.isNull().alias("ok"))


def verify_patch(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Claims with a patch record against files(bundle_id, patch_size, patch_sha256); claims without one pass."""
    rows = claims.join(files.select("bundle_id", F.col("patch_size").alias("own_size"), F.col("patch_sha256").alias("own_sha")), "bundle_id", "left")
    rule = (
        F.when(F.col("patch_format").isNull(), F.lit(None).cast("string"))
        .when(F.col("patch_format") != "unified-diff", F.concat(F.lit("unsupported patch sidecar format: '"), "patch_format", F.lit("'")))
        .when(F.col("own_sha").isNull(), "patch sidecar is missing")
        .when(F.col("patch_size") != F.col("own_size"), F.concat(F.lit("patch sidecar size mismatch: metadata="), F.col("patch_size").cast("string"), F.lit(", actual="), F.col("own_size").cast("string")))
        .when(F.col("patch_sha256") != F.col("own_sha"), F.concat(F.lit("patch sidecar sha256 mismatch: metadata="), "patch_sha256", F.lit(", actual="), "own_sha"))
    )
    return rows.select("bundle_id", rule.alias("failure"))


def mismatched_rows(claimed: DataFrame, actual: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that a claim and the recomputed truth do not have alike at one ordinal: claimed, actual and which is absent."""
    a = claimed.select(*key, F.struct(*columns).alias("claimed"))
    b = actual.select(*key, F.struct(*columns).alias("actual"))
    rows = a.join(b, key, "full").where(~F.col("claimed").eqNullSafe(F.col("actual")))
    return rows.select(*key, F.when(F.col("claimed").isNull(), "not claimed").when(F.col("actual").isNull(), "not so").otherwise("different").alias("mismatch"))


def build_claims(bundles: DataFrame, chain: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle_id, json): one document per bundle from bundles(bundle_id, ...), chain(bundle_id, pos, ...) and files(bundle_id, pos, ...), in order.

    Other columns are the document's fields as they are named, null ones kept; a bundle without commits or files has empty lists.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        inner = [c for c in rows.columns if c not in ("bundle_id", "pos")]
        return rows.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*inner).alias("x")))), lambda x: x["x"]).alias(name))

    rows = bundles.join(listed(chain, "commit_chain"), "bundle_id", "left").join(listed(files, "changed_files"), "bundle_id", "left")
    some = lambda n: F.coalesce(n, F.from_json(F.lit("[]"), rows.schema[n].dataType)).alias(n)
    body = F.struct(F.lit("1").alias("schema_version"), *[some(c) if c in ("commit_chain", "changed_files") else F.col(c) for c in rows.columns if c != "bundle_id"])
    return rows.select("bundle_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def entry_fields(ledger: DataFrame) -> DataFrame:
    """Rows of read packs (sources.ingest_packs, with resolved and note) under the names that an audit document's entries have."""
    distance = F.col("base_distance").cast("string")
    base = F.when(F.col("kind") == "ofs-delta", F.concat_ws("@", F.concat(F.lit("ofs:"), distance), F.col("base_offset").cast("string"))).when(F.col("kind") == "ref-delta", F.concat(F.lit("oid:"), "base_oid"))
    return ledger.select("bundle_id", "idx", F.col("offs").alias("offset"), "kind", "out_size", "reconstructed_size", base.alias("base"), "result_oid", "result_kind", "resolved", "resolved_via", "note")


def proof_fields(proofs: DataFrame, checks: DataFrame) -> DataFrame:
    """proofs under the names of an audit document's proof, with pack version and checksums of checks, the pack preflight's rows."""
    own = checks.select("bundle_id", "pack_version", F.col("computed_checksum").alias("computed_pack_checksum"), F.col("trailer_checksum").alias("trailer_pack_checksum"))
    rows = proofs.join(own, "bundle_id")
    counts = ["entries_declared", "entries_parsed", "entries_materialized", "unique_objects_materialized", "duplicate_entry_count_materialized", "checksum_verified", "thin_pack_detected", "baseline_resolutions_count", "transfer_allowed", "blocked_reason"]
    return rows.select("bundle_id", "verification_status", "pack_version", F.col("entries_declared").alias("declared_object_count"), F.col("entries_parsed").alias("processed_object_count"), *counts, F.lit("sha1").alias("hash_algorithm"), "computed_pack_checksum", "trailer_pack_checksum")


def write_documents(docs: DataFrame, folder: str, name: str = "bundle_id", column: str = "json") -> None:
    """Writes docs as lines of JSON, a document and its bundle's name on each, in files of even size that appear together or not at all."""
    docs.select(F.col(name).cast("string").alias("name"), F.col(column).alias("document")).hint("rebalance").write.json(folder)


def read_documents(spark, folder: str, schema: str) -> DataFrame:
    """(name, doc, error) of documents that write_documents wrote; see told_documents."""
    return told_documents(spark.read.schema("name string, document string").json(folder), "document", schema)


def load_claims(spark, paths, schema: str) -> DataFrame:
    """(path, doc, error) of files with one document each, but for files of no bytes, which Spark does not read; see told_documents."""
    rows = spark.read.text(paths, wholetext=True)
    return told_documents(rows.select(rows.metadataColumn("_metadata")["file_path"].alias("path"), "value"), "value", schema)


def told_documents(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the document in `column` read by the schema as `doc`, or null and an `error`; one bad document spoils no other.

    Refused are what is no JSON, has a value of another type than the schema's, or is of another schema version.
    """
    read = rows.withColumn("doc", F.from_json(column, f"{schema}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})).drop(column)
    version = F.coalesce("doc.schema_version", F.lit(""))
    error = F.when(F.col("doc").isNull() | F.col("doc._unread").isNotNull(), "document is not as its schema says").when(version != "1", F.concat(F.lit("unsupported schema version: '"), version, F.lit("'")))
    return read.withColumn("error", error).withColumn("doc", F.when(F.col("error").isNull(), F.col("doc").dropFields("_unread")))


def report_tables(proofs: DataFrame, transport: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
    """The sections of an audit report, with yes and no."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    return {
        "proof": proofs.select("bundle_id", F.col("verification_status").alias("status"), "entries_declared", "entries_parsed", "entries_materialized", yes("checksum_verified").alias("checksum_verified"), yes("thin_pack_detected").alias("thin_pack"), yes("transfer_allowed").alias("transfer_allowed"), F.coalesce("blocked_reason", F.lit("-")).alias("blocked_reason")),
        "transport": transport.select("name", "size_bytes", "sha256"),
        "objects": inventory.select("bundle_id", "oid", "kind", "size_bytes", yes("reachable").alias("reachable"), F.coalesce("path", F.lit("-")).alias("path")),
    }


def verify_truth(claims: DataFrame, known: DataFrame, guard: DataFrame, chain: tuple[DataFrame, DataFrame], files: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(bundle_id, failure) of claims(bundle_id, range_from, range_to): the first thing that is not as claimed, null if all is.

    known(oid) are commits that exist, guard(bundle_id, linear) says whether the range's end descends from its beginning;
    chain and files are claimed and recomputed rows(bundle_id, pos, ...), which must be alike in content and order.
    """
    here = known.select("oid").distinct()
    ends = claims
    for c in ("range_from", "range_to"):
        ends = ends.join(here.select(F.col("oid").alias(c), F.lit(True).alias(f"{c}_here")), c, "left")

    def differing(pair: tuple[DataFrame, DataFrame], name: str) -> DataFrame:
        columns = [c for c in pair[0].columns if c not in ("bundle_id", "pos")]
        return mismatched_rows(*pair, ["bundle_id", "pos"], columns).groupBy("bundle_id").agg(F.min("pos").alias(name))

    rows = ends.join(guard.select("bundle_id", "linear"), "bundle_id", "left").join(differing(chain, "chain_pos"), "bundle_id", "left").join(differing(files, "file_pos"), "bundle_id", "left")
    at = lambda what, c: F.concat(F.lit(f"{what} differs from the repository at position "), F.col(c).cast("string"))
    rule = (
        F.when(F.col("range_from_here").isNull(), "range_from_oid does not exist")
        .when(F.col("range_to_here").isNull(), "range_to_oid does not exist")
        .when(~F.coalesce("linear", F.lit(False)), "range_to_oid does not descend from range_from_oid")
        .when(F.col("chain_pos").isNotNull(), at("commit_chain", "chain_pos"))
        .when(F.col("file_pos").isNotNull(), at("changed_files", "file_pos"))
    )
    return rows.select("bundle_id", rule.alias("failure"))


def audit_document(bundles: DataFrame, heads: DataFrame, prereqs: DataFrame, transport: DataFrame, proofs: DataFrame, ledger: DataFrame, inventory: DataFrame, details: DataFrame, ledger_mode: str = "summary", detail_mode: str = "light") -> DataFrame:
    """(bundle_id, document): a package's audit as JSON, null values kept.

    ledger(bundle_id, section, idx, ...) are a ledger export's rows by section; object rows are left out only where there
    is neither a ledger nor detail, details(bundle_id, oid, ...) only come with detail mode full.
    """

    def listed(rows: DataFrame, name: str, order: list[str], *columns) -> DataFrame:
        return rows.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{c}") for c in order], F.struct(*columns).alias("x")))), lambda r: r["x"]).alias(name))

    entry = [c for c in ledger.columns if c not in ("bundle_id", "section")]
    sections = {"first_entries": "first", "last_entries": "last", "unresolved_entry_rows": "unresolved", "entries": "entries"}
    parts = [listed(ledger.where(F.col("section") == s), n, ["idx"], *entry) for n, s in sections.items()]
    parts += [listed(heads, "heads", ["head_index"], "oid", "reference"), listed(prereqs, "prerequisites", ["pos"], "oid"), listed(transport, "transport_entries", ["name"], "name", "size_bytes", "sha256")]
    shown = inventory if (detail_mode, ledger_mode) != ("light", "none") else inventory.where("false")
    parts.append(listed(shown, "pack_objects", ["position"], "oid", "kind", "size_bytes", F.col("reachable").alias("reachable_from_heads"), F.col("head_index").alias("context_head_index"), F.col("commit_order").alias("context_commit_order"), F.col("path").alias("context_path")))
    told = [c for c in details.columns if c != "bundle_id"]
    parts.append(listed(details if detail_mode == "full" else details.where("false"), "object_details", ["oid"], *told))
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_objects")
    known = ["commit", "tree", "blob", "tag"]
    summary = inventory.groupBy("bundle_id").agg(F.count("*").alias("total_objects"), F.count_if("reachable").alias("reachable_objects"), F.count_if(~F.col("reachable")).alias("unreachable_objects"), *[of(k) for k in known], F.count_if(~F.col("kind").isin(known)).alias("unknown_objects"))
    proof = proofs.select("bundle_id", F.struct(*[c for c in proofs.columns if c != "bundle_id"]).alias("pack_proof"))
    rows = bundles.join(proof, "bundle_id", "left").join(summary.select("bundle_id", F.struct(*summary.columns[1:]).alias("pack_summary")), "bundle_id", "left")
    for part in parts:
        rows = rows.join(part, "bundle_id", "left")
    some = lambda n: F.coalesce(F.col(n), F.from_json(F.lit("[]"), rows.schema[n].dataType)).alias(n)
    own = [c for c in bundles.columns if c != "bundle_id"]
    book = F.struct(F.lit(ledger_mode).alias("mode"), F.col("pack_proof.entries_declared").alias("declared_entries"), F.col("pack_proof.entries_parsed").alias("parsed_entries"), F.size(some("unresolved_entry_rows")).alias("unresolved_entries"), *[some(n) for n in sections])
    body = F.struct(F.lit("1").alias("schema_version"), *own, F.transform(some("prerequisites"), lambda x: x["oid"]).alias("prerequisites"), some("heads"), some("transport_entries"), "pack_proof", book.alias("entry_ledger"), "pack_summary", some("pack_objects"), F.lit(detail_mode).alias("object_detail_mode"), some("object_details"))
    return rows.select("bundle_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
