"""Queries on package entries: bases, chains, blocks, proofs, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import ledger as L
from auditlake.operators.iterate import checkpointed
from auditlake.plans.registry import query
from auditlake.plans.views import duck, view

RESOLVED = """+ own AS (SELECT bundle_id, offs AS base_offset, idx AS ofs_idx FROM ledger),
refs AS (SELECT r.bundle_id, r.idx, max(o.idx) AS ref_idx FROM ledger r JOIN ledger o ON r.bundle_id = o.bundle_id AND r.base_oid = o.oid AND o.idx < r.idx WHERE r.kind = 'ref-delta' GROUP BY ALL),
found AS (SELECT l.*, CASE l.kind WHEN 'ofs-delta' THEN ofs_idx WHEN 'ref-delta' THEN ref_idx END AS base_idx,
  CASE WHEN l.kind NOT IN ('ofs-delta', 'ref-delta') THEN 'in-pack' WHEN l.kind = 'ofs-delta' AND ofs_idx IS NOT NULL THEN 'in-pack'
       WHEN l.kind = 'ref-delta' AND ref_idx IS NOT NULL THEN 'in-pack' WHEN l.kind = 'ref-delta' AND b.oid IS NOT NULL THEN 'baseline' END AS resolved_via
  FROM ledger l LEFT JOIN own USING (bundle_id, base_offset) LEFT JOIN refs ON refs.bundle_id = l.bundle_id AND refs.idx = l.idx LEFT JOIN baseline b ON b.oid = l.base_oid),
resolved AS (SELECT *, resolved_via IS NOT NULL AS resolved, CASE WHEN resolved_via IS NULL THEN CASE kind
    WHEN 'ofs-delta' THEN concat('ofs-delta references unresolved base at distance ', offs - base_offset, ' (external dependency/thin pack)')
    WHEN 'ref-delta' THEN concat('ref-delta references unresolved base object ', coalesce(base_oid, ''), ' (external dependency/thin pack)') END END AS note FROM found),
first AS (SELECT bundle_id, min(idx) AS blocked_idx, arg_min(note, idx) AS reason FROM resolved WHERE NOT resolved GROUP BY bundle_id),
cut AS (SELECT r.* FROM resolved r LEFT JOIN first USING (bundle_id) WHERE blocked_idx IS NULL OR idx <= blocked_idx),
counted AS (SELECT bundle_id, count(*) AS parsed, count(*) FILTER (resolved) AS done, count(*) FILTER (resolved_via = 'baseline') AS nb, count(DISTINCT oid) FILTER (resolved) AS uniq FROM cut GROUP BY bundle_id),
proof AS (SELECT d.bundle_id, CASE WHEN done = declared THEN 'ok' ELSE 'blocked' END AS verification_status, declared AS entries_declared, parsed AS entries_parsed, done AS entries_materialized,
  uniq AS unique_objects_materialized, done - uniq AS duplicate_entry_count_materialized, true AS checksum_verified, nb > 0 AS thin_pack_detected, nb AS baseline_resolutions_count, done = declared AS transfer_allowed,
  CASE WHEN done <> declared THEN coalesce(reason, concat('materialized entries below declared count: materialized=', done, ', declared=', declared)) END AS blocked_reason, blocked_idx
  FROM declared d JOIN counted USING (bundle_id) LEFT JOIN first USING (bundle_id)),
"""
_VIEWS = ["ledger", "baseline", "declared"]


def _sql(body: str) -> str:
    return duck(_VIEWS, RESOLVED.rstrip().rstrip(",") + "\n" + body)


def _resolved(spark, sf):
    return checkpointed(L.resolve_bases(view(spark, sf, "ledger"), view(spark, sf, "baseline")))


@query("resolve_bases", _sql("SELECT bundle_id, idx, kind, base_idx, resolved, resolved_via, note FROM resolved"))
def resolve_bases(spark, sf):
    return _resolved(spark, sf).select("bundle_id", "idx", "kind", "base_idx", "resolved", "resolved_via", "note")


@query("resolve_bases_pack_only", duck(["ledger"], RESOLVED.split("resolved AS")[0].strip().rstrip(",").replace("LEFT JOIN baseline b ON b.oid = l.base_oid", "LEFT JOIN (SELECT NULL::varchar AS oid WHERE false) b ON b.oid = l.base_oid") + " SELECT bundle_id, idx, base_idx, resolved_via FROM found"))
def resolve_bases_pack_only(spark, sf):
    return L.resolve_bases(view(spark, sf, "ledger"), None, "pack-only").select("bundle_id", "idx", "base_idx", "resolved_via")


@query(
    "delta_chains",
    duck(
        _VIEWS,
        RESOLVED.rstrip().rstrip(",")
        + """, chain AS (SELECT bundle_id, idx, CASE WHEN resolved_via = 'in-pack' THEN base_idx END AS nxt, 0 + (kind IN ('ofs-delta', 'ref-delta'))::int AS depth,
        CASE WHEN kind NOT IN ('ofs-delta', 'ref-delta') THEN kind WHEN resolved_via = 'baseline' THEN 'blob' END AS k FROM resolved
      UNION ALL SELECT c.bundle_id, c.idx, CASE WHEN r.resolved_via = 'in-pack' THEN r.base_idx END, c.depth + (r.kind IN ('ofs-delta', 'ref-delta'))::int,
        CASE WHEN r.kind NOT IN ('ofs-delta', 'ref-delta') THEN r.kind WHEN r.resolved_via = 'baseline' THEN 'blob' END
      FROM chain c JOIN resolved r ON r.bundle_id = c.bundle_id AND r.idx = c.nxt WHERE c.nxt IS NOT NULL)
    SELECT bundle_id, idx, depth, k AS result_kind FROM chain WHERE nxt IS NULL""",
        recursive=True,
    ),
)
def delta_chains(spark, sf):
    return L.delta_chains(_resolved(spark, sf))


@query("blocked_at", _sql("SELECT bundle_id, blocked_idx, reason, blocked_idx AS entries_before FROM first"))
def blocked_at(spark, sf):
    return L.blocked_at(_resolved(spark, sf))


@query("cut_ledger", _sql("SELECT bundle_id, idx, kind, resolved FROM cut"))
def cut_ledger(spark, sf):
    return L.cut_ledger(_resolved(spark, sf)).select("bundle_id", "idx", "kind", "resolved")


@query("materialised", _sql("SELECT bundle_id, idx, resolved AND oid IS NOT NULL AS materialised FROM resolved"))
def materialised(spark, sf):
    return _resolved(spark, sf).select("bundle_id", "idx", L.is_materialised().alias("materialised"))


@query("object_index", duck(["ledger_dup"], "SELECT bundle_id, oid, min(idx) AS first_entry_idx, 'blob' AS kind, arg_min(out_size, idx) AS size_bytes, count(*) AS copies FROM ledger_dup GROUP BY bundle_id, oid"))
def object_index(spark, sf):
    return L.object_index(view(spark, sf, "ledger_dup"))


@query("object_index_counts", duck(["ledger_dup"], "SELECT bundle_id, count(*) AS materialised, count(DISTINCT oid) AS unique_objects, count(*) - count(DISTINCT oid) AS duplicates FROM ledger_dup GROUP BY bundle_id"))
def object_index_counts(spark, sf):
    return L.index_counts(L.object_index(view(spark, sf, "ledger_dup")))


@query("proof", _sql("SELECT * FROM proof"))
def proof(spark, sf):
    return L.proof(_resolved(spark, sf), view(spark, sf, "declared"))


@query(
    "proof_violations",
    _sql("""SELECT bundle_id, transfer_allowed, CASE WHEN entries_parsed <> entries_declared THEN concat('parsed entries below declared count: parsed=', entries_parsed, ', declared=', entries_declared)
       WHEN NOT transfer_allowed THEN blocked_reason END AS violation, (entries_parsed <> entries_declared)::bigint + (NOT transfer_allowed)::bigint AS n_violations,
       CASE WHEN entries_parsed <> entries_declared OR NOT transfer_allowed THEN entries_parsed - 1 END AS last_idx FROM proof"""),
)
def proof_violations(spark, sf):
    resolved, declared = _resolved(spark, sf), view(spark, sf, "declared")
    cut = L.cut_ledger(resolved)
    counts = declared.select("bundle_id", F.col("declared").alias("ledger_declared")).join(cut.groupBy("bundle_id").agg(F.count("*").alias("ledger_entries")), "bundle_id", "left")
    return L.proof_violations(L.proof(resolved, declared), counts, L.index_counts(L.object_index(cut)))


@query(
    "proof_violations_altered",
    _sql("""SELECT bundle_id, CASE WHEN bundle_id = 'src2' THEN concat('proof/ledger declared mismatch: proof=', entries_declared + 1, ', ledger=', entries_declared)
      WHEN entries_parsed <> entries_declared THEN concat('parsed entries below declared count: parsed=', entries_parsed, ', declared=', entries_declared)
      WHEN bundle_id = 'src3' THEN concat('duplicate materialized count mismatch: index=', duplicate_entry_count_materialized, ', proof=', duplicate_entry_count_materialized + 2)
      WHEN NOT transfer_allowed THEN blocked_reason END AS violation FROM proof"""),
)
def proof_violations_altered(spark, sf):
    resolved, declared = _resolved(spark, sf), view(spark, sf, "declared")
    cut = L.cut_ledger(resolved)
    altered = L.proof(resolved, declared).withColumns({"entries_declared": F.col("entries_declared") + (F.col("bundle_id") == "src2").cast("int"), "duplicate_entry_count_materialized": F.col("duplicate_entry_count_materialized") + F.when(F.col("bundle_id") == "src3", 2).otherwise(0)})
    counts = declared.select("bundle_id", F.col("declared").alias("ledger_declared")).join(cut.groupBy("bundle_id").agg(F.count("*").alias("ledger_entries")), "bundle_id", "left")
    return L.proof_violations(altered, counts, L.index_counts(L.object_index(cut))).select("bundle_id", "violation")


@query(
    "ledger_sections",
    _sql("""SELECT bundle_id, idx, s AS section FROM (SELECT *, max(idx) OVER (PARTITION BY bundle_id) + 1 AS n FROM resolved), unnest(['first', 'last', 'unresolved']) t(s)
      WHERE (s = 'first' AND idx < 20) OR (s = 'last' AND idx >= n - 20) OR (s = 'unresolved' AND NOT resolved)"""),
)
def ledger_sections(spark, sf):
    return L.ledger_sections(_resolved(spark, sf)).select("bundle_id", "idx", "section")


@query("ledger_counts", _sql("SELECT bundle_id, declared, count(*) AS parsed, count(*) FILTER (NOT resolved) AS unresolved FROM declared JOIN resolved USING (bundle_id) GROUP BY bundle_id, declared"))
def ledger_counts(spark, sf):
    return L.ledger_counts(_resolved(spark, sf), view(spark, sf, "declared"))


@query(
    "encode_ledger",
    _sql("""SELECT bundle_id, idx, offs AS offset_bytes, kind, out_size, CASE WHEN kind = 'ofs-delta' THEN concat('ofs:', offs - base_offset, CASE WHEN base_idx IS NOT NULL THEN concat('@', base_offset) ELSE '' END)
      WHEN base_oid IS NOT NULL THEN concat('oid:', base_oid) END AS base, CASE WHEN resolved THEN oid END AS result_oid, resolved, resolved_via, note FROM resolved"""),
)
def encode_ledger(spark, sf):
    return L.encode_ledger(_resolved(spark, sf))


@query(
    "proof_summary",
    _sql("""SELECT bundle_id, CASE WHEN verification_status = 'ok' AND entries_parsed = entries_declared THEN 'OK' ELSE 'FAILED' END AS status, concat(entries_parsed, '/', entries_declared) AS parsed,
      concat(entries_materialized, '/', entries_declared) AS materialized, CASE WHEN transfer_allowed THEN 'allowed' ELSE concat('blocked (', blocked_reason, ')') END AS transfer, 'match' AS checksum,
      CASE WHEN thin_pack_detected THEN 'yes' ELSE 'no' END AS thin, baseline_resolutions_count::varchar AS baseline_resolutions FROM proof"""),
)
def proof_summary(spark, sf):
    return L.proof_summary(L.proof(_resolved(spark, sf), view(spark, sf, "declared")))


@query("supported_formats", "SELECT n_name AS repo, CASE n_nationkey % 4 WHEN 0 THEN 'SHA1' WHEN 1 THEN 'sha256' WHEN 2 THEN 'sha1' END AS object_format, n_nationkey % 4 <> 1 AS supported FROM nation")
def supported_formats(spark, sf):
    k = F.col("n_nationkey") % 4
    repos = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("repo"), F.when(k == 0, "SHA1").when(k == 1, "sha256").when(k == 2, "sha1").alias("object_format"))
    return L.supported_formats(repos)
