"""Contracts of the two documents as data, and which of their rules a document breaks.

A contract names a document's fields: each with a rule, or the fields of an object, or a list of one of these. Every field
is required, no other is allowed, and a value is null only where its rule says so. A rule has a JSON type and a pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and permitted values of the documents' fields.
RULES = {
    "oid": "^[0-9a-f]{40}$",
    "digest": "^[0-9a-f]{64}$",
    "mode": "^[0-7]{6}$",
    "count": "^[0-9]+$",
    "integer": "^-?[0-9]+$",
    "flag": "^(true|false)$",
    "text": "(?s)^.+$",
    "any": "(?s)^.*$",
    "version": "^v[23]$",
    "schema": "^1$",
    "kind": "^(commit|tree|blob|tag|unknown)$",
    "entry kind": "^(commit|tree|blob|tag|ofs-delta|ref-delta)$",
    "status": "^[AMDRCT]$",
    "via": "^(in-pack|baseline)$",
    "proof status": "^(ok|blocked|failed)$",
    "ledger mode": "^(none|summary|full)$",
    "detail mode": "^(full|light)$",
    "patch format": "^unified-diff$",
    "hash": "^sha1$",
    "pack version": "^([2-9]|[1-9][0-9]+)$",
}
_PERSON = {"name": "any", "email": "any", "time_seconds": "integer", "offset_minutes": "integer"}
_HEAD = {"oid": "oid", "reference": "text"}
_COMMON = {
    "schema_version": "schema", "tool_version": "text", "generated_at_unix_secs": "count", "generated_by_username": "text", "generated_by_hostname": "text",
    "bundle_path": "text", "bundle_size_bytes": "count", "bundle_sha256": "digest", "bundle_header_version": "version", "prerequisites": ["oid"], "heads": [_HEAD],
}
_ENTRY = {"idx": "count", "offset": "count", "kind": "entry kind", "out_size": "count", "reconstructed_size": "count?", "base": "any?", "result_oid": "oid?", "result_kind": "kind?", "resolved": "flag", "resolved_via": "via?", "note": "any?"}
_OBJECT = {"oid": "oid", "kind": "kind", "size_bytes": "count"}
_PROOF_COUNTS = ["declared_object_count", "processed_object_count", "entries_declared", "entries_parsed", "entries_materialized", "unique_objects_materialized", "duplicate_entry_count_materialized", "baseline_resolutions_count"]
CONTRACTS = {
    "creation": _COMMON
    | {
        "range_from_oid": "oid",
        "range_to_oid": "oid",
        "tip_ref": "text",
        "commit_chain": [{"oid": "oid", "tree_oid": "oid", "parent_oids": ["oid"], "subject": "any", "author": _PERSON, "committer": _PERSON}],
        "changed_files": [{"status": "status", "path": "text", "old_path": "any?", "old_oid": "oid?", "new_oid": "oid?", "old_mode": "mode?", "new_mode": "mode?", "is_binary": "flag"}],
        "patch_sidecar?": {"path": "text", "format": "patch format", "size_bytes": "count", "sha256": "digest"},
    },
    "audit": _COMMON
    | {
        "transport_entries": [{"name": "text", "size_bytes": "count", "sha256": "digest"}],
        "pack_proof": {"verification_status": "proof status", "pack_version": "pack version"} | dict.fromkeys(_PROOF_COUNTS, "count") | dict.fromkeys(["checksum_verified", "thin_pack_detected", "transfer_allowed"], "flag") | {"blocked_reason": "any?", "hash_algorithm": "hash", "computed_pack_checksum": "oid", "trailer_pack_checksum": "oid"},
        "entry_ledger": {"mode": "ledger mode"} | dict.fromkeys(["declared_entries", "parsed_entries", "unresolved_entries"], "count") | dict.fromkeys(["first_entries", "last_entries", "unresolved_entry_rows", "entries"], [_ENTRY]),
        "pack_summary": dict.fromkeys([f"{k}_objects" for k in ("total", "reachable", "unreachable", "commit", "tree", "blob", "tag", "unknown")], "count"),
        "pack_objects": [_OBJECT | {"reachable_from_heads": "flag", "context_head_index": "count?", "context_commit_order": "count?", "context_path": "any?"}],
        "object_detail_mode": "detail mode",
        "object_details": [_OBJECT | {"syntax_path_hint": "any?", "blob_paths": ["any"], "text_line_count": "count?", "lines": ["any"]}],
    },
}


#: JSON types of values by rule; other rules are for text. A number too large for a long is a decimal without fraction.
TYPES = {"flag": "^BOOLEAN$", "count": r"^(BIGINT|DECIMAL\(\d+,0\))$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "pack version": "^BIGINT$"}


def _faults(shape, path: str, says: list[str]) -> Callable[[Column], Column]:
    """A function from a JSON value to the numbers in `says` of what is wrong with it, where says gets all that may be, in order."""

    def say(text: str) -> Callable[[Column], Column]:
        says.append(text)
        number = len(says) - 1
        return lambda wrong: F.when(wrong, F.array(F.lit(number))).otherwise(F.array().cast("array<int>"))

    one = lambda value, then: F.flatten(F.transform(F.array(value), then))  # noqa: E731  evaluates the value once
    if isinstance(shape, str):
        rule, null = shape.removesuffix("?"), shape.endswith("?")
        told = say(f"{path} is no {rule}")

        def leaf(v: Column) -> Column:
            right = F.schema_of_variant(v).rlike(TYPES.get(rule, "^STRING$")) & F.try_variant_get(v, "$", "string").rlike(RULES[rule])
            return told(~F.coalesce(F.is_variant_null(v) | right if null else right, F.lit(False)))

        return leaf
    if isinstance(shape, list):
        told = say(f"{path} is no list")
        inner = _faults(shape[0], f"{path}[]", says)
        listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
        none = F.array().cast("array<array<int>>")
        return lambda v: one(listed(v), lambda l: F.concat(told(l.isNull()), F.flatten(F.coalesce(F.transform(l, inner), none))))
    at = path or "document"
    told, other = say(f"{at} is no object"), say(f"{at} has other fields")
    names = F.array(*[F.lit(n.removesuffix("?")) for n in shape])
    fields = []
    for name, part in shape.items():
        own = name.removesuffix("?")
        deeper = f"{path}.{own}" if path else own
        missing = say(f"{deeper} is missing")
        fields.append((own, name.endswith("?"), missing, _faults(part, deeper, says)))

    def within(m: Column) -> Column:
        found = [told(m.isNull()), other(F.coalesce(F.size(F.array_except(F.map_keys(m), names)) > 0, F.lit(False)))]
        for own, null, missing, inner in fields:
            part = F.try_element_at(m, F.lit(own))
            found.append(missing(m.isNotNull() & part.isNull()))
            some = part.isNotNull() & ~F.is_variant_null(part) if null else part.isNotNull()
            found.append(F.when(some, one(part, inner)).otherwise(F.array().cast("array<int>")))
        return F.concat(*found)

    return lambda v: one(F.try_variant_get(v, "$", "map<string,variant>"), within)


def contract_faults(docs: DataFrame, which: str, key: str = "doc_id", column: str = "json") -> DataFrame:
    """(key, faults) of documents as JSON text: the rules of the contract `which` that each breaks, in the contract's order.

    Each document is parsed once, to a variant whose values keep their JSON types: a number in quotes is no count. What is no JSON,
    or has a field twice, is no object.
    """
    says: list[str] = []
    check = _faults(CONTRACTS[which], "", says)
    value = docs.select(key, F.coalesce(F.try_parse_json(F.col(column)), F.parse_json(F.lit("null"))).alias("v"))
    numbers = value.select(key, F.array_sort(F.array_distinct(check(F.col("v")))).alias("n"))
    return numbers.select(key, F.transform("n", lambda n: F.get(F.array(*[F.lit(x) for x in says]), n)).alias("faults"))
