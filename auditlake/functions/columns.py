"""Column expressions: codes, labels, identities, object ids. Each takes columns (or their names) and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes, kinds and labels that records and documents carry.
STATUS_CODES = {"added": "A", "modified": "M", "deleted": "D", "renamed": "R", "copied": "C", "typechange": "T"}
OBJECT_KINDS = ["commit", "tree", "blob", "tag", "unknown"]
KIND_LABELS = {"commit": "commit", "tree": "tree", "blob": "blob", "tag": "tag", "unknown": "unknown"}
ZERO_OID = "0" * 40


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _coded(x, codes: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, code in codes.items():
        out = F.when(_c(x) == name, code).otherwise(out)
    return out


def change_code(status) -> Column:
    """Change status -> one letter; unknown statuses are null."""
    return _coded(status, STATUS_CODES)


def header_version(number) -> Column:
    """2 or 3 -> v2 or v3; other numbers are null."""
    return F.when(_c(number).isin(2, 3), F.concat(F.lit("v"), _c(number).cast("string")))


def octal_mode(mode) -> Column:
    """File mode as six octal digits."""
    return F.lpad(F.conv(_c(mode).cast("string"), 10, 8), 6, "0")


def present_oid(oid) -> Column:
    """The all-zero object id stands for none."""
    return F.nullif(_c(oid), F.lit(ZERO_OID))


def kind_label(kind) -> Column:
    return F.coalesce(_coded(kind, KIND_LABELS), F.lit("unknown"))


def kind_rank(kind) -> Column:
    """commit 0, tree 1, blob 2, tag 3, anything else 4."""
    at = F.array_position(F.array(*[F.lit(k) for k in OBJECT_KINDS]), F.coalesce(_c(kind), F.lit("unknown")))
    return F.when(at == 0, 4).otherwise(at - 1).cast("int")


def tree_mode_kind(mode) -> Column:
    """Kind of a tree entry by its mode text."""
    return F.when(_c(mode).isin("40000", "040000"), "tree").when(_c(mode) == "160000", "commit").otherwise("blob")


def decoration_rank(ref) -> Column:
    """Branches 1, tags 2, other refs null."""
    return F.when(_c(ref).startswith("refs/heads/"), 1).when(_c(ref).startswith("refs/tags/"), 2)


def decoration_label(ref) -> Column:
    """Branch name, or tag: name, trimmed; other refs null."""
    branch = F.trim(F.regexp_extract(_c(ref), "^refs/heads/(.*)$", 1))
    tag = F.trim(F.regexp_extract(_c(ref), "^refs/tags/(.*)$", 1))
    return F.when(decoration_rank(ref) == 1, branch).when(decoration_rank(ref) == 2, F.concat(F.lit("tag: "), tag))


def signed_time(seconds, minutes) -> Column:
    """Seconds with the offset from UTC, as in 1700000000 (UTC+01:00)."""
    m = _c(minutes)
    whole = F.abs(m)
    return F.concat(_c(seconds).cast("string"), F.lit(" (UTC"), F.when(m < 0, "-").otherwise("+"), F.lpad(F.floor(whole / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit(")"))


def identity_label(name, email) -> Column:
    return F.concat(_c(name), F.lit(" <"), _c(email), F.lit(">"))


def repository_name(url) -> Column:
    """Last part of a URL after / or :, without closing slashes and .git; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(_c(url), "/+$", ""), r"\.git$", "")
    return F.nullif(F.regexp_extract(bare, "([^/:]*)$", 1), F.lit(""))


def tip_reference(ref, oid) -> Column:
    """The given ref, or one made from the id."""
    return F.coalesce(_c(ref), F.concat(F.lit("refs/heads/bundle-tip-"), F.left(_c(oid), F.lit(12))))


def one_line(text) -> Column:
    """Error text with line ends as spaces."""
    return F.regexp_replace(_c(text), r"\r?\n", " ")


def parent_label(parents) -> Column:
    """'-' without parents, otherwise a comma list."""
    return F.when(F.size(_c(parents)) > 0, F.concat_ws(", ", _c(parents))).otherwise("-")


def short_oid(oid, n: int = 12) -> Column:
    """First characters of an id; '-' when absent."""
    return F.coalesce(F.left(_c(oid), F.lit(n)), F.lit("-"))


def short_subject(oid, subject) -> Column:
    """First characters of an id and the subject, if there is one; '-' without an id."""
    said = F.nullif(F.trim(_c(subject)), F.lit(""))
    return F.when(_c(oid).isNull(), "-").otherwise(F.concat_ws(" ", short_oid(oid), F.when(said.isNotNull(), _c(subject))))


def object_id(kind, content) -> Column:
    """SHA-1 of kind, length and content; null for a kind that has no ids."""
    raw = _c(content).cast("binary")
    head = F.encode(F.concat(_c(kind), F.lit(" "), F.octet_length(raw).cast("string")), "utf-8")
    return F.when(_c(kind).isin("commit", "tree", "blob", "tag"), F.sha1(F.concat(head, F.lit(b"\0"), raw)))


def content_digest(content) -> Column:
    return F.sha2(_c(content).cast("binary"), 256)


def bundle_id(content) -> Column:
    """First 12 characters of the content digest."""
    return F.left(content_digest(content), F.lit(12))
