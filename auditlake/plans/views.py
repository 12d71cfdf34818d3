"""Input views over the supplied tables, spelt once for Spark SQL and DuckDB.

octets(x) and bloboid(x) stand for each engine's byte length and blob id; DIV for whole division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "events"]

VIEWS: dict[str, tuple[list[str], str]] = {
    "docs": (["documents"], "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents"),
    "objects": (["docs"], "SELECT doc_id, source AS bundle_id, bloboid(text) AS oid, 'blob' AS kind, octets(text) AS size_bytes, text FROM docs"),
    "placed": (
        ["docs"],
        """SELECT *, 12 + cast(coalesce(sum(out_size + 20) OVER (PARTITION BY bundle_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS offs
           FROM (SELECT source AS bundle_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx,
                 (doc_id * 7 + doc_id DIV 20) % 20 AS h, octets(text) AS out_size, bloboid(text) AS oid FROM docs) x""",
    ),
    "ledger": (
        ["placed"],
        """SELECT bundle_id, cast(idx AS bigint) AS idx, offs,
             CASE WHEN h = 0 THEN 'commit' WHEN h = 1 THEN 'tree' WHEN h = 2 THEN 'tag' WHEN h IN (6, 7) THEN 'ofs-delta' WHEN h IN (8, 9) THEN 'ref-delta' ELSE 'blob' END AS kind,
             cast(out_size AS bigint) AS out_size,
             CASE WHEN h IN (6, 7) THEN coalesce(lag(offs, 3) OVER (PARTITION BY bundle_id ORDER BY idx), offs - 5) END AS base_offset,
             CASE WHEN h = 8 OR (h = 9 AND doc_id % 2 = 0) THEN coalesce(lag(oid, 2) OVER (PARTITION BY bundle_id ORDER BY idx), lead(oid, 1) OVER (PARTITION BY bundle_id ORDER BY idx))
                  WHEN h = 9 THEN lead(oid, 1) OVER (PARTITION BY bundle_id ORDER BY idx) END AS base_oid,
             oid
           FROM placed""",
    ),
    "ledger_dup": (["docs"], "SELECT lang AS bundle_id, cast(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS bigint) AS idx, 'blob' AS kind, cast(octets(text) AS bigint) AS out_size, bloboid(text) AS oid, true AS resolved, 'in-pack' AS resolved_via FROM docs"),
    "baseline": (["docs"], "SELECT DISTINCT bloboid(text) AS oid FROM docs WHERE doc_id % 3 = 0"),
    "declared": (["docs"], "SELECT source AS bundle_id, count(*) + max(CASE WHEN source = 'src0' THEN 1 ELSE 0 END) AS declared FROM docs GROUP BY source"),
    "commits": (
        ["orders", "customer"],
        """SELECT id, repo, cust, time, p1, CASE WHEN urgent AND (p1 IS NULL OR p2 <> p1) THEN p2 END AS p2, message
           FROM (SELECT o_orderkey AS id, c_nationkey AS repo, o_custkey AS cust, o_orderdate AS time, o_orderpriority = '1-URGENT' AS urgent, o_orderstatus AS message,
                   lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p1,
                   lag(o_orderkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY o_orderdate, o_orderkey) AS p2
                 FROM orders JOIN customer ON o_custkey = c_custkey) x""",
    ),
    "edges": (["commits"], "SELECT id AS child, p1 AS parent, 0 AS parent_index FROM commits WHERE p1 IS NOT NULL UNION ALL SELECT id, p2, CASE WHEN p1 IS NULL THEN 0 ELSE 1 END FROM commits WHERE p2 IS NOT NULL"),
    "ranked": (["commits"], "SELECT id, repo, cust, row_number() OVER (PARTITION BY cust ORDER BY time DESC, id DESC) AS r FROM commits"),
    "all_heads": (["ranked"], "SELECT repo AS bundle_id, id AS oid, cust, concat('refs/heads/c', cust) AS reference, row_number() OVER (PARTITION BY repo ORDER BY cust) - 1 AS head_index FROM ranked WHERE r = 1"),
    "heads": (["all_heads"], "SELECT * FROM all_heads"),
    "pairs": (
        ["ranked"],
        """SELECT repo, cust, concat('refs/heads/c', cust) AS target_ref, CASE WHEN cust % 5 = 3 THEN coalesce(r2, r1) ELSE r1 END AS incoming,
             CASE cust % 5 WHEN 1 THEN r1 WHEN 2 THEN coalesce(r2, r1) WHEN 3 THEN r1 WHEN 4 THEN nxt END AS target
           FROM (SELECT *, lead(r1) OVER (PARTITION BY repo ORDER BY cust) AS nxt
                 FROM (SELECT repo, cust, max(CASE WHEN r = 1 THEN id END) AS r1, max(CASE WHEN r = 2 THEN id END) AS r2 FROM ranked WHERE r <= 2 GROUP BY repo, cust) y) x""",
    ),
    "snap_base": (["docs"], "SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, CASE WHEN doc_id % 19 = 0 THEN '100755' ELSE '100644' END AS mode, bloboid(text) AS oid, doc_id, text FROM docs WHERE doc_id % 7 <> 0"),
    "tip_text": (["docs"], "SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN concat(text, chr(10), 'tail line ', doc_id) ELSE text END AS text FROM docs WHERE doc_id % 11 <> 0"),
    "snap_tip": (["tip_text"], "SELECT concat(source, '/', lang, '/', CASE WHEN doc_id % 13 = 0 THEN 'moved_' ELSE '' END, doc_id, '.txt') AS path, CASE WHEN doc_id % 17 = 0 THEN '120000' WHEN doc_id % 19 = 0 THEN '100755' ELSE '100644' END AS mode, bloboid(text) AS oid, doc_id, text FROM tip_text"),
    "merge_input": (
        ["docs"],
        """SELECT doc_id, concat(source, '/', doc_id) AS path, CASE WHEN doc_id % 7 <> 0 THEN text END AS base,
             CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat(text, ' ours') WHEN doc_id % 7 = 0 AND doc_id % 2 = 0 THEN NULL ELSE text END AS ours,
             CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN concat(text, ' theirs') WHEN doc_id % 10 = 0 THEN concat(text, ' ours') WHEN doc_id % 7 = 0 AND doc_id % 3 = 1 THEN NULL ELSE text END AS theirs,
             source AS bundle_id FROM docs""",
    ),
    "tree_entries": (
        ["region", "nation", "customer", "supplier"],
        """SELECT 'root' AS tree_oid, cast(r_regionkey AS bigint) AS pos, '40000' AS mode, r_name AS name, concat('r', r_regionkey) AS child_oid, 'tree' AS child_kind FROM region
           UNION ALL SELECT concat('r', n_regionkey), cast(n_nationkey AS bigint), '40000', n_name, concat('n', n_nationkey), 'tree' FROM nation
           UNION ALL SELECT concat('n', c_nationkey), cast(c_custkey AS bigint), '100644', c_name, concat('c', c_custkey), 'blob' FROM customer
           UNION ALL SELECT concat('n', s_nationkey), cast(1000000000 + s_suppkey AS bigint), '160000', s_name, concat('s', s_suppkey), 'commit' FROM supplier""",
    ),
    "line_pairs": (
        ["docs"],
        """SELECT doc_id, source, lines, text AS old_text,
             CASE doc_id % 4 WHEN 0 THEN concat('head line ', doc_id, chr(10), text)
               WHEN 1 THEN CASE WHEN instr(text, chr(10)) > 0 THEN concat('new first ', doc_id, substr(text, instr(text, chr(10)))) ELSE concat('new first ', doc_id) END
               WHEN 2 THEN concat(substr(text, instr(text, chr(10)) + 1), CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10))) ELSE '' END)
               ELSE text END AS new_text
           FROM (SELECT doc_id, source, CASE WHEN text = '' THEN '' WHEN substr(text, -1) = chr(10) THEN text ELSE concat(text, chr(10)) END AS text,
                   length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR substr(text, -1) = chr(10) THEN 0 ELSE 1 END AS lines FROM docs) x""",
    ),
    "revised": (
        ["docs"],
        """SELECT doc_id, source AS bundle_id, concat(lang, '/', doc_id, '.txt') AS path0, concat(CASE WHEN doc_id % 13 = 0 THEN 'moved/' ELSE '' END, lang, '/', doc_id, '.txt') AS path,
             CASE WHEN doc_id % 17 = 0 THEN '120000' ELSE '100644' END AS mode, text AS t1,
             CASE doc_id % 5 WHEN 0 THEN concat('head line ', doc_id, chr(10), text)
               WHEN 1 THEN CASE WHEN instr(text, chr(10)) > 0 THEN concat('new first ', doc_id, substr(text, instr(text, chr(10)))) ELSE concat('new first ', doc_id) END
               WHEN 2 THEN CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END
               ELSE text END AS t2 FROM docs""",
    ),
    "rev_files": (
        ["revised"],
        """SELECT bundle_id, concat(bundle_id, '/r1') AS commit, doc_id, path0 AS path, '100644' AS mode, bloboid(t1) AS oid, t1 AS text FROM revised WHERE doc_id % 7 <> 0
           UNION ALL SELECT bundle_id, concat(bundle_id, '/r2'), doc_id, path, mode, bloboid(t2), t2 FROM revised WHERE doc_id % 11 <> 0
           UNION ALL SELECT bundle_id, concat(bundle_id, '/r3'), doc_id, path, mode, bloboid(t3), t3 FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN concat('top ', doc_id, chr(10), t2) ELSE t2 END AS t3 FROM revised) x WHERE doc_id % 11 <> 0 AND doc_id % 19 <> 0""",
    ),
    "rev_commits": (
        ["docs"],
        """SELECT bundle_id, concat(bundle_id, '/r', n) AS id, CASE WHEN n > 1 THEN concat(bundle_id, '/r', n - 1) END AS first_parent, n, concat('tree', n) AS tree_oid, concat('revision ', n) AS subject, concat('revision ', n, chr(10)) AS message, concat('user', n) AS author
           FROM (SELECT DISTINCT source AS bundle_id FROM docs) b CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) v""",
    ),
    "rev_pairs": (["rev_commits"], "SELECT id AS pair, first_parent AS old_commit, id AS new_commit, 'commit' AS what FROM rev_commits UNION ALL SELECT concat(bundle_id, '#', n - 2), concat(bundle_id, '/r1'), id, 'head' FROM rev_commits WHERE n > 1"),
    "forked": (
        ["docs"],
        """SELECT doc_id, source AS bundle_id, (doc_id DIV 20) % 10 AS k, concat('t', doc_id % 3, CASE WHEN doc_id % 2 = 0 THEN '/d/' WHEN doc_id % 5 = 0 THEN '.' ELSE '/' END, 'd', doc_id, '.txt') AS path, text,
             CASE WHEN doc_id % 7 <> 0 THEN text END AS base,
             CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat(text, chr(10), 'ours tail') ELSE text END AS ours,
             CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN text END WHEN doc_id % 11 = 0 THEN text
               WHEN (doc_id DIV 20) % 10 % 3 = 1 AND doc_id % 5 = 0 THEN concat(text, chr(10), 'theirs tail') WHEN doc_id % 3 = 0 THEN concat('theirs head', chr(10), text) ELSE text END AS theirs
           FROM docs""",
    ),
    "fork_refs": (["forked"], "SELECT DISTINCT bundle_id, k, concat('refs/heads/k', k) AS target_ref, concat(bundle_id, '/o', k) AS target, concat(bundle_id, '/t', k) AS incoming, CASE WHEN k % 3 <> 2 THEN concat(bundle_id, '/b', k) END AS base_commit FROM forked"),
    "fork_files": (
        ["forked"],
        """SELECT concat(bundle_id, '/b', k) AS commit, path, '100644' AS mode, bloboid(base) AS oid, base AS text FROM forked WHERE base IS NOT NULL
           UNION ALL SELECT concat(bundle_id, '/o', k), path, '100644', bloboid(ours), ours FROM forked WHERE ours IS NOT NULL
           UNION ALL SELECT concat(bundle_id, '/t', k), path, '100644', bloboid(theirs), theirs FROM forked WHERE theirs IS NOT NULL""",
    ),
    "fork_commits": (
        ["fork_refs"],
        """SELECT concat(bundle_id, '/b', k) AS id, bundle_id AS repo, 0 AS time, concat('base ', k) AS subject FROM fork_refs
           UNION ALL SELECT target, bundle_id, 1, concat('ours ', k) FROM fork_refs UNION ALL SELECT incoming, bundle_id, 1, concat('theirs ', k) FROM fork_refs""",
    ),
    "fork_edges": (["fork_refs"], "SELECT target AS child, base_commit AS parent, 0 AS parent_index FROM fork_refs WHERE base_commit IS NOT NULL UNION ALL SELECT incoming, base_commit, 0 FROM fork_refs WHERE base_commit IS NOT NULL"),
    "decor_refs": (
        ["all_heads", "commits"],
        """SELECT repo, concat('refs/tags/t', id) AS ref_name, id AS oid FROM commits WHERE id % 20 = 0
           UNION ALL SELECT repo, concat('refs/notes/n', id), id FROM commits WHERE id % 50 = 0
           UNION ALL SELECT bundle_id, reference, oid FROM all_heads""",
    ),
    "transport": (["pages"], "SELECT concat('page_', page_id, '.html') AS name, page_id, coalesce(html, '') AS html FROM pages"),
    "urls": (["pages"], "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '.git') ELSE url END AS url FROM pages"),
}


def _spelt(sql: str, spark: bool) -> str:
    if spark:
        sql = re.sub(r"octets\((\w+)\)", r"octet_length(\1)", sql)
        sql = re.sub(r"bloboid\((\w+)\)", r"sha1(concat(cast(concat('blob ', octet_length(\1)) AS binary), X'00', cast(\1 AS binary)))", sql)
        return sql.replace(" DIV ", " div ")
    sql = re.sub(r"octets\((\w+)\)", r"strlen(\1)", sql)
    sql = re.sub(r"bloboid\((\w+)\)", r"sha1(concat('blob ', strlen(\1), chr(0), \1))", sql)
    return sql.replace(" DIV ", " // ")


def _needed(names: list[str], out: list[str]) -> list[str]:
    for name in names:
        if name in VIEWS and name not in out:
            _needed(VIEWS[name][0], out)
            out.append(name)
    return out


def duck(names: list[str], body: str, recursive: bool = False) -> str:
    """DuckDB SQL: the named views and what they need, then the body, which begins with SELECT or with further views."""
    views = ",\n".join(f"{n} AS ({_spelt(VIEWS[n][1], False)})" for n in _needed(names, []))
    body = body.strip()
    more = body.startswith("+")
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{',' if more else ''}\n{body[1:] if more else body}"


def alike(deleted: str, added: str, out: str) -> str:
    """DuckDB views that end in out(pair, gone, path, score): texts of deleted(pair, path, text) and added(pair, path, text) alike by half, taken by falling score."""
    lines = lambda rows: f"(SELECT pair, path, strlen(text) + 1 AS size, line, count(*) AS n, strlen(line) + 1 AS bytes FROM (SELECT pair, path, text, unnest(string_split(text, chr(10))) AS line FROM {rows} WHERE text <> '') GROUP BY ALL)"
    return f"""{out}_scores AS (SELECT d.pair, d.path AS gone, a.path, sum(least(d.n, a.n) * d.bytes) / greatest(any_value(d.size), any_value(a.size)) AS score FROM {lines(deleted)} d JOIN {lines(added)} a ON a.pair = d.pair AND a.line = d.line GROUP BY d.pair, d.path, a.path),
{out}_taken AS (SELECT pair, list_reduce(list([struct_pack(gone, path, score)] ORDER BY score DESC, sha1(concat(gone, chr(10), path)) DESC), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.gone = x[1].gone OR y.path = x[1].path)) > 0 THEN acc ELSE list_concat(acc, x) END) AS l FROM {out}_scores WHERE score >= 0.5 GROUP BY pair),
{out} AS (SELECT pair, u.gone, u.path, u.score FROM (SELECT pair, unnest(l) AS u FROM {out}_taken))"""


def view(spark, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame; tables are read by Spark from sf_dir."""
    needed = _needed([name], [])
    tables = {t for n in needed for t in VIEWS[n][0] if t in TABLES}
    ctes = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in sorted(tables)]
    ctes += [f"{n} AS ({_spelt(VIEWS[n][1], True)})" for n in needed]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")
