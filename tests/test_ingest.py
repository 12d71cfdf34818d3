"""Packages written here, read back."""

import hashlib
import io
import struct
import zipfile
import zlib

from auditlake.operators.ledger import pack_preflight
from auditlake.sources import ingest as I


def entry(code, data, extra=b""):
    size, first = len(data), (code << 4) | (len(data) & 15)
    head, size = bytearray(), size >> 4
    while size:
        head.append(first | 128)
        first, size = size & 127, size >> 7
    head.append(first)
    return bytes(head) + extra + zlib.compress(data)


def oid(kind, data):
    return hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).hexdigest()


def packed(entries, declared=None):
    body = b"PACK" + struct.pack(">II", 2, declared or len(entries)) + b"".join(entries)
    return body + hashlib.sha1(body).digest()


BASE = b"a line of text\n" * 8
DELTA = bytes([len(BASE), 20, 0x90, 15, 5]) + b"12345"  # 15 bytes from the base's beginning, then five new ones
OWN = BASE[:15] + b"12345"


def test_ingest(spark):
    first = entry(3, BASE)
    ofs = entry(6, DELTA, bytes([len(first)]))
    ref = entry(7, DELTA, bytes.fromhex(oid("blob", BASE)))
    far = entry(7, DELTA, b"\1" * 20)
    packs = [("good", packed([first, ofs, ref])), ("thin", packed([first, far, ofs])), ("short", packed([first], 2))]
    rows = I.ingest_packs(spark.createDataFrame(packs, "bundle_id string, pack binary")).collect()
    got = {(r.bundle_id, r.idx): r for r in rows}
    assert [got["good", k].result_oid for k in range(3)] == [oid("blob", BASE), oid("blob", OWN), oid("blob", OWN)]
    assert got["good", 1].base_distance == len(first) and got["good", 1].base_offset == 12 and bytes(got["good", 2].content) == OWN
    assert "unresolved base object" in got["thin", 1].error and ("thin", 2) not in got
    assert got["short", 1].error == "pack ends before its declared entries"
    base = spark.createDataFrame([("thin", "01" * 20, "blob", BASE)], "bundle_id string, oid string, kind string, content binary")
    again = {(r.bundle_id, r.idx): r for r in I.ingest_packs(spark.createDataFrame(packs[1:2], "bundle_id string, pack binary"), base).collect()}
    assert again["thin", 1].resolved_via == "baseline" and again["thin", 1].result_oid == oid("blob", OWN)


def test_headers_and_preflight(spark):
    a, b, pack = "a" * 40, "b" * 40, packed([entry(3, BASE)])
    files = [
        ("ok", f"# v2 git bundle\n-{a} subject\n{b} refs/heads/main\n\n".encode() + pack),
        ("crlf", f"# v3 git bundle\r\n{b} refs/heads/x y\r\n\r\n".encode() + pack),
        ("cap", f"# v3 git bundle\n@object-format=sha1\n{b} refs/heads/main\n\n".encode() + pack),
        ("nopack", f"# v2 git bundle\n{b} refs/heads/main\n\nPACc".encode()),
        ("bad", b"nothing"),
    ]
    bundles, prereqs, heads = I.bundle_headers(spark.createDataFrame(files, "path string, content binary"))
    got = {r.path: r for r in bundles.collect()}
    assert got["ok"].version == "v2" and got["ok"].error is None and bytes(got["ok"].pack) == pack
    assert got["crlf"].version == "v3" and bytes(got["crlf"].pack) == pack
    assert got["cap"].error == "header line is malformed" and got["nopack"].error == "pack does not follow the header" and got["bad"].error == "header does not end"
    assert [(r.path, r.oid) for r in prereqs.collect()] == [("ok", a)]
    assert {(r.path, r.oid, r.reference) for r in heads.collect()} == {("ok", b, "refs/heads/main"), ("crlf", b, "refs/heads/x y")}
    checked = [("p", pack), ("s", b"PACK"), ("m", b"PUCK" + pack[4:]), ("v", b"PACK\0\0\0\x09" + pack[8:]), ("c", pack[:-1] + b"\0")]
    found = {r.path: r for r in pack_preflight(spark.createDataFrame(checked, "path string, pack binary")).collect()}
    assert found["p"].failure is None and found["p"].declared == 1 and found["p"].checksum_verified
    assert found["s"].failure == "pack payload is too small" and "PACK header" in found["m"].failure
    assert found["v"].failure == "unsupported pack version: 9" and "checksum mismatch" in found["c"].failure


def test_transport(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("b.json", "{}")
        z.writestr("a.bundle", "x")
    files = spark.createDataFrame([("/d/p.zip", out.getvalue()), ("/d/q.bundle", b"y")], "path string, content binary")
    got = [(r.path, r.name, r.size_bytes, r.n_bundles) for r in I.transport_inventory(files).orderBy("path", "name").collect()]
    assert got == [("/d/p.zip", "a.bundle", 1, 1), ("/d/p.zip", "b.json", 2, 1), ("/d/q.bundle", "q.bundle", 1, 1)]


def test_deltas_on_later_and_on_spoilt_entries(spark):
    first = entry(3, BASE)
    early = entry(7, DELTA, bytes.fromhex(oid("blob", BASE)))
    wrong = entry(6, bytes([len(BASE) + 1, 20, 0x90, 15, 5]) + b"12345", bytes([len(first)]))
    deep = [first]
    for _ in range(6):
        # Each copies its base whole and adds a byte.
        size = len(BASE) + len(deep) - 1
        deep.append(entry(6, bytes([size | 128 if size > 127 else size] + ([1] if size > 127 else []) + [(size + 1) & 127 | (128 if size + 1 > 127 else 0)] + ([1] if size + 1 > 127 else []) + [0x90, size, 1]) + b"!", bytes([len(deep[-1])])))
    packs = [("later", packed([early, first])), ("wrong", packed([first, wrong, entry(3, b"never seen")])), ("deep", packed(deep)), ("none", packed([], 0))]
    rows = I.ingest_packs(spark.createDataFrame(packs, "bundle_id string, pack binary")).collect()
    got = {(r.bundle_id, r.idx): r for r in rows}
    assert "unresolved base object" in got["later", 0].error and ("later", 1) not in got
    assert "delta is for a base of" in got["wrong", 1].error and ("wrong", 2) not in got and got["wrong", 0].error is None
    assert [bytes(got["deep", k].content) for k in range(7)] == [BASE + b"!" * k for k in range(7)]
    assert all(got["deep", k].end_offs == got["deep", k + 1].offs for k in range(6)) and got["deep", 6].end_offs == len(packs[2][1]) - 20
    assert not [r for r in rows if r.bundle_id == "none"]
    assert {r.resolved_via for r in rows if r.error is None} == {"in-pack"}


def test_a_header_longer_than_looked_for(spark):
    heads = "".join(f"{k:040x} refs/heads/b{k}\n" for k in range(2000))
    pack = packed([entry(3, BASE)])
    assert len(heads) > I.HEADER
    bundles, _, found = I.bundle_headers(spark.createDataFrame([("long", f"# v2 git bundle\n{heads}\n".encode() + pack), ("open", f"# v2 git bundle\n{heads}".encode())], "path string, content binary"))
    got = {r.path: r for r in bundles.collect()}
    assert got["long"].error is None and bytes(got["long"].pack) == pack and found.count() == 2000 and got["open"].error == "header does not end"


def test_one_bad_document_among_many(spark, tmp_path):
    import json

    from auditlake.operators import claims as C

    for k in range(300):
        (tmp_path / f"{k}.json").write_text(json.dumps({"schema_version": "1", "n": k}, indent=1) if k != 7 else '{"schema_version": "1", "n"')
    (tmp_path / "x.json").write_text('{"schema_version": "2", "n": 1}')
    (tmp_path / "y.json").write_text('{"schema_version": "1", "n": "many"}')
    (tmp_path / "z.json").write_text(" ")
    got = {r.path.rsplit("/", 1)[-1]: r for r in C.load_claims(spark, str(tmp_path), "schema_version string, n long").collect()}
    assert sorted(r.doc.n for r in got.values() if r.error is None) == [k for k in range(300) if k != 7]
    assert {k: r.error for k, r in got.items() if r.error} == {"7.json": "document is not as its schema says", "x.json": "unsupported schema version: '2'", "y.json": "document is not as its schema says", "z.json": "document is not as its schema says"}
