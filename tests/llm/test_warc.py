"""Archives are read back as they were written."""

import base64
import hashlib

from cellmap.llm.common import shared_path
from cellmap.llm.warc_store import original_records, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, extra string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    best = {}
    for p, _, h, *_ in rows:
        h = h or ""
        best[h] = max(best.get(h, -(10**9)), -(10**9) + 1 if p is None else p)
    seen, out = set(), []
    for p, _, h, *_ in sorted(rows, key=lambda r: r[1] or "", reverse=True):
        h = h or ""
        first = best[h] == (-(10**9) + 1 if p is None else p) and h not in seen
        if first:
            seen.add(h)
        kind = "response" if first or len(h.encode()) < least else "revisit"
        b = best[h]
        out.append((p, len(h.encode()), digest(h), kind, None if kind == "response" or b == -(10**9) + 1 else b))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a", "<p>é</p>", "x"), (2, "http://b", "<p>é</p>", "x"), (3, "http://c\r\nx", "other", None), (4, None, None, "x"), (5, "http://e", "", "x"),
    (6, "http://f", "\r\n\r\nWARC/1.1\r\n", "x"), (2, "http://b", "<p>é</p>", "x"), (2, "http://b2", "<p>é</p>", "x"), (None, "http://n", "alone", "x"), (None, "http://n", "<p>é</p>", "x"),
]


def archive(spark, rows, **options):
    path = shared_path(spark, "warc-test")
    write_archive(spark.createDataFrame(rows, SCHEMA).repartition(3), path, **options)
    return path


def test_round_trip(spark):
    path = archive(spark, ROWS)
    got = sorted((tuple(r)[:5] for r in read_archive(spark, path).collect()), key=repr)
    assert got == brute(ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in ROWS})
    records = original_records(spark, path).collect()
    assert len(records) == len(ROWS)
    for r in records:
        assert hashlib.sha256(r["payload"]).hexdigest() == r["digest"]
    urls = {r["url"] for r in read_archive(spark, path).collect()}
    assert "http://c%0D%0Ax" in urls


def test_small_payloads_and_many_copies(spark):
    rows = [(i, f"u{i}", "same" if i % 3 else f"own {i}", None) for i in range(200)]
    got = sorted((tuple(r)[:5] for r in read_archive(spark, archive(spark, rows, least_bytes=5)).collect()), key=repr)
    assert got == brute(rows, 5)


def test_names_and_null_urls(spark):
    """One response a payload, whatever the URLs; every record has a name of its own; nothing stays in the catalog."""
    rows = [(8, None, "z", "a"), (8, "", "z", "b"), (7, "u", "p", "c"), (7, "u", "q", "d"), (7, "v", "q", "d"), (7, "v", "q", "d")] + [(i, "h", "hot", None) for i in range(400)]
    path = archive(spark, rows)
    out = read_archive(spark, path).collect()
    assert len(out) == len(rows)
    by_payload = {}
    for r in out:
        by_payload.setdefault(r["payload_digest"], []).append(r["record_type"])
    assert all(kinds.count("response") == 1 for kinds in by_payload.values()) and len(by_payload) == 4
    names = [h.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0] for h in (bytes(r["header"]) for r in original_records(spark, path).collect())]
    assert len(set(names)) == len(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("payloads_")]


def test_empty(spark):
    path = archive(spark, [])
    assert read_archive(spark, path).count() == 0
