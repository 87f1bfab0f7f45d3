import gzip
import hashlib
import random

import pytest

from sitewright.llm import queries, warc

PAGES = "page_id long, url string, html string"


def pages():
    big = "<html>" + "ü" * 600 + "</html>"
    return [(1, "http://a/", "x"), (2, "http://b/", big), (3, "http://b/2", big), (9, "http://c d/\n", big), (4, None, None), (5, "http://e/", ""), (6, "http://f/", "x"), (None, "http://g/", big), (9, "http://c d/\n", big), (7, "u", "WARC/1.0\r\n\r\n" * 200 + "\r\n\r\n"), (8, "v", "\x00" * 5000), (10, "w", "long " * 100_000), (None, "n", "y" * 2000), (None, "n", "y" * 2000)]


def plain(rows):
    found = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, body in found:
        same = [q for q, b in found if b == body]
        newest = max((q for q in same if q is not None), default=None)
        revisit = len(body) >= 1000 and len(same) > 1 and newest is not None and (p is None or p < newest)
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out, key=repr)


def test_query_by_brute_force(spark, tmp_path):
    frame = spark.createDataFrame(pages(), PAGES).selectExpr("*", "1 as digest", "2 as newest", "3 as value", "4 as content")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.queries()["op10_warc_from_arc"](spark, str(tmp_path)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == plain(pages())


def test_empty(spark):
    assert warc.read_archives(spark, warc.archive(spark.createDataFrame([], PAGES))).count() == 0


def test_files_are_warc(spark, tmp_path):
    path = warc.archive(spark.createDataFrame(pages()[:4], PAGES).coalesce(1), f"file://{tmp_path}/w")
    (file,) = tmp_path.glob("w/part-*.gz")
    data = gzip.open(file).read()
    records = list(warc.parse_warc(iter([data])))
    infos = [r for r in records if r.headers["WARC-Type"] == "warcinfo"]
    assert len(infos) == 2 and len({r.headers["WARC-Record-ID"] for r in infos}) == 2 and b"description: converted from ARC version 2" in infos[1].block
    assert len(records) == 6 and data.startswith(b"WARC/1.0\r\n") and data.endswith(b"\r\n\r\n")
    for size in (1, 7, 100):
        assert list(warc.parse_warc(data[k : k + size] for k in range(0, len(data), size))) == records
    records = [r for r in records if r not in infos]
    kinds = {r.headers["WARC-Target-URI"]: r.headers["WARC-Type"] for r in records}
    assert kinds == {"http://a/": "response", "http://b/": "revisit", "http://b/2": "revisit", "http://c d/%0A": "response"}
    assert len({r.headers["WARC-Record-ID"] for r in records}) == 4 and path


def test_streams_of_pieces(spark, tmp_path):
    """Payloads full of the mark that ends records, one large page, and files in several members or without compression."""
    rng = random.Random(3)
    rows = [(k, f"http://x/{k}", "".join(rng.choice(("\r\n\r\n", "\r\n", "\r", "\n", "a", "\r\n\r\n\r\n\r\n", "WARC/1.0\r\n")) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows.append((1000, "http://x/big", "ä\r\n\r\n" * 3_000_000))
    path = warc.archive(spark.createDataFrame(rows, PAGES).repartition(2), f"file://{tmp_path}/w")
    expected = sorted((k, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows)
    seen = lambda p: sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, p).where("type <> 'warcinfo'").collect())
    assert seen(path) == expected
    (tmp_path / "v").mkdir()
    for number, file in enumerate(sorted(tmp_path.glob("w/part-*.gz"))):
        data = gzip.open(file).read()
        if number % 2:
            (tmp_path / f"v/{number}.warc").write_bytes(data)
        else:
            records = [warc.warc_text(r) + b"\r\n\r\n" for r in warc.parse_warc(iter([data]))]
            (tmp_path / f"v/{number}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    assert seen(f"file://{tmp_path}/v") == expected


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_of_either_version(version):
    records = [({"url": "http://a b/c", "ip_address": "1.2.3.4", "archive_date": "20240131123059", "content_type": "text/html", "result_code": "200", "checksum": "abc"}, b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nbody\n\nwith lines"), ({"url": "dns:x", "ip_address": "-", "archive_date": "1999", "content_type": "text/dns"}, b"")]
    head, first, second = warc.parse_arc(warc.arc_file(version, records))
    assert head.url.startswith("filedesc:") and first.version == version and first.url == "http://a b/c" and first.body == records[0][1] and second.body == b""
    assert version == 1 or first.fields["Checksum"] == "abc"
    info, response, resource = (warc.to_warc(r) for r in (head, first, second))
    assert [r.headers["WARC-Type"] for r in (info, response, resource)] == ["warcinfo", "response", "resource"]
    assert response.headers["WARC-Date"] == "2024-01-31T12:30:59Z" and resource.headers["WARC-Date"] == "1999-01-01T00:00:00Z" and response.headers["WARC-IP-Address"] == "1.2.3.4"
    assert warc.label_hex(response.headers["WARC-Payload-Digest"]) == hashlib.sha1(b"body\n\nwith lines").hexdigest()
    assert warc.to_warc(first).headers["WARC-Record-ID"] == response.headers["WARC-Record-ID"]


def test_damaged_archives():
    good = warc.arc_file(1, [({"url": "u", "ip_address": "-", "archive_date": "2000", "content_type": "t"}, b"12345")])
    for bad in (good[:-4], good.replace(b" 5\n", b" x\n"), good.replace(b"filedesc", b"filedisc"), b"one line"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
    assert list(warc.parse_arc(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse_warc(iter([b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"])))


def test_numbers_in_identifiers():
    for n in (0, 1, 2**62, 2**63 - 1, -1, -(2**63)):
        assert warc.urn_page(f"<{warc.page_urn(n)}>") == n
    assert warc.urn_page("urn:uuid:12345678-1234-5678-1234-567812345678") is None


def test_gzip_members():
    data = gzip.compress(b"abc" * 1000) + gzip.compress(b"def")
    assert b"".join(warc.inflated(data, 64)) == b"abc" * 1000 + b"def" and b"".join(warc.inflated(b"plain")) == b"plain"
