import gzip
import re

from cartloom.llm import op10_warc as w

HTML = "<p>" + "words é \r\n\r\n WARC/1.1 \r\n" * 12 + "\r"
ROWS = [(4, "http://a/", HTML), (2, "http://b/\r\nX: 1", HTML), (9, None, HTML), (5, "u", "short"), (6, "u", "short"), (7, "v", None), (8, "v", ""), (None, "n", HTML), (2, "again", HTML), (11, "w", "\n\n" * 80), (12, "w", "\n\n" * 80 + "x")]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    w.write_archives(w.resolve_revisits(pages.repartition(3)), f"{tmp_path}/warc")
    back = w.read_archives(spark, f"{tmp_path}/warc", with_payload=True).collect()
    got = sorted(((r.record_id, r.url, r.record_type, r.payload_bytes, r.refers_to, r.payload) for r in back), key=str)
    want = []
    for i, url, html in ROWS:
        data = (html or "").encode()
        revisit = html == HTML and i != 2
        want.append((None if i is None else str(i), None if url is None else url.replace("\r\n", ""), "revisit" if revisit else "response", len(data), "2" if revisit else None, None if revisit else data))
    assert got == sorted(want, key=str)
    files = list((tmp_path / "warc").glob("*.gz"))
    heads = [h for f in files for h in re.findall(rb"(?s)WARC/1\.1\r\n(WARC-Type.*?)\r\n\r\n", gzip.open(f).read())]
    fields = [dict(x.split(b": ", 1) for x in h.split(b"\r\n")) for h in heads]
    names = {f[b"WARC-Record-ID"]: f for f in fields}
    for f in fields:
        assert re.fullmatch(rb"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", f[b"WARC-Record-ID"])
        assert re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f[b"WARC-Date"])
        if f[b"WARC-Type"] == b"revisit":
            response = names[f[b"WARC-Refers-To"]]
            assert response[b"WARC-Type"] == b"response" and response[b"WARC-Payload-Digest"] == f[b"WARC-Payload-Digest"]
        else:
            assert f[b"Content-Type"].startswith(b"text/html")
    assert len(fields) == len(ROWS)
    assert files and sum(gzip.open(f).read().count(b"WARC-Record-ID:") for f in files) == len(ROWS)


def test_empty_table_and_damage(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    w.write_archives(w.resolve_revisits(none), f"{tmp_path}/none")
    assert w.read_archives(spark, f"{tmp_path}/none").collect() == []
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha256:00\r\nX-Payload-Length: 2\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for name, data in (("digest", good), ("cut", good[:-6])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.txt.gz").write_bytes(gzip.compress(data))
        try:
            w.read_archives(spark, f"{tmp_path}/{name}").collect()
        except Exception as error:
            assert "digest" in str(error) or "ends within" in str(error)
        else:
            raise AssertionError(name)
