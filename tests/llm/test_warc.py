import base64
import hashlib
import uuid

from tokentide.llm.warc import read_archive, write_archive

PAGES = "page_id bigint, url string, html string, address string"


def archive(spark, tmp_path, rows, **options):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    write_archive(spark.createDataFrame([(*r, "clash") for r in rows], PAGES), path, **options)
    return path, read_archive(spark, path).collect()


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/é\r\nX-Page-ID: 9", "<p>ü</p>"), (3, None, "<p>ü</p>"), (9, "u", None), (1, "u", ""), (7, "u", "x" * 300_000), (8, "u", "<p>ü</p>\n"), (4, "u", "solo")]
    path, got = archive(spark, tmp_path, rows)
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = html[r["page_id"]]
        first = min(i for i in html if html[i] == body)
        assert bytes(r["payload"]) == body and r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["record_type"] == ("response" if r["page_id"] == first else "revisit")
        assert r["refers_to"] == (None if r["page_id"] == first else first)
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields["Content-Length"]) == len(rest) - 4
        assert rest == (body if r["record_type"] == "response" else b"") + b"\r\n\r\n"
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(set(html.values()))


def test_small_payloads_repeats_and_null_ids(spark, tmp_path):
    rows = [(2, "u", "ab"), (1, "u", "ab"), (2, "u", "abcd"), (2, "u", "abcd"), (3, "u", "abcd"), (None, "u", "abcd"), (None, "u", "only"), (None, "v", "only")]
    path, got = archive(spark, tmp_path, rows, revisit_bytes=3)
    kinds = sorted((r["page_id"] or 0, bytes(r["payload"]), r["record_type"], r["refers_to"]) for r in got if r["page_id"] != 0)
    assert [k for k in kinds if k[1] == b"ab"] == [(1, b"ab", "response", None), (2, b"ab", "response", None)]
    assert sorted((k[0], k[2]) for k in kinds if k[1] == b"abcd") == [(0, "revisit"), (2, "response"), (2, "response"), (3, "revisit")]
    assert [k[2] for k in kinds if k[1] == b"only"] == ["response", "response"]
    assert len(got) == len(rows) and spark.read.parquet(f"{path}/payloads").count() == 3


def test_no_pages(spark, tmp_path):
    assert archive(spark, tmp_path, [])[1] == []


def test_ids_that_are_no_numbers(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    write_archive(spark.createDataFrame([("b-1", "u", "same"), ("a-1", "v", "same"), (None, "w", "other")], "page_id string, url string, html string"), path)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["verified"]) for r in read_archive(spark, path).collect()}
    assert got == {"a-1": ("response", None, True), "b-1": ("revisit", "a-1", True), None: ("response", None, True)}
