import base64
import hashlib

from pyspark.sql import functions as F

from hydrospark.llm import warc


def read(spark, df, path, **kw):
    token = warc.write_archive(df, path, **kw)
    return warc.originals(warc.assemble(warc.read_records(spark, path, token)))


def test_round_trip(spark, tmp_path):
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny\r\n"
    rows = [(1, "http://a/", "<p>é𝄞</p>"), (2, "http://b/", "<p>é𝄞</p>"), (3, None, None), (4, "http://c/\r\nX: y", ""),
            (5, "http://d/", nasty), (6, "http://e/", "\n\n"), (7, "http://f/", "z" * 300_000), (None, "http://g/", "only"),
            (9, "http://a/", "<p>é𝄞</p>"), (9, "http://a/", "<p>é𝄞</p>"), (11, "http://h/", "\r\n\r\n")]
    df = spark.createDataFrame([(*r, "q", "w") for r in rows], "page_id long, url string, html string, digest string, payload string")
    got = read(spark, df, str(tmp_path / "w"), records_per_file=5)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "response" if i == top else "revisit", None if i == top else str(top)))
    out = got.collect()
    assert sorted(((str(r["metadata"]["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                    (r["original"] or {"page_id": None})["page_id"]) for r in out), key=str) == sorted(want, key=str)
    assert all(r["complete"] and r["request"]["line"].startswith("GET ") for r in out)
    assert all(r["payload_digest"] == r["stated_digest"] for r in out)
    body = {r["metadata"]["page_id"]: r["payload"] for r in out if r["record_type"] == "response"}
    assert body["5"] == nasty and body["11"] == "\r\n\r\n" and body["7"] == "z" * 300_000


def test_least_size_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")],
                               "page_id long, url string, html string")
    got = {r["metadata"]["page_id"]: r["record_type"] for r in
           read(spark, df, str(tmp_path / "a"), min_bytes=3, compression="none").collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    assert read(spark, df.where("false"), str(tmp_path / "b")).count() == 0


def test_foreign_archive(spark, tmp_path):
    (tmp_path / "f").mkdir()
    rec = ["WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 3\r\n\r\na\r\n\r\n\r\n",
           "WARC/1.1\r\nwarc-type: response\r\nWARC-Record-ID: <urn:r>\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200\r\n\r\nhello\r\n\r\n"]
    (tmp_path / "f" / "x.warc").write_bytes("".join(rec).encode())
    r = warc.assemble(warc.read_records(spark, str(tmp_path / "f"))).select("*", F.length("payload").alias("n")).first()
    assert (r["record_id"], r["payload"], r["complete"], r["request"], r["metadata"]) == ("urn:r", "hello", True, None, None)


def _rec(kind, rid, block, *headers, length=None, version="1.0"):
    n = len(block) if length is None else length
    head = "".join(f"{h}\r\n" for h in headers)
    return (f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{head}Content-Length: {n}\r\n\r\n".encode()
            + block + b"\r\n\r\n")


def brute_records(data):
    """(record id, block) by the lengths, from the start of the file."""
    out, at = [], 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        n = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        rid = next(x.split(b"<")[1].rstrip(b">") for x in head.split(b"\r\n") if x.lower().startswith(b"warc-record-id:"))
        out.append((rid.decode(), rest[:n].decode()))
        at += len(head) + 4 + n + 4
    return out


def test_foreign_transactions(spark, tmp_path):
    """Payloads with whole records in them, concurrent-to in both directions and
    over two steps, repeated headers and metadata, two versions."""
    import gzip

    inner = _rec("response", "urn:bogus", b"HTTP/1.1 200 OK\r\n\r\nfake" * 3) + b"WARC/1.1\r\n tail WARC/1. WARC/2"
    one = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n" + inner
    two = "HTTP/1.1 200 OK\r\n\r\né𝄞 WARC/1.0\r\nno header".encode()
    data = b"".join([
        _rec("warcinfo", "urn:i", b"software: x"),
        _rec("response", "urn:r1", one, "WARC-Concurrent-To: <urn:q1>", "WARC-Concurrent-To: <urn:m1>"),
        _rec("request", "urn:q1", b"GET /one HTTP/1.1\r\n\r\n"), _rec("metadata", "urn:m1", b"page-id: 1\r\n", version="1.1"),
        _rec("metadata", "urn:m2", b"page-id: 11\r\n", "WARC-Concurrent-To: <urn:r1>"),
        _rec("response", "urn:r2", two, version="1.1"),
        _rec("request", "urn:q2", b"GET /two WARC/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:r2>"),
        _rec("metadata", "urn:m3", b"page-id: 2\r\n", "WARC-Concurrent-To: <urn:q2>"),
        _rec("request", "urn:q2", b"GET /two WARC/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:r2>"),  # repeated
        _rec("request", "urn:q9", b"GET /lost HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:absent>"),
        _rec("revisit", "urn:v", b"HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n", "WARC-Refers-To: <urn:r2>")])
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc").write_bytes(data)
    (tmp_path / "f" / "b.warc.gz").write_bytes(gzip.compress(data.replace(b"urn:", b"gzn:")))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # the plain file is split between tasks
    try:
        records = warc.read_records(spark, str(tmp_path / "f"))
        got = records.collect()
        rows = {r["record_id"]: r for r in warc.originals(warc.assemble(records)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    want = brute_records(data)
    assert sorted((r["record_id"], r["block"]) for r in got) == sorted(want + [(a.replace("urn:", "gzn:"), b.replace("urn:", "gzn:"))
                                                                             for a, b in want])
    assert all(r["complete"] for r in got)
    assert sorted(rows) == ["gzn:r1", "gzn:r2", "gzn:v", "urn:r1", "urn:r2", "urn:v"]
    r1, r2, v = rows["urn:r1"], rows["urn:r2"], rows["urn:v"]
    assert r1["payload"] == inner.decode() and r2["payload"] == two.decode().split("\r\n\r\n", 1)[1]
    assert [x["line"] for x in r1["requests"]] == ["GET /one HTTP/1.1"]
    assert [x["page_id"] for x in r1["metadatas"]] == ["1", "11"]
    assert [x["line"] for x in r2["requests"]] == ["GET /two WARC/1.1"] and [x["page_id"] for x in r2["metadatas"]] == ["2"]
    assert v["requests"] == [] and v["original"]["page_id"] == "2" and v["payload_bytes"] == 7


def test_cut_and_headless_records(spark, tmp_path):
    (tmp_path / "f").mkdir()
    data = _rec("response", "urn:a", b"HTTP/1.1 200\r\n\r\nshort", length=500) + b""
    (tmp_path / "f" / "x.warc").write_bytes(data)
    (tmp_path / "f" / "y.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    got = {r["record_id"]: (r["type"], r["complete"]) for r in warc.read_records(spark, str(tmp_path / "f")).collect()}
    assert got == {"urn:a": ("response", False), None: (None, True)}
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "f"))).count() == 1


def test_refers_to_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bb"), (3, "u", "bb"), (1, "u", "bb")],
                               "page_id long, url string, html string")
    out = read(spark, df, str(tmp_path / "w")).collect()
    ids = {r["record_id"]: r for r in out}
    assert len(ids) == 5  # repeated rows have ids of their own
    refs = {r["metadata"]["page_id"] + r["payload_digest"][:1]: (r["refers_to"], r["original"]["page_id"])
            for r in out if r["record_type"] == "revisit"}
    assert len(refs) == 2
    for to, page in refs.values():
        assert page in ("2", "3") and (ids[to]["metadata"]["page_id"] == page if to else page == "3")
