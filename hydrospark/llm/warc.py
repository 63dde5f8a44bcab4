"""WARC archives: written as request, response (or revisit) and metadata
records per page, and read back as one nested row per capture.

Records are text, so Spark's text source writes and reads them: the separator
when reading is the start of a record, which lets any number of tasks split an
uncompressed archive. A field with a token drawn per archive follows the
version line, so no payload can contain the separator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.llm.common import broadcast_if_small, cut_lineage

VERSION = "WARC/1.1\r\n"
# base32 digits of the usual digest notation, and those of base 32 in conv().
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_NL2 = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: 5 hex digits are 4 base32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _CONV32, _BASE32)


def _record(token: str, kind: str, record_id: Column, fields: list[tuple[str, Column]], content_type: str,
            block: Column) -> Column:
    head = [F.lit(f"{VERSION}WARC-Boundary: {token}\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind,
            F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    # The text sink ends each value with the last line feed.
    return F.concat(*head, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "),
                    F.octet_length(block).cast("string"), F.lit(_NL2), block, F.lit("\r\n\r"))


def _uuid(*parts: Column) -> Column:
    """A name-based id: the MD5 of the parts in the notation of a UUID."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, i, n) for i, n in
                                                           ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def with_roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
               min_bytes: int = 0) -> DataFrame:
    """(page, url, payload, payload_bytes, digest, keep_page, keep_url, keep_rows, revisit) per page.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with
    the largest id is kept; the others revisit it. Repeated rows of that id
    (``keep_rows`` of them) are all kept. Only digests that occur again are
    joined back (broadcast while few), so a payload that stands alone meets
    nothing, and one that a third of all pages share is one row of the join.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("page"), F.regexp_replace(
        F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("urn:none")), "[\\r\\n]", "%0A").alias("url"),
        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"))
    base = base.withColumns({"digest": base32_sha1(F.col("payload")),
                             "payload_bytes": F.octet_length("payload").cast("long")})
    per_page = (base.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes", "page")
                .agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("url")))
    kept = cut_lineage(
        per_page.groupBy("digest", "payload_bytes")
        .agg(F.max("page").alias("keep_page"), F.max(F.struct("page", "url", "n")).alias("m"), F.sum("n").alias("rows"))
        .where("rows > 1").select("digest", "payload_bytes", "keep_page", F.col("m.url").alias("keep_url"),
                                  F.col("m.n").alias("keep_rows")))
    joined = base.join(broadcast_if_small(kept, 500_000), ["digest", "payload_bytes"], "left")
    return joined.withColumn("revisit", F.col("keep_rows").isNotNull() & ~F.col("page").eqNullSafe(F.col("keep_page")))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                  min_bytes: int = 0, captured_at: str = "2024-01-01T00:00:00Z", records_per_file: int = 60_000,
                  compression: str = "gzip") -> str:
    """Write the records of all pages to ``path`` (a folder) and return the
    archive's boundary token.

    A null html is an empty payload; a null url is ``urn:none``; line breaks in
    an url are percent-encoded; a null id leaves its metadata field empty. Other
    columns are ignored. An empty table writes no record. The record that others
    revisit is named by ``WARC-Refers-To``; where its page has repeated rows, so
    that no single record is meant, only its uri and digest are.
    """
    token = uuid.uuid4().hex
    rows = with_roles(pages, id_col, html_col, url_col, min_bytes).withColumns(
        {f"{k}_id": F.concat(F.lit("urn:uuid:"), F.uuid()) for k in ("own", "req", "meta")})
    # The kept record of repeated payloads has an id that its revisits can name.
    named = _uuid(F.lit(token), F.col("digest"), F.col("payload_bytes").cast("string"), F.col("keep_page").cast("string"))
    one = F.coalesce(F.col("keep_rows") == 1, F.lit(False))
    rows = rows.withColumn("res_id", F.when(one & ~F.col("revisit"), named).otherwise(F.col("own_id")))
    date = ("WARC-Date", F.lit(captured_at))
    uri = ("WARC-Target-URI", F.col("url"))
    to = ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("res_id"), F.lit(">")))
    again = F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_NL2))
    response = _record(token, F.when(again, "revisit").otherwise("response"), F.col("res_id"), [
        date, uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(again & one, F.concat(F.lit("<"), named, F.lit(">")))),
        ("WARC-Refers-To-Target-URI", F.when(again, F.col("keep_url")))],
        "application/http; msgtype=response", F.when(again, http).otherwise(F.concat(http, F.col("payload"))))
    request = _record(token, "request", F.col("req_id"), [date, uri, to], "application/http; msgtype=request",
                      F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{_NL2}")))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(token, "metadata", F.col("meta_id"), [date, uri, to], "application/warc-fields", fields)
    (rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.option("lineSep", "\n").option("compression", compression)
     .option("maxRecordsPerFile", records_per_file).text(path))
    return token


_ANY = "WARC/1."


def _rejoin(batches):
    """Records from the sorted pieces (file, block, at, piece) of files in which
    a separator stood inside a record: a piece belongs to the record before it
    until that one's Content-Length is filled."""
    import re

    import pyarrow as pa

    length_of = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
    file, parts, need = None, [], 0

    def done():
        # A record is its own bytes; what follows them up to the next separator is dropped with the blank lines.
        data = _ANY.encode().join(parts)
        return pa.RecordBatch.from_pydict({"file": [file], "piece": [data]}, schema=pa.schema(
            [("file", pa.string()), ("piece", pa.binary())]))

    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if parts and (name != file or need <= 0):
                yield done()
                parts = []
            if not parts:
                head, _, block = piece.partition(b"\r\n\r\n")
                m = length_of.search(head)
                need = int(m[1]) - len(block) if m else 0
            else:
                need -= len(piece) + len(_ANY)
            file = name
            parts.append(piece)
    if parts:
        yield done()


def _pieces(spark: SparkSession, path: str, boundary: str | None) -> DataFrame:
    """The text of each record behind its version line, as ``value``."""
    if boundary:  # an archive of write_archive: no payload can hold the separator
        start = f"{VERSION}WARC-Boundary: {boundary}\r\n"
        # Before the first record stands an empty piece.
        return spark.read.schema("value string").option("lineSep", start).text(path).where("value <> ''")
    read = spark.read.schema("value string").option("lineSep", _ANY).text(path).where("value <> ''")
    raw = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), "value")
    head = F.substring_index("value", _NL2, 1)
    stated = F.regexp_extract(head, r"(?im)^content-length:[ \t]*(\d+)", 1).try_cast("long")
    # A record cut by its own payload lacks bytes; so do truncated ones.
    cut = F.coalesce(stated > F.octet_length("value") - F.octet_length(head) - 4, ~F.col("value").rlike("^[01]\r\n"))
    broken = cut_lineage(raw.where(cut).groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file"))
    hint = broadcast_if_small(broken, 500_000)
    whole = raw.join(hint, "file", "left_anti").select("value")
    some = raw.join(hint, "file").select("file", "block", "at", F.col("value").cast("binary").alias("piece"))
    joined = some.repartition("file").sortWithinPartitions("file", "block", "at").mapInArrow(
        _rejoin, "file string, piece binary")
    return whole.unionByName(joined.select(F.col("piece").cast("string").alias("value"))).select(
        F.regexp_replace("value", "^[01]\r\n", "").alias("value"))


def read_records(spark: SparkSession, path: str, boundary: str | None = None) -> DataFrame:
    """Records of all archives in ``path`` (plain or gzip): header, type,
    record_id, concurrent_to (an array, the header may be repeated), block,
    complete (the block has the length that it states).

    ``Content-Length`` decides where a record ends: files in which a payload
    holds a version line are read record by record, each file in one task (of
    archives with a ``boundary`` token none is). A record without type or id has
    nulls there; a cut record is what is left of it, not complete; repeated
    records stay. A folder without records gives an empty table.
    """
    value = F.col("value")
    head = F.substring_index(value, _NL2, 1)
    split = _pieces(spark, path, boundary).select(head.alias("header"), value.alias("value"))
    body = F.expr("substring(value, length(header) + 5)")
    # Behind the block stand two line ends; without a boundary the stated length is looked at first.
    trimmed = F.expr("substring(value, length(header) + 5, length(value) - length(header) - 8)")

    def values(name):
        return F.regexp_extract_all("header", F.lit(rf"(?im)^{name}:[ \t]*<?([^\r\n>]*)>?\r?$"), F.lit(1))

    def field(name):
        return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*<?([^\r\n>]*)>?\r?$", 1), F.lit(""))

    stated = field("Content-Length").try_cast("long")
    block = F.when(F.octet_length(trimmed) == stated, trimmed).when(
        F.octet_length(body) > stated,
        F.substring(F.encode(body, "UTF-8"), F.lit(1), stated.cast("int")).cast("string")).otherwise(body)
    return split.select(
        "header", field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"),
        F.filter(values("WARC-Concurrent-To"), lambda x: x != "").alias("concurrent_to"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        field("WARC-Refers-To").alias("refers_to"), field("WARC-Refers-To-Target-URI").alias("refers_to_uri"),
        block.alias("block"), F.coalesce(F.octet_length(block) == stated, F.lit(False)).alias("complete"))


def _transactions(records: DataFrame) -> DataFrame:
    """(record_id, capture): the request and metadata records of each response or
    revisit. Concurrent-to holds in either direction; a record that is concurrent
    to no response itself belongs to the captures of those it is concurrent to."""
    ends = records.select("record_id", "type", F.explode("concurrent_to").alias("other")).where("record_id is not null")
    links = (ends.select("record_id", "other").unionByName(
        ends.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))).distinct()
    kinds = records.where("record_id is not null").select("record_id", F.col("type").isin("response", "revisit").alias("full")) \
        .distinct()
    typed = cut_lineage(links.join(kinds, "record_id").join(
        kinds.select(F.col("record_id").alias("other"), F.col("full").alias("other_full")), "other"))
    direct = typed.where("not full and other_full").select("record_id", F.col("other").alias("capture"))
    lost = typed.where("not full and not other_full").join(direct.select("record_id").distinct(), "record_id", "left_anti")
    over = lost.select("record_id", "other").join(
        direct.select(F.col("record_id").alias("other"), "capture"), "other").select("record_id", "capture").distinct()
    return direct.unionByName(over)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row per capture: each response or revisit with ``requests`` and
    ``metadatas``, arrays of the records that are concurrent to it (either one
    may name the other), by record id; ``request`` and ``metadata`` are the first
    of each (null where there is none).

    Digest and length of a response are computed from its payload; those of a
    revisit are the stated ones of the full payload. Equal repeated records of a
    capture count once; responses without an id are captures alone; records of
    other types and requests without a response are left out. Only record ids
    and the blocks of requests and metadata are joined and gathered. Without
    ``with_payload`` the archive is read once, into a table of all but payloads.
    """
    http = F.substring_index("block", _NL2, 1)
    capture = F.col("type").isin("response", "revisit")
    res = records.select(
        "record_id", "type", "target_uri", "refers_to", "refers_to_uri", "stated_digest", "complete", "concurrent_to",
        F.when(capture, http).alias("http"), F.when(~capture, F.col("block")).alias("block"),
        F.expr("substring(block, length(substring_index(block, '\\r\\n\\r\\n', 1)) + 5, length(block))").alias("payload"))
    full = F.col("type") == "response"
    rows = res.where("type in ('request', 'response', 'revisit', 'metadata')").select(
        "record_id", "type", "concurrent_to", "block", "target_uri", "refers_to", "refers_to_uri", "http", "payload",
        "complete", F.when(full, F.octet_length("payload").cast("long")).otherwise(
            F.regexp_extract("http", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("long")).alias("payload_bytes"),
        F.when(full, base32_sha1(F.col("payload"))).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "stated_digest")
    if with_payload:
        small = cut_lineage(rows.select("record_id", "type", "concurrent_to", "block"))
    else:
        rows = small = cut_lineage(rows.drop("payload"))
    res = rows.where(capture).drop("concurrent_to", "block").withColumnRenamed("type", "record_type")

    def meta_field(name):
        got = F.regexp_extract("block", rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1)
        return F.nullif(got, F.lit("")).alias(name.replace("-", "_"))

    parts = _transactions(small).join(small.where("block is not null").select("record_id", "type", "block"), "record_id")
    request = F.struct("record_id", F.substring_index("block", "\r\n", 1).alias("line"))
    metadata = F.struct("record_id", meta_field("page-id"), F.col("block").alias("fields"))
    nested = parts.groupBy("capture").agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "request", request))).alias("requests"),
        F.array_sort(F.collect_set(F.when(F.col("type") == "metadata", metadata))).alias("metadatas"))
    out = res.join(nested, res.record_id == nested.capture, "left").drop("capture")
    none = {c: F.coalesce(F.col(c), F.expr(f"cast(array() as {nested.schema[c].dataType.simpleString()})"))
            for c in ("requests", "metadatas")}
    return out.withColumns(none).withColumns({"request": F.get("requests", F.lit(0)), "metadata": F.get("metadatas", F.lit(0))})


def originals(captures: DataFrame) -> DataFrame:
    """``captures`` with ``original``, the metadata of the response that a
    revisit refers to: the record of ``WARC-Refers-To``, else any response with
    the stated payload digest (of several the one with the largest metadata)."""
    full = captures.where("record_type = 'response'")
    by_id = full.where("record_id is not null").select(F.col("record_id").alias("_to"), F.col("metadata").alias("_by_id"))
    by_digest = full.groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("metadata").alias("_by_digest"))
    revisit = F.col("record_type") == "revisit"
    # Captures that refer to nothing get keys of their own, which spreads them over the tasks of the joins.
    alone = F.concat(F.lit("none "), F.coalesce("record_id", F.lit("")))
    j = captures.withColumns({
        "_ref": F.coalesce(F.when(revisit, F.col("refers_to")), alone),
        "_sum": F.coalesce(F.when(revisit & F.col("refers_to").isNull(), F.col("stated_digest")), alone)})
    j = j.join(by_id, F.col("_ref") == F.col("_to"), "left").join(by_digest, F.col("_sum") == F.col("_digest"), "left")
    return j.withColumn("original", F.coalesce("_by_id", "_by_digest")).drop("_ref", "_sum", "_to", "_by_id", "_digest", "_by_digest")
