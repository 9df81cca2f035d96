"""WARC: archives written by Spark's own writer, read back, and assembled into captures.

Writing: each page becomes a response (or revisit), a request and a metadata record; the latter two
name the first in WARC-Concurrent-To.  Records are lines of the text sink with the record separator as
line end, so that the commit protocol of Spark's writer covers lost executors; each archive holds at
most ``records_per_archive`` records.  Reading: archives are parsed by Content-Length, one archive at a
time.  Assembly: a join through the concurrent-to identifiers, with one nested row per capture; payloads
don't take part in the joins unless asked for.

Defined results: a null payload counts as empty; null urls and ids are written as empty fields and read
back as null; equal rows give equal records and one capture each; rows that share the largest page_id of
a payload are all responses; an empty table gives an empty table; long payloads are written whole.  A
request or metadata record that names no known record makes no capture; a request may name another
request or metadata record, up to ``hops`` steps from the response.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fresh_path, stored

EOL = "\r\n"

RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, warc_date string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str | Column, rid: Column, date: str, uri: Column, extra: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """Text of a record without its closing separator; a field with a null value is left out."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri)]
    head += [F.concat(F.lit(f"{k}: "), v) for k, v in extra]
    head += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *head), F.lit(EOL + EOL), block)


def write_archives(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_archive: int = 12_288, archive_bytes: int = 1 << 30) -> None:
    """Write the records of ``pages`` (page_id, url, html) as gzip-compressed WARC archives under ``path``.

    Of pages whose payloads are equal and have at least ``least`` bytes, the one with the largest page_id
    is written as response and the others as revisits that refer to it.  An archive has at most
    ``records_per_archive`` records, and fewer where the longest page would make it more than
    ``archive_bytes`` (three records of one page at least).
    """
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7f]", "")
    base = pages.select(F.col("page_id"), uri.alias("uri"), F.coalesce("html", F.lit("")).alias("body"))
    base = base.select("*", F.sha1("body").alias("digest"), F.octet_length("body").alias("size"))
    first = (
        base.where(F.col("size") >= least).groupBy("digest")
        .agg(F.max_by(F.struct("page_id", "uri"), F.struct("page_id", "uri")).alias("rep"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("digest").alias("d"), F.col("rep.page_id").alias("rep_page"), _uuid(F.col("rep.page_id"), F.col("rep.uri"), F.col("digest")).alias("rep_id"))
    )
    rows = base.join(first, F.col("digest") == F.col("d"), "left")
    again = F.col("rep_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("rep_page"))
    rid = _uuid(F.col("page_id"), F.col("uri"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    profile = ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    main = _record(F.when(again, F.lit("revisit")).otherwise(F.lit("response")), rid, date, F.col("uri"), [digest, profile, ("WARC-Refers-To", F.when(again, F.col("rep_id")))], "application/http; msgtype=response", F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body"))))
    request = _record("request", _uuid(rid, F.lit("request")), date, F.col("uri"), [("WARC-Concurrent-To", rid)], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{EOL}Accept: text/html{EOL}{EOL}")))
    meta = _record("metadata", _uuid(rid, F.lit("metadata")), date, F.col("uri"), [("WARC-Concurrent-To", rid)], "application/warc-fields", F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL)))
    longest = base.agg(F.max("size")).first()[0] or 0
    records_per_archive = max(3, min(records_per_archive, archive_bytes * 3 // (longest + 4096)))  # one record in three has a page
    (
        rows.select(F.explode(F.array(request, main, meta)).alias("value"))
        .write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)
    )


def unpacked(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """An archive's bytes, a step at a time: plain, or gzip with any number of members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest, d = memoryview(content), zlib.decompressobj(31)
    while len(rest) or d.unconsumed_tail:
        if not d.unconsumed_tail:
            feed, rest = rest[:step], rest[step:]
        yield d.decompress(d.unconsumed_tail or feed, 16 * step)
        if d.eof:
            tail = d.unused_data  # of the part fed last; the next member starts there
            rest, d = memoryview(content)[len(content) - len(rest) - len(tail) :], zlib.decompressobj(31)
            if bytes(rest[:2]) != b"\x1f\x8b":
                return
    yield d.flush()


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], list[str], bytes]]:
    """(named fields in lower case, concurrent-to ids, block) of each record; blocks end by length, not by text.

    Memory is one record and one chunk.
    """
    chunks, held, at = iter(chunks), bytearray(), 0

    def more() -> bool:
        nonlocal at
        chunk = next(chunks, None)
        if chunk is None:
            return False
        del held[:at]
        at = 0
        held.extend(chunk)
        return True

    while True:
        while (start := held.find(b"WARC/", at)) < 0 or (stop := held.find(b"\r\n\r\n", start)) < 0:
            at = max(at, len(held) - 4) if start < 0 else start
            if not more():
                return
        at, named, beside = start, {}, []
        for line in bytes(held[at:stop]).decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            if k.lower() == "warc-concurrent-to":
                beside.append(v.strip())
            named[k.strip().lower()] = v.strip()
        head, size = stop + 4 - at, int(named["content-length"])
        while len(held) - at < head + size:
            if not more():
                raise ValueError("a record ends before its length")
        yield named, beside, bytes(held[at + head : at + head + size])
        at += head + size


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records under ``path``: one row each, payload size and digest computed from the bytes read.

    A revisit holds no payload; its size and digest are those that its header fields state.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.replace("array<string>", "a").replace("map<string,string>", "m").split(", ")]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for named, beside, block in records_in(unpacked(content.as_py())):
                    kind, fields, payload = named.get("warc-type", ""), {}, block
                    if named.get("content-type", "").startswith("application/http"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
                    elif named.get("content-type") == "application/warc-fields":
                        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if k}
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if kind == "revisit":
                        size, digest = int(fields.get("content-length", 0)), named.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((kind, named.get("warc-record-id"), beside, named.get("warc-refers-to"), named.get("warc-target-uri") or None, named.get("warc-date"), size, digest, list(fields.items()), payload if with_payload and kind == "response" else None))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame, hops: int = 2) -> DataFrame:
    """One nested row per capture: the response or revisit with its requests and metadata records.

    ``records``: as ``read_records`` gives them.  A request or metadata record belongs to the response
    that it names, directly or through at most ``hops`` - 1 other records.
    """
    anchors = records.where(F.col("type").isin("response", "revisit", "resource"))
    rest = records.where(~F.col("type").isin("response", "revisit", "resource")).drop("payload")
    links = rest.select(F.col("record_id").alias("from_id"), F.explode("concurrent_to").alias("to_id")).distinct()
    known = anchors.select(F.col("record_id").alias("anchor_id")).distinct()
    reach = links.join(known, F.col("to_id") == F.col("anchor_id"), "left_semi").select("from_id", F.col("to_id").alias("anchor"))
    for _ in range(hops - 1):
        step = links.alias("l").join(reach.alias("r"), F.col("l.to_id") == F.col("r.from_id")).select(F.col("l.from_id"), "r.anchor")
        reach = reach.union(step).distinct()
    beside = (
        rest.dropDuplicates(["record_id"]).join(reach, F.col("record_id") == F.col("from_id"))
        .groupBy("anchor").agg(F.collect_list(F.struct("type", "record_id", "fields")).alias("beside"))
    )
    of = lambda kind: F.filter("beside", lambda x: x["type"] == kind)
    return anchors.join(beside, F.col("record_id") == F.col("anchor"), "left").select(
        F.struct("type", "record_id", "refers_to", "target_uri", "warc_date", "payload_bytes", "payload_digest", "fields", "payload").alias("response"),
        of("request").alias("requests"), of("metadata").alias("metadata"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The query: write archives of ``pages``, read them, assemble captures, resolve what revisits refer to."""
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    id_type = pages.schema["page_id"].dataType.simpleString()
    records = stored(read_records(spark, path), "records")  # the archives are parsed once
    got = assemble(records).select(
        F.expr(f"try_cast(nullif(element_at(metadata, 1).fields['page_id'], '') as {id_type})").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("ref"),
    )
    got = stored(got, "captures", heavy=True)
    dropped(records)
    again = got.where("record_type = 'revisit'")
    target = got.where("record_type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["target_id"])
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = got.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast(id_type))
    return plain.select(*cols).unionByName(again.join(target, F.col("ref") == F.col("target_id"), "left").select(*cols))
