"""WARC archives: written by the text sink, read back with boundary-chain verification.

Writing.  A WARC file is its records end to end, each closed by two line ends; that is what the text sink
writes when a row is a record and the line separator is two line ends.  Of equal payloads one record
is a response and the others revisit it.

Reading.  A payload may itself hold the magic of a record, so finding the magic is not enough.
Tasks emit each candidate with the offset at which its successor must begin.  Starting with the file's first
byte, pointer jumping (reach what is reached, then double every pointer) keeps only the records on the
chain; a magic inside a payload is never on it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, LongType

from tessella.llm.common import hot_of, named, new_path, skewed_join, stored

EOL = "\r\n"
LEAST = 100
#: Bytes an archive file is meant to have; a task reads a whole one.
FILE_BYTES = 32 << 20
#: Records of up to so many times the mean size share files; of larger ones, those of up to FILE_BYTES are BESIDE to a file and the rest alone.
UNEVEN, BESIDE = 16, 16
#: Up to this many digests with copies (about 100 bytes each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
MAGIC = re.compile(rb"WARC/1\.1\r\n")
BLANK = re.compile(rb"\r\n\r\n")
FIELD = re.compile(rb"\r\n(Content-Length|X-Page-Id|X-Refers-To-Page-Id|WARC-Type|WARC-Payload-Digest): ([^\r\n]*)(?=\r\n)")
#: The record type of the row that stands for a file's end.
END = "end"
CANDIDATE = "archive string, offset long, next long, bytes long, page_id string, record_type string, refers_to string, stated string, payload_bytes long, payload_digest string"


def _lines(*lines: Column) -> Column:
    return F.concat(*[F.concat(F.coalesce(line, F.lit("")), F.lit(EOL)) for line in lines])


def _written(id_: Column) -> Column:
    """An id as a field's value: nothing for null, else a sign and the id, in which what could end the line is escaped."""
    return F.coalesce(F.concat(F.lit("="), F.url_encode(id_.cast("string"))), F.lit(""))


def _read_back(value: str, kind: DataType) -> Column:
    return F.when(F.col(value) != "", F.url_decode(F.substr(F.col(value), F.lit(2)))).cast(kind)


def records(pages: DataFrame, *, id_col="page_id", url_col="url", payload_col="html", least=LEAST, date="2024-01-01T00:00:00Z") -> DataFrame:
    """(record, n): the text of a WARC record per row of pages, and its payload's length.

    Among payloads of at least `least` bytes that are equal, the rows of the smallest id are responses
    (all of them, should the id repeat) and others revisits; if none of a group has an id, all are responses.
    Ids may be numbers or text.  Null payloads and urls are empty; line ends in urls go.  Texts may be of any length.
    """
    id_, url, payload = named(id_col, url_col, payload_col)
    page = pages.select(id_.alias("id"), url.alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    # payloads too short to be compared have no name to be joined by
    page = page.withColumn("copied", F.when(F.col("n") >= least, F.col("digest")))
    groups = page.where("copied IS NOT NULL").groupBy("copied").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where("n > 1 AND first IS NOT NULL"), "copies")
    firsts = groups.select("copied", "first")
    if groups.count() <= BROADCAST_ROWS:
        joined = page.join(F.broadcast(firsts), "copied", "left")
    else:
        joined = skewed_join(page, firsts, ["copied"], hot_of(groups, "copied"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda i: F.regexp_replace(F.md5(F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("-")), "digest")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("n")), F.lit(""))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), name(F.col("id")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Page-Id: "), _written(F.col("id"))),
        F.concat(F.lit("X-Refers-To-Page-Id: "), F.when(revisit, _written(F.col("first"))).otherwise(F.lit(""))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), name(F.col("first")), F.lit(">"))).otherwise(F.lit("X-Full: yes")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
        F.lit(""),
    )
    return joined.select(F.concat(head, block).alias("record"))


def write(pages: DataFrame, path: str, *, url_col="url", payload_col="html", file_bytes=FILE_BYTES, **names) -> None:
    """Write the archive files of pages below path; no file can grow beyond UNEVEN times file_bytes unless a single record does.

    Records of about one size share files, as many as their mean size allows; where some are far above it, pages are written in up to three
    classes of sizes, for each of which the number of records in a file bounds its bytes.
    """
    length = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    payload, url = named(payload_col, url_col)
    size = length(payload) + length(url) + 600
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    mean, most = mean or 600.0, most or 600
    even = UNEVEN * mean
    classes = [(0, even, file_bytes / mean)]
    if most > even:
        classes += [(even, max(even, file_bytes), BESIDE), (max(even, file_bytes), most, 1)]
    made = records(pages, url_col=url_col, payload_col=payload_col, **names)
    bytes_ = F.octet_length("record")
    for i, (low, high, held) in enumerate(classes):
        if low < high:
            own = made if len(classes) == 1 else made.where((bytes_ > low if i else F.lit(True)) & (bytes_ <= high if i < 2 else F.lit(True)))
            own.write.mode("append").option("lineSep", EOL * 2).option("maxRecordsPerFile", max(1, int(held))).text(path)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ") for f in CANDIDATE.split(", ")]
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in fields])
    for batch in batches:
        for archive, content in zip(batch["path"], batch["content"]):
            data = memoryview(content.as_buffer()) if len(content.as_buffer()) else memoryview(b"")
            rows = []
            end, last = -1, {}
            for m in MAGIC.finditer(data):
                at = m.start()
                if end < at:
                    # heads that end at the same blank line are searched and read once
                    if (blank := BLANK.search(data, at)) is None:
                        break
                    end = blank.start()
                    last = {f[1]: (f.start(), f[2]) for f in FIELD.finditer(data, at, end + 2)}
                field = {name: value for name, (place, value) in last.items() if place > at}
                try:
                    length = int(field[b"Content-Length"])
                    page, refers = (field[f].decode("ascii") for f in (b"X-Page-Id", b"X-Refers-To-Page-Id"))
                    kind = field[b"WARC-Type"].decode("ascii")
                    stated = field[b"WARC-Payload-Digest"].decode("ascii").removeprefix("sha256:")
                except (KeyError, ValueError):
                    continue  # not the head of a record
                start, stop = end + 4, end + 4 + length
                if length < 0 or bytes(data[stop : stop + 4]) != b"\r\n\r\n":
                    continue
                block = data[start:stop]
                body = bytes(block).find(b"\r\n\r\n") + 4
                rows.append((archive.as_py(), at, stop + 4, len(data), page, kind, refers, stated, length - body, hashlib.sha256(block[body:]).hexdigest()))
            rows.append((archive.as_py(), len(data), None, len(data), None, END, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of the archives below path that reads as a record, with its successor's offset, and each file's end."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_candidates, CANDIDATE)


def on_chain(found: DataFrame) -> DataFrame:
    """(archive, offset) of the candidates that the chain from each file's first byte reaches, by pointer jumping."""
    jump = found.where(F.col("next").isNotNull()).select("archive", "offset", "next")
    reached = stored(found.select("archive").distinct().withColumn("offset", F.lit(0).cast("long")), "reached")
    # a written table looks smaller than it is in memory: none of these joins may turn into a broadcast
    n, before = reached.count(), -1
    while n != before:
        # what 2**k steps lead to from what is reached; then pointers of twice that length
        more = reached.join(jump.hint("merge"), ["archive", "offset"]).select("archive", F.col("next").alias("offset"))
        reached = stored(reached.unionAll(more).distinct(), "reached")
        far = jump.select("archive", F.col("offset").alias("next"), F.col("next").alias("then"))
        jump = stored(jump.join(far.hint("merge"), ["archive", "next"]).select("archive", "offset", F.col("then").alias("next")), "jump")
        before, n = n, reached.count()
    return reached


def read(spark: SparkSession, path: str, id_type: DataType = LongType()) -> DataFrame:  # noqa: B008
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the verified records of the archives below path.

    A response's length and digest come from its payload as stored, a revisit's from the response it
    refers to.  Empty files and folders give no rows.  A file that is not records from its first byte to its last is
    an error, and so is a response whose payload has not the digest that its head states: nothing is left out unseen.
    """
    found = stored(candidates(spark, path), "candidates")
    kept = found.join(on_chain(found).hint("merge"), ["archive", "offset"])
    kept = stored(kept.withColumns({c: _read_back(c, id_type) for c in ("page_id", "refers_to")}), "records")
    ends = kept.where(F.col("record_type") == END).select("archive")
    broken = found.where(F.col("record_type") == END).join(ends, "archive", "left_anti").select("archive").take(3)
    if broken:
        raise ValueError(f"not records from end to end: {', '.join(r[0] for r in broken)}")
    full = kept.where("record_type = 'response'")
    wrong = full.where("NOT stated <=> payload_digest").select("archive", "offset").take(3)
    if wrong:
        raise ValueError(f"payloads that are not what their records state: {', '.join(f'{r[0]} at {r[1]}' for r in wrong)}")
    again = kept.where(~F.col("record_type").isin("response", END)).select("page_id", "record_type", "refers_to", F.col("stated").alias("digest"))
    uses = stored(again.groupBy("refers_to", "digest").agg(F.count(F.lit(1)).alias("n")), "revisited")
    known = full.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes")
    known = known.join(uses, ["refers_to", "digest"], "left_semi").groupBy("refers_to", "digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    again = skewed_join(again, known, ["refers_to", "digest"], hot_of(uses, "refers_to", "digest"), "left")
    columns = ["page_id", "payload_bytes", F.col("payload_digest"), "record_type", "refers_to"]
    return full.select(*columns).unionAll(again.select("page_id", "payload_bytes", F.when(F.col("payload_bytes").isNotNull(), F.col("digest")).alias("payload_digest"), "record_type", "refers_to"))


def round_trip(pages: DataFrame, *, id_col="page_id", **names) -> DataFrame:
    """Write pages as archives in the shared folder and read them back.

    A row per row of pages, repeated ones included; null payloads are empty.  An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, id_col=id_col, **names)
    return read(spark, path, pages.schema[id_col].dataType)
