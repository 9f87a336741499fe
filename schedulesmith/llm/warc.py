"""WARC archives: writing with revisit records, reading back, and a merged capture index."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import attach, n_partitions, shared_folder, stored

# Smallest payload for which a copy becomes a revisit record.
REVISIT_BYTES = 0
# Records of one archive file, which is read whole; and captures of one range of the index.
FILE_RECORDS, RANGE_ROWS = 5_000, 1_000_000
# Parts of a WARC record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
# Captures are dated by their page number, a second apart, from this moment on (2024-01-01T00:00:00Z).
FIRST_CAPTURE = 1704067200


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary or text column as bare upper-case base32 (RFC 4648)."""
    digest = F.sha1(payload)
    # Forty bits at a time: ten hexadecimal digits are eight of base 32.
    quarter = lambda k: F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[quarter(k) for k in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort-friendly key of an address: reversed host, then path and query, lower case, without fragment."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\d*\.)?|#.*$", "")
    host = F.regexp_extract(rest, r"^([^/?:]*)", 1)
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def write_warc(pages: DataFrame, folder: str | None = None, revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write a WARC record per row of ``pages`` (page_id, url, html); returns the folder.

    Of records with equal payloads of ``revisit_bytes`` bytes or more, the one with the largest
    page_id is the response and the others are revisits that refer to it; smaller ones are all
    responses. Null html is an empty payload. Rows that repeat the largest page_id of their
    payload are responses too; a null page_id is the smallest. Control characters in a url are
    percent-encoded. Each file holds at most ``FILE_RECORDS`` records and is a run sorted by URL key and
    capture time, gzip-compressed; Spark's committer keeps it whole when executors are lost.
    """
    payload = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"),
                         F.octet_length(payload).cast("long").alias("bytes"))
    # Narrow rows and partial maxima: a payload on a third of all pages stays one row per task.
    latest = known.groupBy("digest").agg(F.max("page_id").alias("latest")).withColumnRenamed("digest", "same")
    typed = known.join(latest.hint("merge"), F.col("digest") == F.col("same")).withColumn(
        "revisit", (F.col("bytes") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest")))
    uri = F.coalesce("url", F.lit(""))
    for sign in "\r\n\t ":
        uri = F.replace(uri, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    moment = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(F.pmod("page_id", F.lit(10 ** 9)), F.lit(0)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("page_id")), line("WARC-Target-URI", uri),
        line("WARC-Date", F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("latest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"),
        http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    folder = folder or shared_folder(pages.sparkSession, "warc")
    runs = typed.select(record.alias("value"), url_key(F.col("url")).alias("key"), moment.alias("moment"), "page_id").sortWithinPartitions("key", "moment", "page_id")
    runs.select("value").write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)
    return folder


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields in lower case, block) of the records of an archive; fails on a damaged one."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        first, *fields = data[at:head_end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        header = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
        start, size = head_end + 4, int(header["content-length"])
        if data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        yield at, header, data[start:start + size]
        at = start + size + 4


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(parts)


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in ``folder``: file, byte offset, header fields, size and digest of the payload.

    The length and digest of a revisited payload are those that its record states; the digest
    of a response is computed from its payload and must agree with the header. ``payloads``
    adds the payload itself.
    """
    from base64 import b32encode
    from hashlib import sha1

    names = ["file", "at", "page_id", "url", "captured", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string()] * payloads
    number = re.compile(r"<urn:page:(-?\d*)>")

    def page(name: str | None) -> int | None:
        found = name and number.fullmatch(name)
        return int(found.group(1)) if found and found.group(1) else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, rows = batch.column(0)[k].as_py(), []
                for at, header, block in parse_records(gunzip(batch.column(1)[k].as_buffer().to_pybytes())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http).group(1))
                    digest = header["warc-payload-digest"].removeprefix("sha1:")
                    if header["warc-type"] == "response" and (len(payload) != size or b32encode(sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path}: payload at byte {at} does not match its header")
                    rows.append((path, at, page(header["warc-record-id"]), header["warc-target-uri"], header["warc-date"], header["warc-type"],
                                 page(header.get("warc-refers-to")), digest, size) + ((payload.decode("utf-8"),) if payloads else ()))
                for low in range(0, len(rows), 4096):
                    part = rows[low:low + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)

    schema = "file string, at long, page_id long, url string, captured string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(parse, schema + ", payload string" * payloads)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of the matches below, so the next row takes one match per level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        n = self.n = max(1, len(runs))
        self.tree = [0] * n
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self.before(a, b) else (b, a)
        self.tree[0] = winners[1] if n > 1 else 0

    def before(self, a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes first; an empty run comes last, the lower run wins a tie."""
        head_a = self.runs[a][self.at[a]] if a < len(self.runs) and self.at[a] < len(self.runs[a]) else None
        head_b = self.runs[b][self.at[b]] if b < len(self.runs) and self.at[b] < len(self.runs[b]) else None
        if head_a is None or head_b is None:
            return head_a is not None or (head_b is None and a < b)
        return (head_a, a) < (head_b, b)

    def __iter__(self) -> Iterator[tuple]:
        for _ in range(sum(map(len, self.runs))):
            run = self.tree[0]
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + self.n) // 2
            while node >= 1:
                if self.before(self.tree[node], run):
                    run, self.tree[node] = self.tree[node], run
                node //= 2
            self.tree[0] = run


def merge_index(captures: DataFrame, partitions: int | None = None) -> DataFrame:
    """The captures with ``url_key`` and ``index_at``, their place from 0 in the order of URL key, time and page.

    Every archive file is a sorted run. Ranges of (key, time, page) are dealt to tasks, also
    within one key, so a URL with a third of all captures is spread; their number follows from a count, so a range
    holds about ``RANGE_ROWS`` captures at most. In a range, the pieces of the runs keep their order and are merged by a
    loser tree. Ranges follow one another, so the rows of those before give a capture its place; captures equal in
    all three take places in the order of their runs.
    """
    keyed = stored(captures.withColumn("url_key", url_key(F.col("url"))), "captures")
    rows = keyed.count()
    n = partitions or max(min(n_partitions(captures.sparkSession), -(-rows // 4096)), -(-rows // RANGE_ROWS), 1)
    ranged = keyed.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first()).sortWithinPartitions("file", "at")
    names = keyed.columns
    key = [names.index(c) for c in ("url_key", "captured", "page_id")]
    schema = StructType(keyed.schema.fields).add("index_part", IntegerType()).add("index_place", LongType())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        files, keys = table.column("file").to_pylist(), list(zip(*[table.column(k).to_pylist() for k in key]))
        runs: list[list[tuple]] = []
        for i, (file, (url, moment, page)) in enumerate(zip(files, keys)):
            if not i or file != files[i - 1]:
                runs.append([])
            runs[-1].append(((url, moment, page is not None, page or 0), i))
        taken = pa.array([i for _, i in LoserTree(runs)], pa.int64())
        merged = table.take(taken).append_column("index_place", pa.array(range(len(taken)), pa.int64())).combine_chunks()
        yield from merged.to_batches(max_chunksize=4096)

    merged = stored(ranged.select("*", F.spark_partition_id().alias("index_part")).mapInArrow(merge, schema), "merged-captures")
    # One row per range.
    sizes = merged.groupBy("index_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("index_part").alias("part"), F.coalesce(F.sum("n").over(
        Window.orderBy("index_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = attach(merged, before, F.col("index_part") == F.col("part"))
    return placed.withColumn("index_at", F.col("before") + F.col("index_place")).drop("part", "before", "index_part", "index_place")
