"""WARC archives: captures written as request, response or revisit, and metadata records, and read back
by joining the records of a transaction through their concurrent-to identifiers.

Spark's text writer makes the files: a record ends with the two line breaks that serve as the line
separator, so each file is a plain WARC 1.1 file (compressed as a whole), committed by Spark on any file
system. Pages are dealt to as many files as keep each at about FILE_BYTES, and a reader inflates a file piece by
piece, so that it holds a record, not a file, besides the compressed bytes. Records are found again by their
Content-Length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_counted, partitions, stored

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Payload bytes of a file, about: pages are dealt out by a hash, whole.
FILE_BYTES = 64_000_000
_PIECE = 1 << 20


def captures_of(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(uid, uri, payload, key, bytes, digest, type, refers) for each row of pages, dealt out for files: type is response
    or revisit, refers the record id of the response that a revisit repeats.

    Rows are known by two hashes of key, url and payload; rows equal in all of them are told apart by a number.
    """
    uri = F.regexp_replace(F.regexp_replace(F.col(f"`{url}`"), r"[\r\n]", "%0A"), r"[\x00-\x20\x7F]", "%20")
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    own = pages.select(F.col(f"`{key}`").alias("key"), uri.alias("uri"), text.alias("payload"))
    own = own.select(F.xxhash64("key", "uri", "payload").alias("ia"), F.xxhash64(F.lit(1), "key", "uri", "payload").alias("ib"), "*")
    light = own.select("ia", "ib", "key", F.octet_length("payload").cast("long").alias("bytes"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    light = light.groupBy(*light.columns).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    light = stored(light.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), "pages")
    large = light.withColumn("same", F.when(F.col("bytes") >= LEAST_BYTES, F.col("digest")))
    row = F.struct(F.col("key").isNull().alias("no"), "key", "ia", "ib", "copy")
    groups = large.where("same IS NOT NULL").groupBy("same").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = light.agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"), F.max("copies").alias("copies")).first()
    told = join_counted(large, groups, "same", "n", total["rows"])
    uid = lambda of: F.concat(F.lower(F.hex(F.col(f"{of}ia"))), F.lit("-"), F.lower(F.hex(F.col(f"{of}ib"))), F.lit("-"), F.col(f"{of}copy").cast("string"))
    again = F.col("first").isNotNull() & ~row.eqNullSafe(F.col("first"))
    told = told.select("ia", "ib", uid("").alias("uid"), "key", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, _record_id(F.col("first.key"), uid("first."))).alias("refers"))
    whole = total["bytes"] or 0
    files = max(1, -(-whole // FILE_BYTES), min(partitions(pages.sparkSession), whole // (FILE_BYTES // 16)))
    texts = own.select("ia", "ib", "uri", "payload")
    if (total["copies"] or 0) > 1:
        texts = texts.dropDuplicates(["ia", "ib"])
    # Texts and what is told about them meet in the files' own shuffle, whatever their sizes.
    own, more = F.struct("uri", "payload").alias("own"), F.struct("uid", "key", "bytes", "digest", "type", "refers").alias("told")
    both = texts.select("ia", "ib", own).unionByName(told.select("ia", "ib", more), allowMissingColumns=True).repartition(files, "ia", "ib")
    met = both.withColumn("own", F.first("own", ignorenulls=True).over(W.partitionBy("ia", "ib").orderBy(F.col("told").isNotNull())))
    return met.where("told IS NOT NULL").select("own.*", "told.*")


def _record_id(key: Column, uid: Column, kind: str = "response") -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), uid, F.lit(f":{kind}>"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes three records for each row of pages: request, response or revisit, metadata.

    Of rows with equal payloads of at least LEAST_BYTES bytes, that with the smallest key (nulls last, ties by a hash of
    the row) is the response. Null html is an empty payload; a null url has no target; in a
    url, controls and blanks are percent-encoded. Rows that repeat are captures of their own. Other columns of
    pages play no part. Payloads move in one shuffle.
    """
    p = captures_of(pages, key, url, html)
    nl = "\r\n"
    own = _record_id(F.col("key"), F.col("uid"))

    def record(kind: Column, rid: Column, mime: str, block: Column, *more: Column) -> Column:
        target = F.when(F.col("uri").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("uri"), F.lit(nl))).otherwise("")
        return F.concat(
            F.lit(f"WARC/1.1{nl}WARC-Type: "), kind, F.lit(f"{nl}WARC-Record-ID: "), rid, F.lit(f"{nl}WARC-Date: {date}{nl}"), target, *more,
            F.lit(f"Content-Type: {mime}{nl}Content-Length: "), F.octet_length(block).cast("string"), F.lit(nl * 2), block,
        )

    head = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("bytes").cast("string"), F.lit(nl * 2))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(nl))
    refers = F.when(F.col("refers").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), F.col("refers"), F.lit(f"{nl}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{nl}"))).otherwise("")
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), own, F.lit(nl))
    host = F.coalesce(F.regexp_extract("uri", r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
    records = F.array(
        record(F.lit("request"), _record_id(F.col("key"), F.col("uid"), "request"), "application/http;msgtype=request", F.concat(F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{nl}Host: "), host, F.lit(nl * 2)), concurrent),
        record(F.col("type"), own, "application/http;msgtype=response", F.concat(head, F.when(F.col("type") == "response", F.col("payload")).otherwise("")), digest, refers),
        record(F.lit("metadata"), _record_id(F.col("key"), F.col("uid"), "metadata"), "application/warc-fields", F.concat(F.lit("page-id: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(nl)), concurrent),
    )
    p.select(F.explode(records).alias("value")).write.options(lineSep="\r\n\r\n", compression="gzip").text(path)


_FIELDS = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, computed_digest string, block binary"


def _inflated(data: bytes) -> Iterator[bytes]:
    """An archive's plain bytes, piece by piece; gzipped ones may have one member or many."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[at : at + _PIECE]) for at in range(0, len(view), _PIECE))
        return
    at = 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.unconsumed_tail or view[at : at + _PIECE]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            at += 0 if member.unconsumed_tail else len(piece)
            yield member.decompress(piece, 4 * _PIECE)
        at -= len(member.unused_data)


class _Reader:
    """Bytes of an archive in order: until(mark) and take(n), None at its end."""

    def __init__(self, data: bytes):
        self.pieces, self.held = _inflated(data), bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is stepped over."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes | None:
        while len(self.held) < n:
            if not self._more():
                return None
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(values of each header by lower-case name, block) of each record of an archive, plain or gzipped (one member or many)."""
    reader = _Reader(data)
    while reader.until(b"WARC/1.") is not None:
        head = reader.until(b"\r\n\r\n")
        if head is None:
            raise ValueError("the archive ends within a record")
        fields: dict[str, list[str]] = {}
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        block = reader.take(int(fields["content-length"][0]))
        if block is None:
            raise ValueError("the archive ends within a record")
        yield fields, block


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """A row for each record. payload_bytes: of the full payload (a revisit has it in its HTTP header);
    computed_digest: SHA-256 of the payload that a response holds; concurrent_to: all records that it names; block: null
    unless asked for. Files of other makers can have any size that Spark's binaryFile reads (2 GB, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                held = 0
                for f, block in parse(batch.column(0)[i].as_py()):
                    one = lambda name, f=f: f.get(name, [None])[0]
                    size = computed = None
                    kind = one("warc-type")
                    if kind in ("response", "revisit"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        of = [x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size = int(of[0].split(b":")[1]) if of else len(payload)
                        computed = hashlib.sha256(payload).hexdigest() if kind == "response" else None
                    keep = block if blocks or kind == "metadata" else None
                    rows.append((kind, one("warc-record-id"), f.get("warc-concurrent-to", []), *map(one, ("warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")), size, computed, keep))
                    held += len(keep or b"")
                    if len(rows) >= 5000 or held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: (capture_id, response, requests array, metadata array).

    response: the struct of the response or revisit record. Other records belong to the response that one of their
    concurrent-to identifiers names or that names them; else to the one that a record linked with them in such a way
    belongs to (metadata that names only its request). Of several, the smallest identifier counts. What belongs to no
    response goes to the capture of the smallest identifier that it names, or to one of its own, without a response.
    """
    hub = F.col("type").isin("response", "revisit")
    ids = stored(records.select("record_id", hub.alias("hub"), "concurrent_to"), "records")
    links = ids.select(F.col("record_id").alias("a"), F.col("hub").alias("ha"), F.explode("concurrent_to").alias("b"))
    hubs = ids.where("hub").select(F.col("record_id").alias("h"))
    named = links.where("ha").select(F.col("b").alias("r"), F.col("a").alias("h"))
    naming = links.where("NOT ha").join(hubs, F.col("b") == F.col("h")).select(F.col("a").alias("r"), "h")
    near = stored(named.unionByName(naming).groupBy("r").agg(F.min("h").alias("h")), "near")
    both = links.where("NOT ha").select("a", "b").unionByName(links.where("NOT ha").select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(near, F.col("b") == F.col("r")).groupBy("a").agg(F.min("h").alias("far"))
    belongs = ids.where("NOT hub").select("record_id", F.array_min("concurrent_to").alias("lost")).join(near, F.col("record_id") == F.col("r"), "left").join(far, F.col("record_id") == F.col("a"), "left")
    belongs = belongs.select(F.col("record_id").alias("of"), F.coalesce("h", "far", "lost", "record_id").alias("capture")).groupBy("of").agg(F.min("capture").alias("capture"))
    keyed = records.join(belongs, F.col("record_id") == F.col("of"), "left").withColumn("capture_id", F.when(hub, F.col("record_id")).otherwise(F.coalesce("capture", "record_id")))
    row = F.struct("record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "computed_digest", "block")
    every = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, row)))
    return keyed.groupBy("capture_id").agg(
        F.min_by(F.when(hub, row), F.when(hub, F.col("record_id"))).alias("response"), every("request").alias("requests"), every("metadata").alias("metadata")
    )
