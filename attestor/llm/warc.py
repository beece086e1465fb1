"""WARC archives: writing them as one gzip stream a file, and the normaliser that gives every record a member of its own.

write_archives makes WARC/1.1 records of pages. Of pages with equal payloads the one with the largest page_id is a response,
the others are revisits that refer to it. An archive is one gzip stream over all its records, of bounded size. normalise
inflates such a stream once, in chunks, rewrites every record as its own gzip member and writes a sidecar index with each
member's offset and length. read_records then inflates each record alone, by the index.
"""

from __future__ import annotations

import zlib
from base64 import b32encode
from collections.abc import Iterator
from gzip import compress, decompress
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import materialised, per_batch, read_binary_files, remove, shared_path, table, write_binary_files

#: Payload bytes after which an archive ends; a larger record has an archive of its own.
ARCHIVE_BYTES = 8 << 20
LEVEL = 6
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
#: Most revisits, and most bytes of gzipped indexes, that are broadcast; beyond them both are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_INDEX_BYTES = 500_000, 16 << 20
#: A gzip member of nothing: it ends in 0x00, as files of write_binary_files must, and readers skip it.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
DATE = "2024-01-01T00:00:00Z"
WARC = "WARC/1.1"


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _ended(content: bytes) -> bytes:
    """content, with an empty member after it unless it ends in the byte that files must end in."""
    return content if content[-1:] == b"\0" else content + EMPTY_MEMBER


def _line(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A response record with its HTTP block, or a revisit with the block's head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        WARC, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http + (payload if refers_to is None else b"")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Names in lower case and values of a head's lines after the first."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and payload of one record; the digest of a response
    is computed from the payload that was read."""
    head, _, block = raw.partition(b"\r\n\r\n")
    own = headers(head)
    block = block[: int(own["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(d) if (d := x.removeprefix("<urn:page:").removesuffix(">")) else None
    kind = own["warc-type"]
    if kind == "response":
        size, found = len(payload), digest(payload)
    else:
        size, found = int(headers(http_head)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
    return {
        "page_id": number(own["warc-record-id"]), "payload_bytes": size, "payload_digest": found, "record_type": kind,
        "refers_to": number(own["warc-refers-to"]) if "warc-refers-to" in own else None, "url": own.get("warc-target-uri", ""), "payload": payload if kind == "response" else None,
    }


def inflated(content: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, inflated once, in pieces of about a chunk at most."""
    at = 0
    while at < len(content):
        z = zlib.decompressobj(31)
        data = z.decompress(content[at : at + chunk], chunk)
        at += chunk
        yield data
        while not z.eof:
            if z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, chunk)
            elif at < len(content):
                yield z.decompress(content[at : at + chunk], chunk)
                at += chunk
            else:
                raise EOFError("the gzip stream is cut off")
        at = min(at, len(content)) - len(z.unused_data)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive; only one record and one piece are held."""
    held = bytearray()
    need: int | None = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise EOFError("the last record is cut off")


def normalised(content: bytes) -> tuple[bytes, bytes]:
    """An archive with one member a record, and its gzipped index: the archive's SHA-1, then for each record a line of page id,
    type, offset, length and payload digest."""
    members, index, at = [], [], 0
    for raw in split_records(inflated(content)):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        own = headers(raw[: raw.index(b"\r\n\r\n")])
        page = own["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        index.append(f"{page or '-'} {own['warc-type']} {at} {len(member)} {own['warc-payload-digest'].removeprefix('sha1:')}")
        members.append(member)
        at += len(member)
    archive = _ended(b"".join(members))
    return archive, _ended(compress("\n".join([sha1(archive).hexdigest(), *index, ""]).encode(), mtime=0))


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, refers_to (the largest page_id with the same payload, or null if it is the page's own).

    Payloads are compared by SHA-1. Ids are grouped without payloads, partially before the shuffle. Payloads stay where they
    are read while the revisits are few enough to go everywhere; else they move by page, so that copies never meet.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    ids = own.where(F.length("payload") >= least).select("page_id", F.sha1("payload").alias("sha1"))
    last = ids.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = materialised(ids.join(last, "sha1").where("page_id < refers_to").distinct(), "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    return own.withColumn("sha1", F.sha1("payload")).join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html), each one gzip stream over records of ARCHIVE_BYTES at most.

    A null html is empty, a null url too. Pages without a page_id are responses. Repeated rows with the largest page_id of
    their payload are all responses. Other columns aren't read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"content": pa.array([_ended(b"".join([*parts, z.flush()]))], pa.binary())})

        for batch in batches:
            for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page, url, payload, digest(payload), refers)
                if size and size + len(raw) > ARCHIVE_BYTES:
                    yield out()
                    z, parts, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                parts.append(z.compress(raw))
                size += len(raw)
        if size:
            yield out()

    write_binary_files(with_revisits(pages).mapInArrow(run, "content binary"), "content", path)


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrites the archives below source as target/kind=archive, with an index of each in target/kind=index."""
    def f(batch: pa.RecordBatch) -> dict:
        made = [x for c in batch.column(0).to_pylist() if c for x in zip(("archive", "index"), normalised(c), strict=True)]
        return {"kind": [k for k, _ in made], "content": [c for _, c in made]}

    both = per_batch(read_binary_files(spark, source).select("content"), "kind string, content binary", f, 1)
    write_binary_files(both, "content", target, "kind")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record below path, each inflated alone.

    An index names its archive by SHA-1. The digest of a response is computed from what was read; that of a revisit, which
    holds no payload, is its header's.
    """
    archives = read_binary_files(spark, f"{path}/kind=archive").select(F.sha1("content").alias("sha1"), F.col("content").alias("archive"))
    schema = "sha1 string, lines array<string>"

    def lines(batch: pa.RecordBatch) -> dict:
        own = [decompress(c).decode().splitlines() for c in batch.column(0).to_pylist() if c]
        return {"sha1": [x[0] for x in own], "lines": [x[1:] for x in own]}

    indexes = per_batch(read_binary_files(spark, f"{path}/kind=index").select("content"), schema, lines)
    fields = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def f(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in fields}
        for archive, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for line in own:
                _, _, at, size, _ = line.split(" ")
                found = parse(decompress(memoryview(archive)[int(at) : int(at) + int(size)]))
                for k in fields:
                    out[k].append(found[k])
        return out

    size = spark.read.format("binaryFile").load(f"{path}/kind=index").agg(F.sum("length")).first()[0]
    indexes = indexes.dropDuplicates(["sha1"])  # equal archives have equal indexes, and each archive is to meet one of them
    if (size or 0) <= BROADCAST_INDEX_BYTES:
        indexes = F.broadcast(indexes)
    pairs = archives.join(indexes, "sha1").select("archive", "lines")
    return per_batch(pairs, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long", f, 1)


def round_trip(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as archives in the shared folder, normalised there, and read back by their indexes."""
    spark = pages.sparkSession
    raw, path = shared_path(spark, "warc"), shared_path(spark, "warc-members")
    write_archives(pages, raw)
    normalise(spark, raw, path)
    remove(spark, raw)
    if not pages.take(1):
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_records(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
