"""WARC archives: one gzip member a record, read in sequence with bounded memory.

The writer is a map over partitions. Each task writes files of its own under fresh names and
hands back their names; only the names of tasks that Spark counts as done reach the manifest,
so files of failed or repeated tasks are never read. The reader inflates piece by piece,
frames records by Content-Length and checks every digest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lookup, new_folder, text_of, written

#: Payloads below this many bytes are always stored in full.
REVISIT_FROM = 100
#: A file is closed once it has this many bytes.
FILE_BYTES = 64 << 20
#: Bytes taken from a file at once.
PIECE = 64 << 10
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAFE = "".join(chr(i) for i in range(33, 127) if chr(i) not in "%<>")


class WarcError(ValueError):
    """The archive breaks the format, or a digest does not fit its content."""


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = [VERSION, f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"{k}: {v}".encode() for k, v in fields]
    head += [b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode(), b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A page as a response, or as a revisit: the HTTP head alone, which still tells the length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.insert(0, ("WARC-Target-URI", quote(url, safe=SAFE)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return record("revisit" if revisit else "response", f"urn:page:{page_id}", fields, http if revisit else http + payload)


def _chunks(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield bytes(piece)


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """What each gzip member holds, as a stream of (bytes, ended) steps joined per member."""
    inflate, held = None, bytearray()
    for piece in pieces:
        while piece:
            if inflate is None:
                inflate = zlib.decompressobj(31)
            try:
                held += inflate.decompress(piece)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            piece = inflate.unused_data
            if inflate.eof:
                yield bytes(held)
                inflate, held = None, bytearray()
            elif not framed(held):
                raise WarcError("a member holds more than its record")
    if inflate is not None:
        raise WarcError("the last member is cut off")


def framed(held: bytearray) -> bool:
    """Whether what a member has given so far still fits one record; a header may have any length, as a URL may."""
    end = held.find(b"\r\n\r\n")
    if end < 0:
        return True
    length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", held[: end + 2], re.IGNORECASE)
    return length is not None and len(held) <= end + 4 + int(length[1]) + 4


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (names in lower case) and the block of one record."""
    end = member.find(b"\r\n\r\n")
    if end < 0 or not member.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    lines = member[:end].decode("utf-8").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    block = member[end + 4 : end + 4 + length]
    if len(block) != length or member[end + 4 + length :] != b"\r\n\r\n":
        raise WarcError("the block does not have the length that the header gives")
    said = fields.get("warc-block-digest")
    if said and said != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError("the block does not fit its digest")
    return fields, block


def pages_of(pieces: Iterable[bytes]) -> Iterator[dict]:
    """A row for each response and revisit of an archive."""
    for member in members(pieces):
        fields, block = parse(member)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        head, cut, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", head, re.IGNORECASE)
        if not cut or length is None:
            raise WarcError("no HTTP head")
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != int(length[1]) or hashlib.sha256(payload).hexdigest() != digest):
            raise WarcError("the payload does not fit its digest")
        number = lambda name: None if (x := fields.get(name, "<urn:page:None>")[10:-1]) == "None" else int(x)
        url = fields.get("warc-target-uri")
        yield {"page_id": number("warc-record-id"), "url": None if url is None else unquote(url), "payload_bytes": int(length[1]), "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit, refers_to: which page is stored and which refers to it.

    The smallest page_id of a digest is found with a map-side combine over narrow rows; a
    digest that a third of all pages share is neither gathered nor sorted anywhere.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html").cast("long"))
    groups = rows.where(F.col("n") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    rows = lookup(rows, groups, "digest", ["first"], "copies", F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write the records of plan_records() below folder; the manifest (file, records, bytes)."""

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    out.write(info := record("warcinfo", f"urn:file:{name}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    size += len(info)
                page_id, url, html, digest, refers_to, revisit = row
                member = page_record(page_id, url, html.encode(), digest, refers_to, revisit)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    return written(plan.mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The pages in the files that the manifest names; payload is null for revisits."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for files in batches:
            for name in files.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for row in pages_of(_chunks(stream)):
                        rows.append(row)
                        held += row["payload_bytes"] * payloads + 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    spark = manifest.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kinds = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "payload": "binary"}
    return manifest.select("file").repartition(tasks, "file").mapInArrow(read, ", ".join(f"{n} {kinds[n]}" for n in names))


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Pages, written as WARC archives into the shared folder and read back.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload). A null
    html is an empty payload. Rows that repeat the smallest page_id of a payload are all
    responses; a null page_id never is the smallest; repeated rows give a record each. URLs and
    texts of any length are written and read whole, one record at a time. An empty table gives no
    rows. Other columns of pages, whatever their names, are ignored.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages), folder), folder, payloads)
