"""WARC archives as seekable Zstandard bundles.

Each task writes one archive: its records are grouped into independent Zstandard frames of about ``frame_bytes`` of
plain records, and a skippable frame at the end holds the seek table (sizes of all frames, before and after decompression).
The manifest maps each record identifier to archive, frame and offset inside the decompressed frame, so a reader fetches
and decompresses one frame to get one record. Of records with equal payloads of at least ``least_revisit`` bytes, the
one with the smallest page id is a response, the others are revisits that refer to it and carry no payload. A page's record
identifier is derived from its id and digest, so a revisit names its response's record wherever that is written. Each
archive begins with a ``warcinfo`` record.

Archives are written under a name of their own per task attempt and moved into place when complete; only those named by
the manifest, which is cut to the shared folder, count. An attempt that dies leaves at most a file that nobody reads.

Defined cases: null html is an empty payload; pages without an id are written as responses with a null id and never
referred to; repeated rows are records of their own with identifiers of their own, and rows that repeat the smallest id of a
payload are all responses, to which revisits refer by page id alone;
an empty table writes no archive; null urls are written without a target URI.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, shared_dir

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("archive", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64())])
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("html", pa.binary())])


def line(name: str, value: object) -> bytes:
    text = " ".join(str(value).split())  # a header value is one line
    return f"{name}: {text}\r\n".encode()


def record_name(page_id: int, digest: str) -> str:
    """The identifier of the record of a page that is no repeated row."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id} {digest}"))


def warcinfo(name: str, date: str) -> bytes:
    block = line("software", "tidemark") + line("format", "WARC File Format 1.1")
    head = [b"WARC/1.1\r\n", line("WARC-Type", "warcinfo"), line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), line("WARC-Date", date)]
    head += [line("WARC-Filename", name), line("Content-Type", "application/warc-fields"), line("Content-Length", len(block))]
    return b"".join([*head, b"\r\n", block, b"\r\n\r\n"])


def record(record_id: str, date: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, named: bool) -> bytes:
    """One response, or a revisit of the page refers_to; named: whether that page's record has the identifier of ``record_name``."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + line("Content-Length", len(payload)) + b"\r\n"
    block = http + payload if refers_to is None else http
    head = [b"WARC/1.1\r\n", line("WARC-Type", "response" if refers_to is None else "revisit"), line("WARC-Record-ID", f"<urn:uuid:{record_id}>"), line("WARC-Date", date)]
    if page_id is not None:
        head.append(line("X-Page-ID", page_id))
    if url is not None:
        head.append(line("WARC-Target-URI", url))
    head += [line("WARC-Payload-Digest", f"sha256:{digest}"), line("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [line("WARC-Profile", PROFILE), line("X-Refers-To-Page-ID", refers_to)]
        if named:
            head.append(line("WARC-Refers-To", f"<urn:uuid:{record_name(refers_to, digest)}>"))
    return b"".join([*head, line("Content-Length", len(block)), b"\r\n", block, b"\r\n\r\n"])


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer alone."""
    source.seek(size - FOOTER)
    n, _, magic = struct.unpack("<IBI", source.read(FOOTER))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the archive")
    source.seek(size - FOOTER - 8 * n)
    entries = struct.iter_unpack("<II", source.read(8 * n))
    out, at = [], 0
    for compressed, plain in entries:
        out.append((at, compressed, plain))
        at += compressed
    return out


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def with_references(pages: DataFrame, least_revisit: int = 100) -> DataFrame:
    """(page_id, url, html binary, refers_to, named, own): only digests, sizes and ids are compared; the payloads meet their reference by page id.

    named: the row that refers_to means is no repeated row; own: this row is none.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    rows = base.where("page_id is not null").groupBy("page_id", "digest").agg(F.first(F.octet_length("html")).alias("n"), F.count("*").alias("copies"))
    long = rows.where(F.col("n") >= least_revisit)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min_by("copies", "page_id").alias("first_copies")).where("first < last")
    revisits = long.join(firsts.select("digest", F.col("first").alias("refers_to"), "first_copies"), "digest").where("page_id > refers_to")
    refs = revisits.select("page_id", "digest", "refers_to", (F.col("first_copies") == 1).alias("named"), "copies")
    repeated = rows.where("copies > 1").select("page_id", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("named"), "copies")
    notes = refs.unionByName(repeated).groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"), F.max("named").alias("named"), F.max("copies").alias("copies"))
    own = F.col("page_id").isNotNull() & (F.coalesce("copies", F.lit(1)) == 1)
    return base.join(notes, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", F.coalesce("named", F.lit(False)).alias("named"), own.alias("own"))


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 100, frame_bytes: int = 1 << 18, level: int = 3, date: str | None = None) -> DataFrame:
    """Writes the archives below folder; the manifest (archive, frame, offset, length, record_id, page_id), cut.

    date: when the pages were taken, as WARC-Date writes it; now, if not given. All records have the same.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, rows, sizes, plain, index = None, 0, [], bytearray(), []
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.warc.zst"
        pack = zstandard.ZstdCompressor(level=level)

        def flush():
            frame = pack.compress(bytes(plain))
            out.write(frame)
            sizes.append((len(frame), len(plain)))
            plain.clear()

        for batch in batches:
            for page_id, url, html, first, named, own in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/.{name}", compression=None)
                    plain += warcinfo(name, date)
                record_id = record_name(page_id, hashlib.sha256(html).hexdigest()) if own else str(uuid.uuid4())
                data = record(record_id, date, page_id, url, html, first, named)
                if plain and len(plain) + len(data) > frame_bytes:
                    flush()
                index.append((name, len(sizes), len(plain), len(data), record_id, page_id))
                plain += data
                rows += 1
            if len(index) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), MANIFEST, strict=True)], schema=MANIFEST)
                index.clear()
        if out is not None:
            flush()
            out.write(seek_table(sizes))
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), MANIFEST, strict=True)], schema=MANIFEST)

    manifest = with_references(pages, least_revisit).mapInArrow(write, "archive string, frame int, offset long, length long, record_id string, page_id long")
    return cut(manifest.withColumn("folder", F.lit(folder)))


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one decompressed frame, as rows of RECORD."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 8 + n
        if head["WARC-Type"] == "warcinfo":
            continue
        border = block.index(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in block[:border].decode().split("\r\n")[1:])
        kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
        payload = block[border + 4 :] if kind == "response" else None
        if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        page, first = head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")
        yield (page and int(page), size, digest, kind, first and int(first), head["WARC-Record-ID"][10:-1], head.get("WARC-Target-URI"), payload)


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the archives that the manifest names, frame by frame; every payload is checked against its digest."""
    archives = manifest.select("folder", "archive").distinct()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = filesystem(folder)
                with fs.open_input_file(f"{root}/{name}") as source:
                    rows += [(folder, name, *x) for x in read_seek_table(source, source.size())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["folder", "archive", "start", "size", "plain"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for folder, name, start, size, plain in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                fs, root = filesystem(folder)
                with fs.open_input_file(f"{root}/{name}") as source:
                    source.seek(start)
                    rows = list(parse(unpack.decompress(source.read(size), max_output_size=plain)))
                if not rows:  # the archive's warcinfo alone, before a record that fills a frame
                    continue
                whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)
                yield whole if payloads else whole.select(RECORD.names[:-1])

    listed = archives.mapInArrow(frames, "folder string, archive string, start long, size long, plain long")
    spread = listed.repartition(F.col("archive"), F.col("start"))
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string"
    return spread.mapInArrow(records, kinds + ", html binary" * payloads)


def fetch(manifest: DataFrame, page_ids: DataFrame) -> DataFrame:
    """(page_id, html, refers_to) of some pages by random access: only frames that hold them are read, each once; a revisit has its response's page id instead of html."""
    wanted = manifest.join(page_ids.select("page_id").distinct(), "page_id", "left_semi").select("folder", "archive", "frame", "offset", "length")
    dealt = wanted.repartition("folder", "archive", "frame").sortWithinPartitions("folder", "archive", "frame")
    names = ["page_id", "html", "refers_to"]

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, archive, table, at, plain = zstandard.ZstdDecompressor(), None, [], None, b""
        for batch in batches:
            rows = []
            for folder, name, frame, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (folder, name, frame) != at:
                    fs, root = filesystem(folder)
                    with fs.open_input_file(f"{root}/{name}") as source:
                        if (folder, name) != archive:
                            archive, table = (folder, name), read_seek_table(source, source.size())
                        start, size, whole = table[frame]
                        source.seek(start)
                        plain, at = unpack.decompress(source.read(size), max_output_size=whole), (folder, name, frame)
                one = next(parse(plain[offset : offset + length]))
                rows.append((one[0], one[7], one[4]))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names)

    return dealt.mapInArrow(get, "page_id long, html binary, refers_to long")
