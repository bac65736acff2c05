"""Dictionary-compressed WARC archives (.warc.zst).

Each task writes its pages to archives of its own in the shared folder: a Zstandard dictionary, trained on a bounded sample
of the records that are archived, lies in a skippable frame at the head; then each record is a Zstandard frame of its own.
A manifest table names the archives that tasks finished; one that a lost executor or a repeated task
left behind is in no manifest and is never read.  Of pages with equal payloads of at least ``least`` bytes the one with the
smallest id is a response; the others revisit it and hold its digest and the payload's length, not the payload.  Which are which
is settled on digests; payloads don't shuffle.

Null html is an empty payload.  Repeated rows with the smallest id are all responses.  A null id is archived without id and
never the smallest, unless all are null: then all are responses.  A null url gives a record without one.
Empty tables give no archives and no rows.  Other columns may have any names.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.bloom import RepeatFilter
from readloom.llm.common import join_by_key, materialise, release, sampled, scratch

LEAST = 100
#: The dictionary's sample: records, and characters of each one's payload.
SAMPLE_RECORDS, SAMPLE_CHARS = 1024, 16_384
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: An archive is closed at about so many bytes.
ARCHIVE_BYTES = 1 << 30
DATE = "2020-01-01T00:00:00Z"
#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    headers = [("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
        headers.append(("WARC-Target-URI", uri))
        if uri != url:
            headers.append(("X-Page-URL", json.dumps(url)))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return _record(kind, headers, block + (payload if kind == "response" else b""))


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the samples; where they are too few to train one, their first bytes serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if len(data) < 8:
        return None
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if data.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    def __init__(self, stream, dictionary: bytes, level: int = LEVEL):
        self.stream, self.records = stream, 0
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self.bytes = self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)
        given = _dictionary(dictionary)
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=given) if given else zstandard.ZstdCompressor(level=level)
        info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.bytes += self._put(self.codec.compress(info))

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        return len(data)

    def add(self, record: bytes) -> None:
        self.bytes += self._put(self.codec.compress(record))
        self.records += 1


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, headers (lower case) and block, a record in memory at a time."""
    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    data = stream.read(size)
    given = _dictionary(zstandard.ZstdDecompressor().decompress(data) if data.startswith(FRAME_MAGIC) else data)
    codec = zstandard.ZstdDecompressor(dict_data=given) if given else zstandard.ZstdDecompressor()
    with io.BufferedReader(codec.stream_reader(stream, read_across_frames=True), 1 << 18) as plain:
        while line := plain.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"no record starts with {line[:40]!r}")
            headers = {}
            while (line := plain.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[name.lower()] = value
            n = int(headers["content-length"])
            block, end = plain.read(n), plain.read(4)
            if len(block) != n or end != b"\r\n\r\n":
                raise ValueError("an archive ends within a record")
            yield headers, block


def _write_batches(folder: str, dictionary: bytes, level: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, done = None, []

        def close():
            out.stream.close()
            done.append((f"{folder}/{name}", out.records, out.bytes))

        for batch in batches:
            payloads = batch.column(6).cast(pa.binary())
            for *row, payload in zip(*(batch.column(i).to_pylist() for i in range(6)), payloads):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    store.create_dir(root, recursive=True)
                    out = ArchiveWriter(store.open_output_stream(f"{root}/{name}"), dictionary, level)
                page_id, url, digest, size, kind, refers = row
                out.add(page_record(page_id, url, payload.as_py() or b"", digest, size, kind, refers))
                if out.bytes >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array([d[i] for d in done]) for i in range(3)], ["path", "records", "bytes"])

    return run


def _read_batches(with_payload: bool):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    wide = len(names) if with_payload else len(names) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], kinds[i]) for i in range(wide)], names[:wide])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(local) as stream:
                    for headers, block in read_archive(stream):
                        kind = headers["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        url = json.loads(headers["x-page-url"]) if "x-page-url" in headers else headers.get("warc-target-uri")
                        ids = [int(headers[h]) if h in headers else None for h in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], url, size, digest, kind, ids[1], payload if kind == "response" else None))
                        held += len(block) * with_payload + 500
                        if held > 1 << 23:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST,
    level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes the archives to a new folder of the shared one, or to folder.  Returns the manifest: path, records, bytes."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    page_id, url = F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")
    # of pages with one id, only those with equal payloads share a key
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("n")), F.xxhash64(html).cast("string")).alias("key")
    facts = [page_id, url, F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size")]
    rows = pages.select(*facts, html.alias("html"), key)
    narrow = materialise(pages.select(*facts, key, F.xxhash64(html).alias("h")), "pages")
    n = narrow.count()
    # which pages revisit another is settled without their payloads
    maybe = narrow.filter((F.col("size") >= least) & RepeatFilter.build(narrow.select("h"), n).test(F.col("h")))
    groups = maybe.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("w")).filter(F.col("first").isNotNull() & (F.col("w") > 1))
    met = join_by_key(maybe.drop("h"), groups, "digest", "w", n, F.xxhash64("key"), "inner")
    revisits = materialise(met.filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "url", "digest", "size", "first", "key"), "revisits")
    # payloads stay where they are: pages whose key no revisit has are responses; the few others that only seem to have one meet their list
    gone = RepeatFilter.build(revisits.select(F.xxhash64("key").alias("h")), revisits.count(), least=1)
    seem = narrow.filter(gone.test(F.xxhash64("key"))).join(revisits.select("key").distinct(), "key", "left_anti").select("key").distinct()
    seem = materialise(seem, "seeming_revisits")
    kept = RepeatFilter.build(seem.select(F.xxhash64("key").alias("h")), seem.count(), least=1)
    there = gone.test(F.xxhash64("key"))
    responses = rows.filter(~there).unionByName(rows.filter(there & kept.test(F.xxhash64("key"))).join(seem, "key", "left_semi"))
    null = F.lit(None)
    decided = responses.select("page_id", "url", "digest", "size", F.lit("response").alias("kind"), null.cast("long").alias("refers_to"), "html")
    decided = decided.unionByName(revisits.select("page_id", "url", "digest", "size", F.lit("revisit").alias("kind"), F.col("first").alias("refers_to"), null.cast("string").alias("html")))

    at = F.pmod(F.xxhash64("digest"), F.greatest(F.length("html") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    piece = F.substring("html", at, F.lit(SAMPLE_CHARS))
    sample = rows.select("page_id", "url", "digest", piece.alias("piece"), F.xxhash64("digest", "page_id").alias("o"))
    sample = sample.filter(sampled(F.col("o"), SAMPLE_RECORDS, n)).orderBy("o", "page_id").limit(SAMPLE_RECORDS).collect()
    samples = [page_record(r["page_id"], r["url"], r["piece"].encode(), r["digest"], len(r["piece"].encode()), "response", None) for r in sample]
    folder = folder or scratch(spark, "archives")
    written = decided.mapInArrow(_write_batches(folder, train(samples), level, archive_bytes), "path string, records long, bytes long")
    manifest = materialise(written, "manifest")
    release(narrow, revisits, seem)
    return manifest


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to [, payload: null for a revisit]."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    tasks = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(tasks).mapInArrow(_read_batches(with_payload), schema)
