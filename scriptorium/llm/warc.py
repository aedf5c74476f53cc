"""Web archives (WARC 1.1, ISO 28500:2017): a deterministic sharded writer, and a reader.

Records are sorted by page_id and payload and cut into shards of about equal payload. The bounds of shards come from a
sample of keys by hash, so the same rows give the same files, however they were partitioned. A task writes a shard's records, each as a
gzip member, and begins a new file when the one it writes has reached its size, compressed. Headers, record ids and digests are made
from the rows alone.

Files are written under temporary names, one folder for each attempt of a task, so a lost executor leaves no half file behind. The rows
of a written table tell which attempts count; their files are renamed by tasks. The rename of the manifest, which names all files with
their sizes and digests, is the commit; readers see what a manifest names only.

A payload that was written before is not written again: its record is a revisit that names the first one. Texts are shuffled once, by
shard; which rows are copies travels beside them, as rows of the same shards.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import storage
from scriptorium.functions.cuts import cut, keep, scratch
from scriptorium.llm.batches import text_slices
from scriptorium.llm.graphs import small

#: Least bytes of payload of a shard, most shards (beyond, shards are larger), and keys that are sampled for each bound.
SHARD_BYTES, MOST_SHARDS, SAMPLED = 8 << 20, 1 << 16, 32
#: Compressed bytes at which a file is closed, and bytes of rows that the reader passes on at once.
ROLL_BYTES, BATCH = 1 << 30, 4 << 20
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, shard int, records long, bytes long, sha256 string"


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None, sha: str, number: int) -> str:
    """A name that depends on the page, its payload and the number among equal rows only."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha} {number}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _File:
    """One archive that is being written."""

    root: str
    name: str
    level: int
    date: str
    sha: object = field(default_factory=hashlib.sha256)
    size: int = 0
    records: int = 0

    def __post_init__(self):
        self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}/{self.name}"
        store, path = storage.opened(self.temporary)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        info = f"software: scriptorium\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, 0)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def _write(self, record: bytes) -> None:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def page(self, page_id: int | None, url: str | None, payload: bytes, sha: str, number: int, first: int | None) -> None:
        """A response, or a revisit of the page ``first``."""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = http + payload if first is None else http
        headers = [
            ("WARC-Type", "response" if first is None else "revisit"),
            ("WARC-Record-ID", record_id(page_id, sha, number)),
            ("WARC-Date", self.date),
            ("WARC-Target-URI", _uri(url, page_id)),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
            ("WARC-Block-Digest", f"sha1:{digest(block)}"),
            ("Content-Type", "application/http;msgtype=response"),
        ]
        if page_id is not None:
            headers.append(("Page-Id", str(page_id)))
        if first is not None:
            headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, sha, 0)), ("Refers-To-Page-Id", str(first))]
        self._write(_record(headers, block))
        self.records += 1

    def close(self, shard: int) -> tuple:
        self.out.close()
        return self.temporary, self.name, shard, self.records, self.size, self.sha.hexdigest()


def order_keys(page_ids: pa.Array, shas: pa.Array) -> np.ndarray:
    """Fixed-width keys whose order is that of page_id, nulls last, then of the payload's hash."""
    out = np.zeros((len(page_ids), 17), np.uint8)
    out[:, 0] = page_ids.is_null().to_numpy(zero_copy_only=False)
    ids = page_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1:9] = ids.astype(">u8").view(np.uint8).reshape(-1, 8)
    heads = b"".join(bytes.fromhex(x[:16]) for x in shas.to_pylist())
    out[:, 9:] = np.frombuffer(heads, np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def shard_bounds(keys: np.ndarray, sizes: np.ndarray, total: int, share: int, most: int = MOST_SHARDS) -> np.ndarray:
    """Keys at which shards begin, but the first: the sample's bytes in order, cut into equal parts."""
    shards = min(most, max(1, -(-total // max(1, share))))
    order = np.argsort(keys, kind="stable")
    sums = np.cumsum(sizes[order])
    if shards == 1 or not len(sums) or not sums[-1]:
        return keys[:0]
    at = np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards)
    return np.unique(keys[order][np.minimum(at, len(sums) - 1)])


def write_archive(pages: DataFrame, root: str, prefix: str = "pages", date: str = "1970-01-01T00:00:00Z", least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html; other columns are ignored) and returns the manifest: MANIFEST.

    root must not hold a manifest. The payload is the html in UTF-8, empty for a null. Of rows with equal payloads of at least
    ``least`` bytes the one with the smallest page_id is a response, the others are revisits of it; of rows that are equal in page_id too the
    first by url is. A row without page_id can be a revisit, but is never one's target: where no row of a payload has a
    page_id, all are responses. A null url is named after the page. An empty table gives a manifest without rows.
    """
    spark = pages.sparkSession
    root = storage.qualified(spark, root)
    if storage.exists(spark, f"{root}/manifest"):
        raise FileExistsError(f"{root} holds an archive")
    with scratch(spark):
        written = cut(_written(pages, root, prefix, date, least, shard_bytes, roll_bytes, level), "written")

        def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                    (store, path), (_, target) = storage.opened(temporary), storage.opened(f"{root}/{name}")
                    if store.get_file_info(path).is_file:  # else an earlier attempt did it
                        store.move(path, target)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("name", "shard", "records", "bytes", "sha256")], ["name", "shard", "records", "bytes", "sha256"])

        draft = f"{root}/manifest-{uuid.uuid4().hex}"
        written.mapInArrow(renamed, MANIFEST).sortWithinPartitions("name").write.json(draft)
        storage.rename_new(spark, draft, f"{root}/manifest")
        storage.delete(spark, f"{root}/_temporary")
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def _written(pages: DataFrame, root: str, prefix: str, date: str, least: int, shard_bytes: int, roll_bytes: int, level: int) -> DataFrame:
    """Writes the files under temporary names; a row for each."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    keyed = cut(rows.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("long").alias("size")), "keys")
    own = keyed.groupBy("page_id", "sha").agg(F.first("size").alias("size"), F.count("*").alias("n"))
    own = cut(own, "payloads")
    firsts = cut(own.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.first("size").alias("size")).filter((F.col("n") > 1) & (F.col("size") >= least)).select("sha", "first"), "copied")
    copies = own.join(small(firsts), "sha").filter("first is not null and (page_id is null or page_id <> first)").select("page_id", "sha", "first")
    # a sample of keys by their hash; few enough for the driver, and the same at each run
    count, total = own.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    share = min(1.0, SAMPLED * shards / max(1, count))
    sampled = own.filter(F.shiftrightunsigned(F.xxhash64("page_id", "sha"), 11) <= F.lit(int(share * (1 << 53)))).select("page_id", "sha", (F.col("size") * F.col("n")).alias("bytes")).toArrow().combine_chunks()
    bounds = np.zeros(0, "S17")
    if shards > 1 and len(sampled):
        bounds = shard_bounds(order_keys(sampled.column(0).combine_chunks(), sampled.column(1).combine_chunks()), sampled.column(2).to_numpy(), total, shard_bytes)

    # ids go as text, as pandas has no integers with nulls
    @F.pandas_udf("int")
    def shard_of(ids, shas):
        keys = order_keys(pa.array(ids, pa.string(), from_pandas=True).cast(pa.int64()), pa.array(shas, pa.string()))
        return type(ids)(np.searchsorted(bounds, keys, side="right").astype(np.int32))

    texts = rows.withColumn("sha", F.sha2("html", 256)).select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first"))
    marks = copies.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    dealt = texts.unionByName(marks).withColumn("shard", shard_of(F.col("page_id").cast("string"), F.col("sha"))).repartitionById(len(bounds) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "sha", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, shard, part, key, number, first = None, -1, 0, None, 0, None
        done: list[tuple] = []
        for batch in text_slices(batches, "html"):
            for page_id, sha, kind, url, html, mark, own in zip(*(batch.column(c).to_pylist() for c in ("page_id", "sha", "kind", "url", "html", "first", "shard")), strict=True):
                if (page_id, sha) != key:
                    key, number, first = (page_id, sha), 0, None
                if kind == 0:
                    first = mark
                    continue
                if file and (own != shard or file.size >= roll_bytes):
                    done.append(file.close(shard))
                    file = None
                if own != shard:
                    shard, part = own, 0
                if file is None:
                    file, part = _File(root, f"{prefix}-{shard:05d}-{part:05d}.warc.gz", level, date), part + 1
                data = (html or "").encode()
                again = page_id if number and page_id is not None and len(data) >= least else None
                file.page(page_id, url, data, sha, number, first if first is not None else again)
                number += 1
        if file:
            done.append(file.close(shard))
        if done:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["temporary", "name", "shard", "records", "bytes", "sha256"])

    return dealt.mapInArrow(run, f"temporary string, {MANIFEST}")


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC stream, gzipped or plain: headers by name in lower case, and the block."""
    data = io.BufferedReader(stream, 1 << 20)
    source = gzip.GzipFile(fileobj=data) if data.peek(2)[:2] == b"\x1f\x8b" else data
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers, last = {}, ""
        while (raw := source.readline()) not in (b"\r\n", b"\n"):
            line = raw.rstrip(b"\r\n")
            if not raw:
                raise ValueError("a record is cut off")
            if line[:1] in b" \t" and last:  # a folded line
                headers[last] += " " + line.decode(errors="replace").strip()
                continue
            name, _, value = line.decode(errors="replace").partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        size = int(headers["content-length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield headers, block


def _payload(block: bytes) -> tuple[bytes, int | None]:
    """What stands below the HTTP headers, and the length that they give."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return block, None
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return body, int(value)
    return body, None


READ = "file string, number long, record_type string, record_id string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to long"


def read_archive(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """The response and revisit records of the files that the manifest of root names: READ, with payloads also payload (binary, null for revisits).

    Digests of blocks and payloads are computed anew; a record that differs from its headers fails the job, and so does a file that is cut
    off. payload_bytes and payload_digest are of the full payload, for revisits too.
    """
    root = storage.qualified(spark, root)
    schema = READ + ", payload binary" * payloads
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(name: str) -> Iterator[tuple]:
        store, path = storage.opened(f"{root}/{name}")
        with store.open_input_stream(path, compression=None) as stream:
            for number, (headers, block) in enumerate(records(stream)):
                kind = headers.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                body, length = _payload(block)
                stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                if f"sha1:{digest(block)}" != headers.get("warc-block-digest", f"sha1:{digest(block)}") or (kind == "response" and stated not in ("", digest(body))):
                    raise ValueError(f"record {number} of {name} differs from its digests")
                number_of = lambda h: int(headers[h]) if h in headers else None  # noqa: B023, E731
                size = len(body) if kind == "response" else length
                row = (name, number, kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), number_of("page-id"), size, stated or digest(body), number_of("refers-to-page-id"))
                yield (*row, body if kind == "response" else None) if payloads else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(name):
                    held.append(row)
                    size += 200 + (len(row[-1] or b"") if payloads else 0)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    files = manifest(spark, root).select("name", "shard")
    return files.repartitionById(max(1, min(MOST_SHARDS, files.agg(F.max("shard") + 1).first()[0] or 1)), F.col("shard")).select("name").mapInArrow(run, schema)


def archived(pages: DataFrame, root: str, **settings) -> DataFrame:
    """Writes pages as archives under root, reads those back, and gives a row for each record: page_id, payload_bytes, payload_digest,
    record_type, refers_to. As ``write_archive``."""
    write_archive(pages, root, **settings)
    return keep(read_archive(pages.sparkSession, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
