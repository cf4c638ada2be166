"""Deterministic sharded WARC writer and reader.

Records are range-sorted: every ``shard_rows``-th row in the order of ``page_id`` and payload digest begins a shard, so
shards are even however the ids lie, and the same rows give the same shards. A shard is sorted in that order.
Each record is one gzip member with regenerated headers, dates and digests, so the same rows give the same bytes. A
shard rolls to a new file before a record would lift the compressed file over ``roll_bytes``. Tasks write to temporary
names that carry a random part and report them in a manifest table; only files of that manifest are renamed to their
final names, so failed, repeated and speculative attempts leave nothing behind but temporary files, which the commit
removes. The final manifest lists shard, file, records, bytes and SHA-256 of every file.

Equal payloads of at least ``min_revisit`` bytes are written once: the smallest ``page_id`` is the response, the others
are revisit records without payload that name it. Groups are found with SHA-256 by a grouped minimum, never gathered.

Defined cases: a null html is an empty payload; a null url leaves out the target URI; CR, LF and other control
characters of a url are percent-encoded in the header; rows that repeat a page_id are records of their own, and of equal
rows with the smallest id all are responses; null ids go to shards of their own, dealt and sorted by digest, and are never
named by a revisit unless all ids of the group are null; an empty table gives an empty archive; other columns are not
read. Ids stay 64-bit integers throughout, with nulls among them or not.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.arrow import slices
from linkloom.operators.percentiles import places
from linkloom.plans.scratch import materialize, new_path

#: Fixed, so that a rewrite of the same rows gives the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Tasks of the range sort at most; beyond that a task writes several shards, one after another.
MOST_TASKS = 20_000
#: Shards at most; of more rows, a shard takes more.
MOST_SHARDS = 20_000
#: Namespace of the record ids.
NAMESPACE = uuid.UUID("6f1d3a0e-3c9b-5a52-9f0b-8f1f6f0c2d11")
FILE_SCHEMA = "shard bigint, roll int, temporary string, name string, records bigint, bytes bigint, sha256 string"
FILES = pa.schema([("shard", pa.int64()), ("roll", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
RECORD_SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a URI, in a Python worker: local, HDFS and object stores alike."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def gzip_member(data: bytes) -> bytes:
    """One gzip member without name or time; the same bytes for the same data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None) -> bytes:
    """The bytes of one record, up to and with the two closing line ends."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        head.append(f"X-Refers-To-Page: {refers_to}")
    head += [f"X-Page: {'' if page_id is None else page_id}", f"X-Payload-Length: {size}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def payload_keys(pages: DataFrame) -> DataFrame:
    """(page_id, digest, size) of every row, stored: all that planning moves."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return materialize(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size")), "warc-keys")


def plan_revisits(keys: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, digest, first) of every revisit record, from :func:`payload_keys`. Groups are pre-aggregated."""
    rows = keys.where(F.col("size") >= min_revisit).select("page_id", "digest")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    found = rows.join(firsts, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    return found.select("page_id", "digest", "first").distinct()


def _table(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _write_shards(root: str, roll_bytes: int):
    names = ("page_id", "url", "html", "digest", "first", "written", "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_fs(root)
        store.create_dir(base, recursive=True)
        attempt, out, rows, last, roll, mark = uuid.uuid4().hex, None, [], None, 0, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                rows[-1][6] = rows[-1][6].hexdigest()
                out = None

        for part in (p for batch in batches for p in slices(batch, "html")):
            for page, url, page_html, digest, first, written, shard in zip(*[part.column(n).to_pylist() for n in names], strict=True):
                if not written:
                    mark = (page, digest, first)
                    continue
                payload = page_html.encode()
                again = mark is not None and mark[:2] == (page, digest)
                kind, refers = ("revisit", mark[2]) if again else ("response", None)
                data = gzip_member(build_record(page, url, payload, digest, len(payload), kind, refers))
                if shard != last:
                    close()
                    last, roll = shard, 0
                elif out is not None and rows[-1][5] + len(data) > roll_bytes:
                    close()
                    roll += 1
                if out is None:
                    name = f"shard-{shard:012d}-{roll:05d}.warc.gz" if shard >= 0 else f"shard-null{-shard:08d}-{roll:05d}.warc.gz"
                    temporary = f".{name}.{attempt}.tmp"
                    out = store.open_output_stream(f"{base}/{temporary}", compression=None)
                    rows.append([shard, roll, temporary, name, 0, 0, hashlib.sha256()])
                out.write(data)
                rows[-1][4] += 1
                rows[-1][5] += len(data)
                rows[-1][6].update(data)
        close()
        yield _table(rows, FILES)

    return write


def _commit_files(root: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_fs(root)
        for batch in batches:
            for r in batch.to_pylist():
                if store.get_file_info(f"{base}/{r['temporary']}").type == pafs.FileType.File:
                    store.move(f"{base}/{r['temporary']}", f"{base}/{r['name']}")
                done = store.get_file_info(f"{base}/{r['name']}")  # a repeated task finds the file already renamed
                if done.type != pafs.FileType.File or done.size != r["bytes"]:
                    raise OSError(f"{r['name']} is missing or incomplete")
            yield batch

    return commit


def _shard_of(keys: DataFrame, shard_rows: int) -> tuple[Column, Column, int]:
    """The shard of a row as a column of page_id and digest, its place among all shards, and their number.

    Rows are placed exactly, from ids and digests alone; the first row of every shard, at most ``MOST_SHARDS``, goes to the
    tasks. Rows without an id have shards behind the others, dealt by digest.
    """
    seen = keys.agg(F.count("page_id").alias("n"), F.count("*").alias("all")).first()
    nulls = -(-(seen["all"] - seen["n"]) // shard_rows)
    size = max(shard_rows, -(-seen["n"] // MOST_SHARDS))
    placed = places(keys.where("page_id is not null").select("page_id", "digest"), [F.col("page_id"), F.col("digest")])
    bounds = placed.where((F.col("place") - 1) % size == 0).orderBy("place").select("page_id", "digest").toArrow()
    ids, digests = bounds["page_id"].to_numpy(), bounds["digest"].to_pylist()

    def find(page: pa.Array, digest: pa.Array) -> pa.Array:
        own = page.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(high > low):  # shards that begin within one id
            high[i] = bisect_right(digests, digest[i].as_py(), low[i], high[i])
        return pa.array(np.maximum(high, 1) - 1, mask=page.is_null().to_numpy(zero_copy_only=False), type=pa.int64())

    shard = F.coalesce(F.arrow_udf(find, "bigint")("page_id", "digest"), -1 - F.pmod(F.xxhash64("digest"), F.lit(max(1, nulls))))
    return shard, F.when(F.col("shard") >= 0, F.col("shard")).otherwise(len(ids) - 1 - F.col("shard")), len(ids) + nulls


def write_archives(pages: DataFrame, root: str, shard_rows: int = 2000, roll_bytes: int = 32 << 20, min_revisit: int = 100) -> DataFrame:
    """Writes ``pages`` below ``root`` and returns the committed manifest (also stored there as ``manifest``).

    A task holds one slice of a batch and one open file. Every shard is a task of its own, up to ``MOST_TASKS``.
    """
    spark, keys = pages.sparkSession, payload_keys(pages)
    shard, place, shards = _shard_of(keys, shard_rows)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.lit(None).cast("long").alias("first"), F.lit(True).alias("written"))
    # A mark sorts right before the page that it turns into a revisit, so the texts move once, for the range sort.
    marks = plan_revisits(keys, min_revisit).select("page_id", F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), "digest", "first", F.lit(False).alias("written"))
    tasks = min(MOST_TASKS, max(1, shards))
    dealt = rows.unionByName(marks).withColumn("shard", shard)
    dealt = dealt.repartitionById(tasks, F.call_function("div", place * tasks, F.lit(max(1, shards))).cast("int"))
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "written", "url")
    written = materialize(dealt.mapInArrow(_write_shards(root, roll_bytes), FILE_SCHEMA), "warc-written")
    committed = written.repartition(min(tasks, MOST_TASKS), "name").mapInArrow(_commit_files(root), FILE_SCHEMA).drop("temporary")
    path = f"{root}/manifest"
    committed.write.mode("overwrite").parquet(path)
    _sweep(spark, root)
    return spark.read.schema(committed.schema).parquet(path)


def _sweep(spark: SparkSession, root: str) -> None:
    """Removes temporary files that no committed attempt owns."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.*.tmp")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.globStatus(where) or []:
        store.delete(status.getPath(), False)


def parse_members(stream) -> Iterator[bytes]:
    """The records of a gzip file, one member at a time, from reads of 1 MiB."""
    packer, parts, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        parts.append(packer.decompress(data))
        if packer.eof:
            yield b"".join(parts)
            data, packer, parts = packer.unused_data, zlib.decompressobj(31), []
            data = data or stream.read(1 << 20)
        else:
            data = stream.read(1 << 20)
    if any(parts):
        raise ValueError("the file ends within a record")


def parse_record(data: bytes) -> tuple:
    """Fields of RECORD_SCHEMA from one record; raises where a length or a digest does not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if not lines[0].startswith("WARC/") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("the block digest does not hold")
    payload, digest, kind = block.partition(b"\r\n\r\n")[2], fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    size = int(fields["X-Payload-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload digest does not hold")
    page, first = fields["X-Page"], fields.get("X-Refers-To-Page")
    number = lambda x: None if x in (None, "", "None") else int(x)
    return number(page), fields.get("WARC-Target-URI"), size, digest, kind, number(first), payload if kind == "response" else None


def read_archives(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The records behind a manifest, parsed and checked; a task streams its files and yields small batches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_fs(root)
        for name in (n for batch in batches for n in batch.column("name").to_pylist()):
            rows, held = [], 0
            with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for data in parse_members(stream):
                    row = parse_record(data)
                    rows.append(row if payloads else (*row[:6], None))
                    held += len(data) if payloads else 200
                    if held > 8 << 20:
                        yield _table(rows, RECORDS)
                        rows, held = [], 0
            if rows:
                yield _table(rows, RECORDS)

    tasks = min(MOST_TASKS, max(manifest.count(), 1))
    return manifest.select("name").repartition(tasks, "name").mapInArrow(read, RECORD_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    root = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, root), root, payloads=False).drop("payload")
