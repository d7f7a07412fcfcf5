"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by page id and cut into shards after every so many rows, by exact counts, so where a shard
begins depends on the rows alone. Payload digests group the pages; the smallest page id of equal payloads is the
response, the others are revisits that refer to it. Payloads are equal when their SHA-256 and length are. Each record is
a gzip member of its own with regenerated headers and digests, and a file is closed once its compressed size passes
``roll_bytes``. A task writes under temporary names of its own attempt, moves finished files to their final names and
then, last of all, its shard's manifest, by one rename; a task that is run again puts the same bytes in the same place.
When all shards are there, the driver writes one manifest that names them: an archive without it is not read, and a root
that has one is not written to. Files live in the shared folder, through the file system that its path names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, early_cleanup, new_scratch, small_batches

ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
#: Base name spaces of record ids; any fixed value serves.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LEVEL = 1
#: Payload bytes of a shard: a thousandth of all, between these bounds.
LEAST_SHARD, MOST_SHARD = 4 << 20, 1 << 30
#: Payload bytes of a batch of records read.
READ_BYTES = 8 << 20
#: Tasks that read archives; more files than that share tasks.
MOST_READERS = 20_000
COMPLETE = "manifest/complete.json"
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def _uri(url: str | None, page_id) -> str:
    """The target URI on one header line: what cannot stand there is percent-encoded."""
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(r"[\x00-\x20\x7f-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url)


def record(page_id, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, a response with its HTTP head or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member with no name and time zero, so equal records are equal bytes."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _move(fs, temp: str, final: str) -> None:
    """Renames; where the store does not rename over a file that an earlier attempt left, that file goes first."""
    try:
        fs.move(temp, final)
    except OSError:
        fs.delete_file(final)
        fs.move(temp, final)


class _Roller:
    """Writes members to a temporary file and moves it into place when it is full."""

    def __init__(self, root: str, shard: int, attempt: int, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.files, self.out = [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.root}/_temporary/{self.shard:06d}-{len(self.files):04d}-{self.attempt}"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha1()
        member = _member(data)
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.roll()

    def roll(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{len(self.files):04d}.warc.gz"
            _move(self.fs, self.temp, f"{self.root}/{name}")
            self.files.append({"name": name, "bytes": self.size, "records": self.records, "sha1": self.sum.hexdigest()})
            self.out = None

    def commit(self) -> tuple[int, int, int]:
        """Moves the last file and the manifest into place; the shard, its files and its records."""
        self.roll()
        _put(self.fs, self.root, _shard_name(self.shard), "".join(json.dumps(x) + "\n" for x in self.files), str(self.attempt))
        return self.shard, len(self.files), sum(x["records"] for x in self.files)


def _shard_name(shard: int) -> str:
    return f"manifest/shard-{shard:06d}.json"


def _put(fs, root: str, name: str, text: str, attempt: str) -> None:
    temp = f"{root}/_temporary/{name.replace('/', '-')}-{attempt}"
    with fs.open_output_stream(temp) as f:
        f.write(text.encode())
    _move(fs, temp, f"{root}/{name}")


def _cuts(ids: DataFrame, rows_per_shard: int) -> np.ndarray:
    """The ids ``o`` at every ``rows_per_shard``-th place of their order: exact, as partitions only serve to count."""
    at = F.monotonically_increasing_id()
    laid = ids.repartitionByRange("o").sortWithinPartitions("o")
    places = Scratch(laid.select("o", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")), "places")
    total, starts = 0, []
    for part, n in sorted(map(tuple, places.df.groupBy("part").count().collect())):
        starts.append((part, total))
        total += n
    if total <= rows_per_shard:
        return np.empty(0, np.int64)
    offset = F.broadcast(ids.sparkSession.createDataFrame(starts, "part long, start long"))
    place = F.col("start") + F.col("place")
    found = places.df.join(offset, "part").where((place > 0) & (place % rows_per_shard == 0)).select("o").toPandas()["o"]
    places.drop()
    return np.sort(found.to_numpy(np.int64))


def write(pages: DataFrame, root: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None) -> None:
    """Writes ``pages(page_id, url, html)`` as WARC files and manifests below ``root``, a shared folder's URI.

    A null html is an empty payload; of equal payloads with at least ``min_bytes`` bytes the smallest page id is the
    response. A row that repeats a page id with the same payload is a revisit to it only if another id is smaller; it
    is else a response again. A row without page id is a response of its own, before all others. Rows of one id go by
    digest, then url; where an id has rows for several shards, its digests are dealt to them. Only the three columns are
    read, so others cannot clash. No rows give a complete archive without files. FileExistsError if there is one already.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    fs, path = pafs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{path}/{COMPLETE}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{root} holds a complete archive")
    for d in ("", "/_temporary", "/manifest"):
        fs.create_dir(path + d)

    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("o", F.coalesce("page_id", F.lit(-(1 << 63)))).withColumn("size", F.octet_length("html")).withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    slim = Scratch(base.select("page_id", "o", "size", "sha"), "payloads")
    rows, total = slim.df.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shard_bytes = shard_bytes or min(max(total // 1000, LEAST_SHARD), MOST_SHARD)
    cuts = _cuts(slim.df.select("o"), max(1, rows * shard_bytes // max(1, total)))

    @F.pandas_udf("int")
    def shard_of(o: pd.Series, digest_hash: pd.Series) -> pd.Series:
        low, high = np.searchsorted(cuts, o, "left"), np.searchsorted(cuts, o, "right")
        return pd.Series(np.where(high - low > 1, low + digest_hash % (high - low + 1), high).astype(np.int32))

    keys = slim.df.where(F.col("size") >= min_bytes)
    firsts = keys.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "size", "first")
    again = keys.join(firsts, ["sha", "size"]).where("page_id > first").select("page_id", "o", "sha", "size", "first").distinct()
    # What a page refers to travels to the page's own shard in the same shuffle, ahead of it.
    notes = again.select("page_id", "o", "sha", "size", F.lit(0).alias("kind"), F.col("first").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    both = notes.unionByName(base.select("page_id", "o", "sha", "size", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html"))
    laid = both.withColumn("shard", shard_of("o", F.pmod(F.xxhash64("sha"), F.lit(1 << 30)))) if len(cuts) else both.withColumn("shard", F.lit(0))
    laid = laid.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "o", "sha", "size", "kind", "url")

    def work(batches):
        attempt, out, done = TaskContext.get().taskAttemptId(), None, []
        page, refers = (), {}
        for b in batches:
            for shard, page_id, sha, size, kind, refers_to, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None or out.shard != shard:
                    done += [out.commit()] if out else []
                    out = _Roller(root, shard, attempt, roll_bytes)
                if (page_id,) != page:
                    page, refers = (page_id,), {}
                if kind == 0:
                    refers[sha, size] = refers_to
                else:
                    out.add(record(page_id, url, html.encode(), refers.get((sha, size))))
        done += [out.commit()] if out else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(3)], ["shard", "files", "records"])

    with early_cleanup(spark):
        done = laid.select("shard", "page_id", "sha", "size", "kind", "refers_to", "url", "html").mapInArrow(work, "shard long, files long, records long").collect()
    slim.drop()
    written = {"shards": sorted(r["shard"] for r in done), "files": sum(r["files"] for r in done), "records": sum(r["records"] for r in done)}
    if written["records"] != rows:
        raise RuntimeError(f"{written['records']} records written of {rows} rows")
    _put(fs, path, COMPLETE, json.dumps(written), "driver")


def records(stream):
    """Yields ``(headers, block)`` of a WARC stream, checking the block's digest."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha1:{digest(block)}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"a damaged record: {headers.get('WARC-Record-ID')}")
        yield headers, block


def read(spark: SparkSession, root: str) -> DataFrame:
    """The records of a complete archive: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, html``
    (html null for a revisit). FileNotFoundError where the manifest of the whole or of a shard is missing; files that no
    manifest names are not read; damaged files and records raise."""
    schema = "name string, bytes long, records long, sha1 string"
    fs, path = pafs.FileSystem.from_uri(root)
    if fs.get_file_info(f"{path}/{COMPLETE}").type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{root} holds no complete archive")
    with fs.open_input_stream(f"{path}/{COMPLETE}") as f:
        whole = json.loads(f.read())
    there = {x.base_name for x in fs.get_file_info(pafs.FileSelector(f"{path}/manifest"))}
    wanted = [_shard_name(k) for k in whole["shards"]]
    if lost := [n for n in wanted if n.rpartition("/")[2] not in there]:
        raise FileNotFoundError(f"{root} has lost {len(lost)} shards, {lost[0]} first")
    if not wanted:
        return spark.createDataFrame([], f"{OUT}, url string, html string")
    listed = spark.read.schema(schema).json([f"{root}/{n}" for n in wanted])
    files, held = listed.agg(F.count("*"), F.sum("records")).first()
    if (files, held) != (whole["files"], whole["records"]):
        raise ValueError(f"{root}: {files} files and {held} records listed, {whole['files']} and {whole['records']} written")

    def work(batches):
        fs, path = pafs.FileSystem.from_uri(root)
        for b in batches:
            for f in b.to_pylist():
                rows, n, held = [], 0, 0
                with fs.open_input_stream(f"{path}/{f['name']}", compression=None) as raw, gzip.open(raw) as unpacked:
                    for h, block in records(io.BufferedReader(unpacked, 1 << 20)):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        if h["WARC-Type"] == "response" and (len(payload) != size or f"sha1:{digest(payload)}" != h["WARC-Payload-Digest"]):
                            raise ValueError(f"a damaged payload: {h['WARC-Record-ID']}")
                        to = h.get("WARC-Refers-To-Page-ID")
                        rows.append((int(h["WARC-Page-ID"]) if h["WARC-Page-ID"] else None, size, h["WARC-Payload-Digest"][5:], h["WARC-Type"], int(to) if to else None, h["WARC-Target-URI"], payload.decode() if to is None else None))
                        n += 1
                        held += len(block)
                        if held >= READ_BYTES or len(rows) == 5000:
                            yield _batch(rows)
                            rows, held = [], 0
                if n != f["records"]:
                    raise ValueError(f"{f['name']}: {n} records, {f['records']} in the manifest")
                if rows:
                    yield _batch(rows)

    # A task for each file: by their size in bytes the few rows of the list would all go to one.
    return listed.repartition(max(1, min(files, MOST_READERS))).mapInArrow(work, f"{OUT}, url string, html string")


def _batch(rows):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def round_trip(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes pages to a new place in the shared folder and returns what reading it back gives; as ``write`` says of nulls,
    ties, repeats and empty tables."""
    spark = pages.sparkSession
    root = new_scratch(spark, "warc")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    root = re.sub(r"^file:/+", "file:///", root)
    write(pages, root, min_bytes, roll_bytes)
    return read(spark, root)
