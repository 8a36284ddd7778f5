"""Deterministic sharded WARC writer and reader (operator 3).

Records are in order of page_id, rows of one id in order of their payload's digest.
Shards are cut where the running sum of bytes in that order reaches the size of a shard,
so they depend on the data alone, and no distribution of ids makes one larger than that.
One shuffle brings each shard's pages together, with the decision which payloads are
revisits riding along as small rows of the same key. A task writes a shard's records as
gzip members and rolls to the next file when the compressed size is reached. Files are
written under temporary names of their own attempt; a later job gives the files of
successful attempts their final names and checks them, and the manifest, itself a table
with a commit marker, is written last. Readers take files from the manifest only and
check each against its digest there.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachspark.operators.common import running

from .common import Scratch, delete

#: Uncompressed bytes of a shard, and compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 16 << 20
#: Shards grow beyond SHARD_BYTES where there would be more of them: their first keys (17 bytes each) are broadcast.
MOST_SHARDS = 100_000
_DATE = "2024-01-01T00:00:00Z"  # records carry no time of their own
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(value: str) -> str:
    """A header value on one line: percent signs and line breaks are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record, its headers and digests made anew from the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Target-URI: {_header_text(url or '')}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{refers_to}')}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _open(path: str):
    """The file system of a path (file, hdfs, s3, gs, abfs as Arrow knows them; s3a and s3n are s3) and the path in it."""
    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = "s3://" + path.removeprefix(scheme)
    return pyarrow.fs.FileSystem.from_uri(path)


def _payload():
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


#: Tells payloads under one id apart: 60 bits of their SHA-1.
_TIE = "cast(conv(substring(digest, 1, 15), 16, 10) as long)"


def identities(pages: DataFrame) -> DataFrame:
    """(page_id, digest, tie, size): each page's id and payload, by SHA-1 in hex; a null page is a payload of no bytes."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(_payload().cast("binary")).alias("digest"), F.octet_length(_payload()).alias("size")).select("page_id", "digest", F.expr(_TIE).alias("tie"), "size")


def revisits(ids: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, tie, digest, refers_to): pages whose payload a page with a larger id has too; a null id is never referred to."""
    ids = ids.filter(F.col("size") >= least_bytes)
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return ids.join(last, "digest").filter("page_id != refers_to").select("page_id", "tie", "digest", "refers_to").distinct()


def _key(none: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Keys of 17 bytes whose order is that of (page_id, tie), null ids first."""
    out = np.empty((len(ids), 17), dtype=np.uint8)
    out[:, 0] = np.where(none, 1, 2)
    out[:, 1:9] = (np.where(none, 0, ids).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = ties.astype(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _shards(scratch: Scratch, ids: DataFrame, shard_bytes: int):
    """A function of (page_id, tie) that gives the shards a key lies in, first and last, and how many shards there are.

    Rows of one key, which have one id and one payload, can fill more than one shard.
    """
    total = ids.agg(F.sum(F.col("size") + 512)).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))
    placed = running(ids.select("page_id", "tie", (F.col("size") + 512).cast("long").alias("bytes")), [], ["page_id", "tie"], "bytes")
    placed = placed.withColumn("shard", F.expr(f"(_upto - bytes) div {shard_bytes}"))
    first = placed.groupBy("shard").agg(F.min(F.struct(F.isnotnull("page_id").alias("known"), "page_id", "tie")).alias("k")).select("shard", "k.*").orderBy("shard").toPandas()
    none = ~first["known"].to_numpy(dtype=bool)
    keys = scratch.spark.sparkContext.broadcast(_key(none, first["page_id"].fillna(0).to_numpy(dtype=np.int64), first["tie"].to_numpy(dtype=np.int64)))

    @F.pandas_udf("low int, high int")
    def shard(page_id: pd.Series, tie: pd.Series) -> pd.DataFrame:
        key = _key(page_id.isna().to_numpy(), page_id.fillna(0).to_numpy(dtype=np.int64), tie.to_numpy(dtype=np.int64))
        before, after = np.searchsorted(keys.value, key, side="left"), np.searchsorted(keys.value, key, side="right")
        return pd.DataFrame({"low": np.where(before == after, after - 1, before).astype(np.int32), "high": (after - 1).astype(np.int32)})

    return shard, max(1, len(first))


def write(pages: DataFrame, path: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``; the manifest (file, bytes, records, sha256)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-attempts")
    ids = scratch.save(identities(pages), "ids")
    shard, count = _shards(scratch, ids, shard_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(_payload().cast("binary")).alias("digest"))
    rows = rows.withColumn("tie", F.expr(_TIE)).withColumn("at", shard("page_id", "tie"))
    # equal rows that fill several shards are dealt out over them
    rows = rows.select((F.col("at.low") + F.floor(F.rand(7) * (F.col("at.high") - F.col("at.low") + 1))).cast("int").alias("shard"), "page_id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html", "digest", "tie")
    known = revisits(ids, least_bytes).withColumn("at", shard("page_id", "tie")).select(F.explode(F.sequence("at.low", "at.high")).alias("shard"), "page_id", "tie", "digest", "refers_to")
    known = known.select("shard", "page_id", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "tie")
    both = rows.unionByName(known)

    def run(batches):
        attempt = uuid.uuid4().hex[:12]
        shard, seq, sink, size, records, sha = None, 0, None, 0, 0, None
        targets, target_id = {}, None  # of the payloads under one id, by digest

        def close():
            nonlocal sink
            sink.close()
            sink = None
            return (f"part-{shard:06d}-{seq:04d}.warc.gz", f"_temporary/{attempt}/part-{shard:06d}-{seq:04d}.warc.gz", size, records, sha.hexdigest())

        def batch_of(rows):
            return pa.RecordBatch.from_pydict(dict(zip(("file", "temporary", "bytes", "records", "sha256"), map(list, zip(*rows, strict=True)), strict=True)))

        for batch in batches:
            done = []
            for s, page, kind, refers, url, html, digest in zip(*(batch[i] for i in range(7)), strict=True):
                s, page = s.as_py(), page.as_py()
                if kind.as_py() == 0:
                    if page != target_id:
                        targets, target_id = {}, page
                    targets[bytes.fromhex(digest.as_py())] = refers.as_py()
                    continue
                if sink is not None and (s != shard or size >= roll_bytes):
                    done.append(close())
                    seq = seq + 1 if s == shard else 0
                if s != shard:
                    shard, seq = s, 0
                if sink is None:
                    fs, base = _open(path)
                    fs.create_dir(f"{base}/_temporary/{attempt}", recursive=True)
                    sink = fs.open_output_stream(f"{base}/_temporary/{attempt}/part-{shard:06d}-{seq:04d}.warc.gz", compression=None)
                    size, records, sha = 0, 0, hashlib.sha256()
                text = html.as_py()
                payload = b"" if text is None else text.encode()
                target = targets.get(hashlib.sha1(payload).digest()) if page == target_id and page is not None and targets else None
                member = _member(record(page, url.as_py(), payload, target))
                sink.write(member)
                sha.update(member)
                size, records = size + len(member), records + 1
            if done:
                yield batch_of(done)
        if sink is not None:
            yield batch_of([close()])

    dealt = both.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "tie", "url").drop("tie")
    written = scratch.save(dealt.mapInArrow(run, "file string, temporary string, bytes long, records long, sha256 string"), "written")

    def commit(batches):
        fs, base = _open(path)
        for batch in batches:
            for name, temporary, size in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                if fs.get_file_info(f"{base}/{temporary}").type != pyarrow.fs.FileType.NotFound:
                    fs.move(f"{base}/{temporary}", f"{base}/{name}")
                found = fs.get_file_info(f"{base}/{name}")
                if found.size != size:
                    raise OSError(f"{name} has {found.size} bytes, {size} were written")
            yield batch.select(["file", "bytes", "records", "sha256"])

    written.mapInArrow(commit, "file string, bytes long, records long, sha256 string").write.parquet(f"{path}/manifest")
    delete(spark, f"{path}/_temporary")  # what failed attempts left
    scratch.drop("ids", "written")
    return spark.read.schema("file string, bytes long, records long, sha256 string").parquet(f"{path}/manifest")


def _records(stream, sha) -> Iterator[bytes]:
    """The gzip members of a file, one at a time; ``sha`` takes in the bytes of the file."""
    unpack, out, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(1 << 20)
            sha.update(data)
        if not data:
            if out:
                raise EOFError("a record breaks off")
            return
        out.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            data = unpack.unused_data
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []


def _parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + sha1_base32(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["WARC-Page-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To-Page-ID")),
        "url": fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


_COLUMNS = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "url": "string", "payload": "binary"}


def read(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the files in the manifest, each file's digests checked; ``payload`` only if it is asked for."""
    columns = columns or list(_COLUMNS)
    manifest = spark.read.schema("file string, bytes long, records long, sha256 string").parquet(f"{path}/manifest")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[_COLUMNS[c]]) for c in columns])

    def run(batches):
        fs, base = _open(path)
        for batch in batches:
            for name, records, digest in zip(*(batch[i].to_pylist() for i in range(3)), strict=True):
                rows, size, n, sha = [], 0, 0, hashlib.sha256()
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in _records(stream, sha):
                        one = _parsed(data)
                        rows.append({c: one[c] for c in columns})
                        size, n = size + len(data), n + 1
                        if len(rows) == 1000 or size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if n != records or sha.hexdigest() != digest:
                    raise ValueError(f"{name} is not the file of the manifest: {n} of {records} records, sha256 {sha.hexdigest()}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("file", "records", "sha256").repartition(max(1, manifest.count())).mapInArrow(run, ", ".join(f"{c} {_COLUMNS[c]}" for c in columns))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; a null id sorts first; rows with one id are records of their own.

    An empty table gives no files and no rows; a very long page is a record, and a shard, of its own. Pages with equal payloads revisit the one of them with the largest id; rows that share
    that id are all responses. Columns other than page_id, url and html are not written.
    """
    path = Scratch(spark, "warc").path
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


OP3_SQL = """
with page as (
  select page_id, strlen(coalesce(html, '')) as size, sha1(coalesce(html, '')) as digest from pages
), last as (
  select digest, max(page_id) as keeper from page group by digest
), part as (
  select *, list_transform(generate_series(0, 7), lambda g: cast('0x' || substr(digest, g * 5 + 1, 5) as bigint)) as v from page
)
select page_id, cast(size as bigint) as payload_bytes,
  array_to_string(list_transform(v, lambda x: substr(abc, (x >> 15) % 32 + 1, 1) || substr(abc, (x >> 10) % 32 + 1, 1) || substr(abc, (x >> 5) % 32 + 1, 1) || substr(abc, x % 32 + 1, 1)), '') as payload_digest,
  case when page_id = keeper or keeper is null or page_id is null then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
from part join last using (digest), (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as abc)
"""
