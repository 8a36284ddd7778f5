"""Shared helpers: the folder that all executors see, tables that cut lineage,
bitmaps of fixed size and connected components.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap: 16 MB, whatever the input's size.
BITMAP_BITS = 27
_SLICES = 64


#: Folders of sessions without the setting, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="reachspark-")
        root = _LOCAL[app]
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Parquet tables of one run under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: later uses neither recompute nor depend on lost executors."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def crc_bucket(column: str, n: int):
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


class Bitmap:
    """2**bits bits, broadcast as compressed slices; each task unpacks them once."""

    def __init__(self, shared: Broadcast, bits: int):
        self._shared, self._bits, self._value = shared, bits, None

    def __getstate__(self):
        return {"_shared": self._shared, "_bits": self._bits, "_value": None}

    @property
    def value(self) -> np.ndarray:
        if self._value is None:
            out = np.zeros(1 << (self._bits - 3), dtype=np.uint8)
            per = len(out) // _SLICES
            for s, packed in self._shared.value:
                out[s * per : (s + 1) * per] |= np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
            self._value = out
        return self._value

    def destroy(self) -> None:
        """Only once all that reads it is written."""
        self._shared.destroy()


def bitmap(spark: SparkSession, keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> Bitmap:
    """A broadcast bitmap of 2**bits bits (fixed, so bounded) in which bit ``key mod 2**bits`` is set for each key.

    It only saves work: a key that is missing from it is surely not in ``keys``, and what
    it lets through is joined with ``keys`` afterwards. The slices are made by the
    executors; the driver receives at most 2**bits / 8 bytes.
    """
    per = (1 << bits) // _SLICES

    def build(batches):
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(batch[0].to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
            for s in np.unique(at // per):
                one = slices.setdefault(int(s), np.zeros(per, dtype=bool))
                one[at[at // per == s] - s * per] = True
        for s, one in slices.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(one, bitorder="little"), 1)], pa.binary())})

    dealt = keys.select(F.col(column).alias("k")).repartition(F.expr(f"(k & {(1 << bits) - 1}) div {per}"))
    slices = dealt.mapInArrow(build, "slice int, bits binary").collect()
    return Bitmap(spark.sparkContext.broadcast([(row.slice, bytes(row.bits)) for row in slices]), bits)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(scratch: Scratch, links: DataFrame, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a long, b long): (node, root), root the least node.

    Large-star and small-star steps alternate until the links no longer change. A hub's
    neighbours are reduced to their minimum by partial aggregation, and the joins on a
    hub's key can be split by adaptive execution. Every round is written to the shared
    folder, so a lost executor repeats one round at most.
    """
    pairs = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.save(pairs, f"{name}-0")
    mark = None
    for k in range(1, most_rounds + 1):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.save(large, f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        pairs = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


#: Tells rows with one id apart by their text.
PART = "cast(xxhash64(cast(text as string)) & 2147483647 as int)"


def without(docs: DataFrame, bad: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows named by ``bad`` (doc_id long, part int, as PART gives it), whatever other columns are called.

    ``bad`` is broadcast only if it has at most ``most`` rows (some 16 MB), else both sides are shuffled.
    """
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("part").alias("bad_part"))
    if bad.count() <= most:
        bad = F.broadcast(bad)
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("own_id"), F.expr(PART).alias("own_part"))
    return rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")) & F.col("own_part").eqNullSafe(F.col("bad_part")), "left_anti").select("whole.*")
