"""A table kept current: changed keys alone are worked off again, and a crash leaves the last good state.

Rows lie in batches, a folder each; a batch that changes is written anew as a folder of its
next version, beside the old one. A manifest, a small table of (batch, version, rows), says
which versions count. It is written last, under its own number, and counts once it is
complete, so whatever stops an update before that leaves the earlier manifest in force, and
what was written under it intact. Folders that no manifest names are deleted by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Maintained:
    """A folder of versions of batches; ``key`` decides a row's batch, of which there are ``batches`` from the start on."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | None = None, batches: int = 64):
        """Opens the table at ``path``; with a ``schema``, makes an empty one where there is none yet."""
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        if not self._manifests():
            if schema is None:
                raise ValueError(f"no table at {path}")
            empty = spark.createDataFrame([], schema)
            empty.write.parquet(f"{self.path}/empty")
            empty.select(F.lit(batches).alias("batches")).sparkSession.createDataFrame([(batches,)], "batches int").coalesce(1).write.parquet(f"{self.path}/settings")
            self._commit(spark.createDataFrame([], "batch int, version int, rows long"), 0)
        self.schema = spark.read.parquet(f"{self.path}/empty").schema
        self.batches = spark.read.parquet(f"{self.path}/settings").first()[0]

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._hadoop(folder)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _manifests(self) -> list[int]:
        """Numbers of complete manifests, in order."""
        done = []
        for name in self._names(f"{self.path}/manifests"):
            at, fs = self._hadoop(f"{self.path}/manifests/{name}/_SUCCESS")
            if name.isdigit() and fs.exists(at):
                done.append(int(name))
        return sorted(done)

    def _commit(self, manifest: DataFrame, number: int) -> None:
        # over an unfinished one of this number, if an update stopped there
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifests/{number}")

    def manifest(self) -> DataFrame:
        """(batch, version, rows) in force."""
        return self.spark.read.schema("batch int, version int, rows long").parquet(f"{self.path}/manifests/{self._manifests()[-1]}")

    def batch(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.batches)).cast("int")

    def read(self) -> DataFrame:
        """The rows in force. Only folders that the manifest names are read: the join prunes partitions."""
        return self._versions(self.manifest()).select(*self.schema.names)

    def _versions(self, manifest: DataFrame) -> DataFrame:
        if not self._names(f"{self.path}/data"):
            return self.spark.createDataFrame([], self.schema).withColumns({"batch": F.lit(0), "version": F.lit(0)})
        rows = self.spark.read.schema(self.spark.createDataFrame([], self.schema).withColumns({"batch": F.lit(0), "version": F.lit(0)}).schema).parquet(f"{self.path}/data")
        return rows.join(F.broadcast(manifest.select("batch", "version")), ["batch", "version"])  # a row for each of a fixed number of batches

    def update(self, fresh: DataFrame, changed: DataFrame, crash: str | None = None) -> None:
        """Replace all rows of the keys in ``changed`` (key) by those in ``fresh``; rows of other keys stay, and so do files of batches without a changed key.

        A key of ``fresh`` that is not in ``changed`` is an error: its old rows would stay
        beside it. ``crash`` stops after "data" or in "manifest", for tests.
        """
        changed = changed.select(self.key).distinct()
        # keys alone are compared; rows need not move for that
        if not fresh.select(self.key).distinct().join(changed, self.key, "left_anti").isEmpty():
            raise ValueError("fresh rows of keys that are not said to have changed")
        number = self._manifests()[-1] + 1
        now = self.manifest()
        touched = changed.select(self.batch().alias("batch")).distinct()
        kept = self._versions(now.join(touched, "batch", "left_semi")).select(*self.schema.names).join(changed, self.key, "left_anti")
        rows = kept.unionByName(fresh.select(*self.schema.names)).withColumns({"batch": self.batch(), "version": F.lit(number)})
        # an update that stopped under this number may have left folders; the overwrite replaces those that come again
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "version").parquet(f"{self.path}/data")
        if crash == "data":
            raise RuntimeError("stopped after the data")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data").filter(F.col("version") == number).join(F.broadcast(touched), "batch").groupBy("batch", "version").agg(F.count("*").alias("rows"))
        manifest = now.join(touched, "batch", "left_anti").unionByName(written)
        if crash == "manifest":
            at, fs = self._hadoop(f"{self.path}/manifests/{number}/part-0")
            fs.create(at).close()
            raise RuntimeError("stopped in the manifest")
        self._commit(manifest.coalesce(1), number)

    def clean(self) -> int:
        """Delete older manifests and every version of a batch that the one in force doesn't name; how many versions went."""
        numbers = self._manifests()
        for n in [x for x in self._names(f"{self.path}/manifests") if x != str(numbers[-1])]:
            at, fs = self._hadoop(f"{self.path}/manifests/{n}")
            fs.delete(at, True)
        named, gone = {f"batch={r.batch}/version={r.version}" for r in self.manifest().collect()}, 0  # a fixed number of batches
        for b in self._names(f"{self.path}/data"):
            for v in self._names(f"{self.path}/data/{b}") if b.startswith("batch=") else []:
                if f"{b}/{v}" not in named:
                    at, fs = self._hadoop(f"{self.path}/data/{b}/{v}")
                    fs.delete(at, True)
                    gone += 1
        return gone


def relabelled(rows: DataFrame, label: str, gained: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """``rows`` of keys (key, label) with labels gained and lost: a gained label (key, ``source``, label) gets copies of the key's rows under ``source``; rows of lost labels (key, label) go.

    Labels that a key has already are not gained twice; copies are made before labels are dropped.
    """
    new = gained.select(key, F.col("source").alias("_source"), F.col(label).alias("_new")).distinct()
    new = new.join(rows.select(key, F.col(label).alias("_new")).distinct(), [key, "_new"], "left_anti")
    copies = rows.join(new, (rows[key] == new[key]) & (rows[label] == new["_source"])).drop(new[key]).withColumn(label, F.col("_new")).select(*rows.columns)
    return rows.unionByName(copies).join(lost.select(key, label).distinct(), [key, label], "left_anti").select(*rows.columns)
