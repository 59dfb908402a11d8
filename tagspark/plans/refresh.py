"""Tags of a register that is delivered again and again: only what changed is tagged anew.

A store keeps, in buckets of the record id, a digest of every record and its tags. A refresh compares the digests of the new delivery with
those kept, tags the records that are new or changed, and writes the buckets they lie in; all other buckets stay as files. What is
current is said by a manifest, written last: a refresh that dies before changes nothing, and running it again does the same work.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagspark.session import keep_table, release

BUCKETS = 64


def record_digests(records: DataFrame, id: str = "org_id") -> DataFrame:
    """``id, digest``: one row for each id, the same for the same rows in any order; rows of one id count together, repeats too."""
    cells = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(c for c in records.columns if c != id)]
    row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells) if cells else F.lit("")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = records.select(id, row.alias("_row")).groupBy(id).agg(F.sum("_row").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return sums.select(id, F.concat_ws(":", F.col("_n").cast("string"), F.col("_sum").cast("string")).alias("digest"))


def snapshot_diff(old: DataFrame, new: DataFrame, id: str = "org_id") -> DataFrame:
    """``id, change`` (added, changed or removed) between two tables of digests; ids that did not change are left out, a null id is an id."""
    a, b = old.select(F.col(id).alias("_a"), F.col("digest").alias("_x")), new.select(F.col(id).alias("_b"), F.col("digest").alias("_y"))
    both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_x") != F.col("_y"), "changed")
    key = F.when(F.col("_x").isNull(), F.col("_b")).otherwise(F.col("_a"))
    return both.select(key.alias(id), change.alias("change")).where("change is not null")


@dataclass
class TagStore:
    """Tags and record digests under ``path``, in ``buckets`` parts. ``tag_schema`` is what a tagger returns, the id in it."""

    spark: SparkSession
    path: str
    id: str = "org_id"
    buckets: int = BUCKETS
    tag_schema: str = "org_id string, code string"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.id).cast("string")), F.lit(self.buckets)).cast("int")

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        fs, where = self._folder(f"{self.path}/manifest")
        if not fs.exists(where):
            return []
        done = [f.getPath() for f in fs.listStatus(where) if fs.exists(self._folder(f"{f.getPath()}/_SUCCESS")[1])]
        return sorted(int(p.getName()) for p in done)

    def manifest(self) -> dict:
        """The current version: its number, the settings it was made with, and the version that each bucket lies in."""
        found = self.versions()
        if not found:
            return {"version": 0, "settings": None, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{found[-1]}").first()[0])

    def _read(self, kind: str, schema: T.StructType, manifest: dict, only: set[int] | None = None) -> DataFrame:
        at = [f"{self.path}/{kind}/v={v}/bucket={b}" for b, v in manifest["buckets"].items() if only is None or int(b) in only]
        at = [p for p in at if self._folder(p)[0].exists(self._folder(p)[1])]  # a bucket without rows has no folder
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def tags(self) -> DataFrame:
        """The current tags."""
        return self._read("tags", self._tag_types(), self.manifest())

    def _tag_types(self) -> T.StructType:
        return T.StructType.fromDDL(self.tag_schema)

    def _digest_types(self) -> T.StructType:
        return T.StructType([self._tag_types()[self.id], T.StructField("digest", T.StringType())])

    def refresh(self, records: DataFrame, tagger: Callable[[DataFrame], DataFrame], settings: str = "") -> dict[str, int]:
        """Bring the tags up to ``records``; numbers of records added, changed, removed and tagged, and of buckets written.

        ``tagger`` gives the tags of some records, each from its own row alone. ``settings`` names what it does: if that differs from what
        the store was made with, all records are tagged anew.
        """
        now = self.manifest()
        digests = record_digests(records, self.id)
        old = self._read("digests", self._digest_types(), now)
        if now["settings"] != settings:
            old = old.withColumn("digest", F.lit("other settings"))
        changes = keep_table(snapshot_diff(old, digests, self.id).withColumn("bucket", self._bucket()), "changes")
        counts = {r[0]: r[1] for r in changes.groupBy("change").count().collect()}
        out = {c: counts.get(c, 0) for c in ("added", "changed", "removed")}
        if counts:
            touched = {r[0] for r in changes.select("bucket").distinct().collect()}
            version = now["version"] + 1
            gone = changes.select(F.col(self.id).alias("_id"))
            todo = changes.where("change <> 'removed'").select(F.col(self.id).alias("_id"))
            same = F.col(self.id).eqNullSafe(F.col("_id"))
            for kind, types, made in (
                ("tags", self._tag_types(), tagger(records.join(todo, same, "left_semi"))),
                ("digests", self._digest_types(), digests.join(todo, same, "left_semi")),
            ):
                stay = self._read(kind, types, now, touched).join(gone, same, "left_anti")
                rows = stay.unionByName(made.select(*types.names)).withColumn("bucket", self._bucket())
                rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/v={version}")
            after = {**now["buckets"], **{str(b): version for b in touched}}
            text = json.dumps({"version": version, "settings": settings, "buckets": after})
            self.spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{version}")
        release(changes)
        return {**out, "tagged": out["added"] + out["changed"], "buckets": len(touched) if counts else 0}

    def vacuum(self) -> int:
        """Remove folders that the current manifest does not name, and older manifests; the number removed. Nothing may be reading them."""
        now, removed = self.manifest(), 0
        for kind in ("tags", "digests"):
            fs, where = self._folder(f"{self.path}/{kind}")
            for version in fs.listStatus(where) if fs.exists(where) else []:
                for bucket in fs.listStatus(version.getPath()):
                    name = bucket.getPath().getName()
                    if name.startswith("bucket=") and f"v={now['buckets'].get(name[7:])}" != version.getPath().getName():
                        removed += bool(fs.delete(bucket.getPath(), True))
        for version in self.versions()[:-1]:
            fs, where = self._folder(f"{self.path}/manifest/{version}")
            fs.delete(where, True)
        return removed
