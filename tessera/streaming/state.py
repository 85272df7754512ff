"""Versioned state of a stream: tables and values that are committed together, or not at all.

A version's tables are written into a folder of their own, then one small JSON
file that names them is renamed to the version's number. What has no such file is
not there: a version that was half written is never read, and is written anew
into another folder when its batch runs again. A version that is committed stays
as it is, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marker(self, version: int):
        return self._at(f"{self.path}/_commits/{version:012d}.json")

    def committed(self) -> list[int]:
        """The numbers of the committed versions, ascending."""
        folder = self._at(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int) -> dict:
        """values and tables (path and schema of each) of a committed version."""
        return json.loads(self.spark.read.text(self._marker(version).toString(), wholetext=True).first()[0])

    def latest(self, before: int | None = None) -> dict:
        """The manifest of the last version (before a number), or an empty one."""
        known = [v for v in self.committed() if before is None or v < before]
        return self.manifest(known[-1]) if known else {"version": None, "values": {}, "tables": {}}

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """A table of the last version that has it; empty where none has."""
        at = self.latest(before)["tables"].get(name)
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def appended(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """The rows that all versions have added to a table."""
        paths = [self.manifest(v)["tables"].get(name) for v in self.committed() if before is None or v < before]
        paths = [p for p in paths if p]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, version: int, tables: dict[str, DataFrame], values: dict | None = None) -> bool:
        """Write the tables and then their manifest; False, and nothing is changed, if the version is there already."""
        if version in self.committed():
            return False
        own = f"{self.path}/data/{version:012d}-{uuid.uuid4().hex}"
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{own}/{name}"
            df.write.parquet(paths[name])
        return self._publish(version, {"version": version, "values": values or {}, "tables": paths})

    def _publish(self, version: int, manifest: dict) -> bool:
        draft = self._at(f"{self.path}/_commits/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()))
        out.close()
        # a rename that finds the name taken fails: of two writers one wins
        if self._fs.rename(draft, self._marker(version)):
            return True
        self._fs.delete(draft, False)
        return False

    def unreferenced(self) -> list[str]:
        """Folders that no manifest names: what batches that were cut off have left."""
        folder = self._at(f"{self.path}/data")
        if not self._fs.exists(folder):
            return []
        named = {p.rsplit("/", 1)[0].rsplit("/", 1)[-1] for v in self.committed() for p in self.manifest(v)["tables"].values()}
        return sorted(f.getPath().toString() for f in self._fs.listStatus(folder) if f.getPath().getName() not in named)

    def vacuum(self) -> int:
        """Delete the unreferenced folders; not while a batch is being written."""
        gone = self.unreferenced()
        for path in gone:
            self._fs.delete(self._at(path), True)
        return len(gone)


TOPICS = "topic string, signature string, number long"


def carried(versions: Versions, version: int, topics: DataFrame, blocked: DataFrame, generated: int, keep: int = 400) -> tuple[dict[str, DataFrame], dict]:
    """(tables, values) of the generator's memory after a batch: the last ``keep`` topics, the sorted distinct block list, the counter.

    topics: topic, signature and place, by which they are ordered within the batch;
    blocked: term; generated: ids given out in the batch. Repeated topics stay.
    """
    before = versions.latest(version)["values"]
    told, n = before.get("topics", 0), topics.count()
    # the batch's last ones, at most keep rows, count back from the number of all
    back = F.row_number().over(Window.orderBy(F.desc("place"), F.desc("topic")))
    last = topics.orderBy(F.desc("place"), F.desc("topic")).limit(keep).select("topic", "signature", (F.lit(told + n) - back).cast("long").alias("number"))
    kept = versions.table("topics", TOPICS, version).unionByName(last).orderBy(F.desc("number")).limit(keep).orderBy("number")
    terms = versions.table("blocklist", "term string", version).unionByName(blocked.select("term")).where("term IS NOT NULL").distinct().orderBy("term")
    return {"topics": kept, "blocklist": terms}, {"topics": told + n, "counter": before.get("counter", 0) + generated}
