"""Writers: written tables, snapshots named by a pointer, and stores that commit several tables as one."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialized(df: DataFrame, label: str) -> DataFrame:
    """A table that is read more than once, written to the shared folder; losing an executor loses none of it."""
    path = f"{shared_folder(df.sparkSession)}/loomstone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files behind DataFrames from materialized(), once nothing reads them any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            _delete(df.sparkSession, name.rsplit("/", 1)[0])


def publish(df: DataFrame, base: str, partition_by: list[str] | None = None) -> str:
    """Write a new snapshot folder under base, then name it in base/_current."""
    name = f"snapshot-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{base}/{name}")
    spark = df.sparkSession
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{base}/_current")
    return name


def current(spark: SparkSession, base: str) -> DataFrame:
    name = spark.read.text(f"{base}/_current").first()[0]
    return spark.read.parquet(f"{base}/{name}")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


# --- stores -------------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, held = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(held)) if fs.exists(held) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, held = _path(spark, path)
    fs.delete(held, True)


@dataclass
class Change:
    """What a commit does to one table.

    rows: the new rows, or None where parts only go. by: the column whose values are the table's parts (a few
    hundred at most), None for a table of one part. parts: the parts that the change replaces or drops, None for
    all. add: rows come beside what the parts hold, and nothing is replaced. within: columns that partition the
    files of a part further.
    """

    rows: DataFrame | None = None
    by: str | None = None
    parts: list | None = None
    add: bool = False
    within: list[str] = field(default_factory=list)


class Store:
    """Tables under one folder, which change together.

    A commit writes new files beside the old ones, and then a manifest of all tables: for each part the folders that
    hold it. A reader takes the newest whole manifest, so it sees all of a commit or none, and old
    files stay until vacuum(). Parts that a commit does not touch keep their files. A commit of a batch that a
    manifest already names is left out, so that a stream may replay it. Manifests are numbered: of two writers that
    start from the same one, the later fails.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def numbers(self) -> list[int]:
        """Whole manifests, oldest first."""
        found = [n for n in _names(self.spark, f"{self.base}/_manifests") if n.startswith("n")]
        return [int(n[1:]) for n in found if "_SUCCESS" in _names(self.spark, f"{self.base}/_manifests/{n}")]

    def manifest(self, number: int | None = None) -> dict:
        known = self.numbers()
        if number is None and not known:
            return {"number": 0, "batches": {}, "tables": {}}
        at = known[-1] if number is None else number
        return json.loads(self.spark.read.text(f"{self.base}/_manifests/n{at:012d}").first()[0])

    def read(self, name: str, parts: list | None = None, number: int | None = None) -> DataFrame:
        """A table, or only some of its parts; other folders are not opened."""
        told = self.manifest(number)["tables"][name]
        wanted = {str(p) for p in parts} if parts is not None else None
        paths = sorted({f"{self.base}/{name}/{folder}" for part, folders in told["parts"].items() if wanted is None or part in wanted for folder in folders})
        schema = T.StructType.fromJson(told["schema"])
        if not paths:
            return self.spark.createDataFrame([], schema)
        # One folder level names the write, so that parts of several writes are one table.
        found = self.spark.read.option("basePath", f"{self.base}/{name}").schema(T.StructType([*schema.fields, T.StructField("_write", T.StringType())])).parquet(*paths)
        return found.select(*schema.names)

    def parts(self, name: str) -> list[str]:
        return sorted(self.manifest()["tables"].get(name, {"parts": {}})["parts"])

    def commit(self, changes: dict[str, Change | list[Change]], batch: tuple[str, int] | None = None) -> bool:
        """All changes as one, those of a table in their order; false where the batch (stream, number) has been committed before."""
        told = self.manifest()
        if batch and told["batches"].get(batch[0], -1) >= batch[1]:
            return False
        for name, change in [(n, c) for n, given in changes.items() for c in (given if isinstance(given, list) else [given])]:
            table = told["tables"].setdefault(name, {"parts": {}, "schema": None})
            if change.parts is None and not change.add and change.rows is not None:
                table["parts"] = {}
            elif not change.add:
                for part in change.parts or ():
                    table["parts"].pop(str(part), None)
            if change.rows is not None:
                table["schema"] = json.loads(change.rows.schema.json())
                for part, folder in self._written(name, change).items():
                    table["parts"].setdefault(part, []).append(folder)
        number = told["number"] + 1
        told |= {"number": number, "batches": told["batches"] | ({batch[0]: batch[1]} if batch else {})}
        self.spark.createDataFrame([(json.dumps(told),)], "manifest string").coalesce(1).write.mode("error").text(f"{self.base}/_manifests/n{number:012d}")
        return True

    def _written(self, name: str, change: Change) -> dict[str, str]:
        """The folders of the parts that rows made."""
        write = f"_write={uuid.uuid4().hex}"
        folders = ([change.by] if change.by else []) + change.within
        writer = change.rows.write.option("compression", "zstd")
        (writer.partitionBy(*folders) if folders else writer).parquet(f"{self.base}/{name}/{write}")
        if not change.by:
            return {"all": write}
        made = [n for n in _names(self.spark, f"{self.base}/{name}/{write}") if n.startswith(f"{change.by}=")]
        return {n.split("=", 1)[1]: f"{write}/{n}" for n in made}

    def vacuum(self, keep: int = 2) -> int:
        """Delete what the newest so many manifests do not name; the number of folders deleted."""
        known, gone = self.numbers(), 0
        live = [self.manifest(n) for n in known[-keep:]]
        held = {f"{name}/{folder}" for m in live for name, t in m["tables"].items() for folders in t["parts"].values() for folder in folders}
        writes = {"/".join(h.split("/")[:2]) for h in held}
        for name in {n for m in map(self.manifest, known) for n in m["tables"]}:
            for write in _names(self.spark, f"{self.base}/{name}"):
                at = f"{name}/{write}"
                spent = [at] if at not in writes else [] if at in held else [f"{at}/{p}" for p in _names(self.spark, f"{self.base}/{at}") if "=" in p and f"{at}/{p}" not in held]
                for folder in spent:
                    _delete(self.spark, f"{self.base}/{folder}")
                gone += len(spent)
        for n in known[:-keep]:
            _delete(self.spark, f"{self.base}/_manifests/n{n:012d}")
        return gone
