"""Tables in Parquet that change in whole versions.

A store is a folder with data and manifests. A manifest names the folders of every table's parts; a version is one manifest, and the
newest is the state. A transaction writes the parts that it changes into a staging folder of its own, and then puts its manifest in place
by one rename that fails if another transaction was first. So readers see all of it or nothing, keep the version that they began with,
and a run that dies leaves only files that no manifest names. A part is a partition (a region, say) and a bucket of the key's hash: an
upsert reads and rewrites the parts that it touches, and the others keep their files. A manifest has partitions times buckets entries.

Each writer numbers its batches; a batch that was applied once is known by the manifest and changes nothing when it comes again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Most partitions of a table: their values are in each manifest.
MOST = 10_000


class Conflict(RuntimeError):
    """Another transaction put this version in place first."""


class Files:
    """The few calls to Hadoop's file systems that manifests need."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Puts a file in place whole, or raises Conflict if there is one."""
        part = f"{name.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), False)
        out.write(text.encode())
        out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.gateway.new_array(kind, 1)
        never[0] = kind.valueOf("NONE")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        try:
            context.rename(self.path(part), self.path(name), never)
        except Exception as e:
            self.fs.delete(self.path(part), False)
            if self.fs.exists(self.path(name)):
                raise Conflict(name) from e
            raise


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.read(f"{self.root}/versions/{version:012d}.json")) if version else {"version": 0, "tables": {}, "writers": {}}

    def read(self, name: str, version: int | None = None, **only) -> DataFrame:
        """The table of a version (the newest by default). only: partition values, by column; other partitions' files are not looked at."""
        return _rows(self, self.manifest(version)["tables"][name], only)

    def begin(self, writer: str | None = None, batch: int | None = None) -> Transaction | None:
        """A transaction on the newest version, or None if it has this batch of this writer, or a later one."""
        now = self.manifest()
        if writer is not None and now["writers"].get(writer, -1) >= batch:
            return None
        return Transaction(self, now, writer, batch)


def _rows(store: Store, table: dict, only: dict | None = None, parts: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    fits = [k for k, values in enumerate(table["values"]) if all(values[table["by"].index(c)] == v for c, v in (only or {}).items())]
    chosen = set(fits)
    folders = [f"{store.root}/{f}" for part, held in table["parts"].items() if int(part) // table["buckets"] in chosen and (parts is None or int(part) in parts) for f in held]
    return store.spark.read.schema(schema).parquet(*folders) if folders else store.spark.createDataFrame([], schema)


class Transaction:
    """Changes to tables of one store that become its next version together, on commit."""

    def __init__(self, store: Store, base: dict, writer: str | None, batch: int | None):
        self.store, self.base, self.writer, self.batch = store, base, writer, batch
        self.tables, self.staging = json.loads(json.dumps(base["tables"])), f"data/{uuid.uuid4().hex}"

    def read(self, name: str, parts: set[int] | None = None) -> DataFrame | None:
        """The table, or some parts of it, as it was when the transaction began, or None."""
        return _rows(self.store, self.base["tables"][name], parts=parts) if name in self.base["tables"] else None

    def create(self, name: str, schema: StructType, key: Sequence[str], by: Sequence[str] = (), buckets: int = 8) -> None:
        """A new empty table, unless there is one. by: the columns of the key whose values make partitions."""
        if not set(by) <= set(key):
            raise ValueError("partition columns are columns of the key")
        self.tables.setdefault(name, {"schema": schema.jsonValue(), "key": list(key), "by": list(by), "buckets": buckets, "values": [], "parts": {}})

    def _placed(self, table: dict, rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
        """rows with the number of the part that each belongs to; new partition values are numbered in their order.

        among: rows whose values these have, where that is known, so that rows that are dear to make are made once. An empty one: the
        values are known to the table. Rows of other values get part -1."""
        bucket = F.pmod(F.xxhash64(*table["key"]), F.lit(table["buckets"])).cast("int")
        if not table["by"]:
            table["values"] = [[]]
            return rows.withColumn("_part", bucket)
        found = [list(r) for r in (rows if among is None else among).select(*table["by"]).distinct().limit(MOST + 1).collect()]
        known = table["values"]
        known += sorted((v for v in found if v not in known), key=lambda v: [(x is not None, str(x)) for x in v])
        if len(known) > MOST:
            raise ValueError(f"more than {MOST} partitions")
        numbers = self.store.spark.createDataFrame([(k, tuple(v)) for k, v in enumerate(known)], StructType().add("_number", IntegerType()).add("_values", rows.select(*table["by"]).schema))
        same = F.struct(*table["by"]).eqNullSafe(F.col("_values"))
        return rows.join(F.broadcast(numbers), same, "left").withColumn("_part", F.coalesce(F.col("_number") * table["buckets"] + bucket, F.lit(-1))).drop("_number", "_values")

    def placed(self, name: str, rows: DataFrame, among: DataFrame | None = None) -> DataFrame:
        """rows of a table with the number of their part, `_part`."""
        return self._placed(self.tables[name], rows, among)

    def _write(self, name: str, placed: DataFrame, gathered: bool = False) -> dict[int, str]:
        """Writes rows by part; the folder of each part that has any. gathered: the rows of a part are in one task already."""
        table, folder = self.tables[name], f"{self.staging}/{name}-{uuid.uuid4().hex[:8]}"
        columns = StructType.fromJson(table["schema"]).names
        rows = placed.select(*columns, "_part")
        rows = (rows if gathered else rows.repartition("_part")).sortWithinPartitions("_part", *table["key"])
        rows.write.partitionBy("_part").parquet(f"{self.store.root}/{folder}")
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in self.store.files.names(f"{self.store.root}/{folder}") if n.startswith("_part=")}

    def upsert(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], gathered: bool = False) -> set[int]:
        """merge(old rows, rows) in place of the parts that rows fall into; the numbers of these parts. Merged rows keep their keys' parts.

        gathered: merge gets both with `_part`, and gives rows with it that are gathered by it, so that they are not shuffled again."""
        table = self.tables[name]
        placed = self._placed(table, rows)
        touched = {r[0] for r in placed.select("_part").distinct().collect()}
        old, known = _rows(self.store, table, parts=touched), rows.limit(0)
        merged = merge(self._placed(table, old, known), placed) if gathered else self._placed(table, merge(old, rows), known)
        written = self._write(name, merged, gathered) if touched else {}
        if not set(written) <= touched:
            raise ValueError("merged rows left the parts of the batch")
        for part in touched:
            table["parts"].pop(str(part), None)
        table["parts"] |= {str(p): [f] for p, f in written.items()}
        return touched

    def append(self, name: str, rows: DataFrame) -> None:
        """rows beside those that are there. Rows with `_part` (of `placed`) are gathered by it."""
        table, gathered = self.tables[name], "_part" in rows.columns
        written = self._write(name, rows if gathered else self._placed(table, rows), gathered)
        if -1 in written:
            raise ValueError("rows of other partitions")
        for part, folder in written.items():
            table["parts"][str(part)] = [*table["parts"].get(str(part), []), folder]

    def replace(self, name: str, rows: DataFrame) -> None:
        """rows in place of the whole table."""
        table = self.tables[name]
        table["parts"] = {str(p): [f] for p, f in self._write(name, self._placed(table, rows)).items()}

    def commit(self) -> int:
        """The number of the version made. Raises Conflict, and changes nothing, if another transaction was first."""
        version = self.base["version"] + 1
        writers = self.base["writers"] | ({self.writer: self.batch} if self.writer is not None else {})
        text = json.dumps({"version": version, "tables": self.tables, "writers": writers})
        self.store.files.create(f"{self.store.root}/versions/{version:012d}.json", text)
        return version
