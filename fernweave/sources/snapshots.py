"""Tables with upsert and delete on plain Parquet. Rows lie in BUCKETS buckets by the hash of a key; a change writes new
folders for the buckets that it touches, and then a pointer, a file that lists the schema and every bucket's folder, is
put in place by a rename. A reader never sees a folder that is being written, and never a pointer that is half written.
What the last KEPT pointers list stays for readers still at work."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StoreError
from ..operators.manage import last_wins

POINTERS, KEPT, BUCKETS = "_pointers", 3, 16


def condition(filters: dict) -> Column | None:
    """AND of equalities; a list means any of it; nothing for no filters."""
    parts = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in filters.items()]
    return reduce(lambda a, b: a & b, parts) if parts else None


class SnapshotTable:
    """One writer at a time; readers of the last KEPT snapshots keep their files. Any file system that Spark knows.

    ``bucket_by``: columns that all rows of a key agree on, so that what is changed together lies together; the keys
    by default. ``sort_by``: rows lie in this order in their files, so that filters on it skip row groups."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_by: list[str] | None = None, sort_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.bucket_by, self.sort_by = spark, path.rstrip("/"), keys, bucket_by or keys, sort_by or []

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _pointers(self) -> list[tuple[int, str]]:
        """(number, snapshot) of all pointers, the last one last."""
        fs, path = self._fs(POINTERS)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n.split("_")[0]), n.split("_")[1]) for n in names if n[0].isdigit())

    def _listed(self, number: int, name: str) -> dict:
        """What a pointer says: ``schema`` and ``buckets``, each bucket's folder."""
        fs, path = self._fs(f"{POINTERS}/{number:012d}_{name}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _last(self) -> dict | None:
        found = self._pointers()
        return self._listed(*found[-1]) if found else None

    def current(self) -> str | None:
        """The snapshot that holds, for restore()."""
        found = self._pointers()
        return found[-1][1] if found else None

    def _read(self, listed: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(listed["schema"])
        folders = [f"{self.path}/{f}" for b, f in listed["buckets"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        last = self._last()
        return self._read(last) if last else None

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.bucket_by]), F.lit(BUCKETS))

    def _written(self, df: DataFrame, dealt: bool = True) -> tuple[str, dict[str, str]]:
        """A new folder with a folder for each bucket that has rows, and which these are."""
        new = f"v-{uuid.uuid4().hex}"
        d = df.withColumn("_bucket", self._bucket())
        # Files of a good size, whatever the buckets' sizes: small ones are brought together, large ones split.
        d = d.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *self.sort_by) if dealt else d
        d.write.partitionBy("_bucket").parquet(f"{self.path}/{new}")
        fs, path = self._fs(new)
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return new, {n.split("=")[1]: f"{new}/{n}" for n in names if n.startswith("_bucket=")}

    def _commit(self, schema: StructType, buckets: dict[str, str]) -> None:
        self._point(f"v-{uuid.uuid4().hex}", {"schema": schema.jsonValue(), "buckets": buckets})

    def _point(self, name: str, listed: dict) -> None:
        before = self._pointers()
        number = before[-1][0] + 1 if before else 0
        fs, made = self._fs(f"{POINTERS}/.{name}")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        if not fs.rename(made, self._fs(f"{POINTERS}/{number:012d}_{name}")[1]):
            raise StoreError(f"{self.path}: the new snapshot's pointer couldn't be put in place")
        old, kept = before[: -(KEPT - 1)], [self._listed(*p) for p in before[-(KEPT - 1) :]] + [listed]
        used = {f for k in kept for f in k["buckets"].values()}
        in_use = {f.split("/")[0] for f in used}
        for p in old:
            gone = set(self._listed(*p)["buckets"].values()) - used
            fs.delete(self._fs(f"{POINTERS}/{p[0]:012d}_{p[1]}")[1], False)
            for f in gone | {g.split("/")[0] for g in gone if g.split("/")[0] not in in_use}:
                fs.delete(self._fs(f)[1], True)

    def restore(self, name: str) -> None:
        """Makes a snapshot that is still there the one that holds."""
        number = max(n for n, found in self._pointers() if found == name)
        self._point(name, self._listed(number, name))

    def forget(self) -> None:
        """As if nothing had ever been written."""
        fs, path = self._fs(POINTERS)
        fs.delete(path, True)

    def upsert(self, rows: DataFrame) -> None:
        """Replaces by key; of rows with one key in ``rows`` any one wins. No rows: nothing changes, but that a new table
        has their columns. ``rows`` are computed once; only the buckets that they lie in are written again."""
        last = self._last()
        if last is None:
            self._commit(rows.schema, self._written(rows.dropDuplicates(self.keys))[1])
            return
        schema = StructType.fromJson(last["schema"])
        staged, touched = self._written(rows.select(*schema.names), dealt=False)
        if touched:
            new = self.spark.read.schema(rows.select(*schema.names).schema).parquet(*[f"{self.path}/{f}" for f in touched.values()])
            whole = last_wins(self._read(last).withColumn("_seq", F.lit(0)), new.withColumn("_seq", F.lit(1)), self.keys, "_seq").drop("_seq")
            if [f.dataType for f in whole.select(*schema.names).schema] == [f.dataType for f in schema]:
                part = self._read(last, list(touched)).withColumn("_seq", F.lit(0))
                merged = last_wins(part, new.withColumn("_seq", F.lit(1)), self.keys, "_seq").drop("_seq").select(*schema.names)
                self._commit(schema, last["buckets"] | self._written(merged)[1])
            else:  # a wider type: all buckets get it
                whole = whole.select(*schema.names)
                self._commit(whole.schema, self._written(whole)[1])
        fs, path = self._fs(staged)
        fs.delete(path, True)

    def replace(self, rows: DataFrame) -> None:
        """The rows instead of all that are there."""
        self._commit(rows.schema, self._written(rows)[1])

    def delete(self, **filters) -> int:
        """How many rows went; no filter deletes nothing. Only buckets that lose rows are written again."""
        where, last = condition(filters), self._last()
        if where is None or last is None:
            return 0
        lost = {str(r.b): r.n for r in self._read(last).filter(where).groupBy(self._bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if lost:
            kept = self._read(last, list(lost)).filter(~F.coalesce(where, F.lit(False)))
            others = {b: f for b, f in last["buckets"].items() if b not in lost}
            self._commit(StructType.fromJson(last["schema"]), others | self._written(kept)[1])
        return sum(lost.values())

    def count(self, **filters) -> int:
        df, where = self.read(), condition(filters)
        return 0 if df is None else (df.filter(where) if where is not None else df).count()
