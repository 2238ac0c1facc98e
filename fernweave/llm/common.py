"""What the operators of this subpackage share: column selection, folds, writing to the shared folder, grouped passes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def whole_text(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where that is unset, one of our own if driver and executors are
    one process (a local master); on a cluster there is no folder that all of them share, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"/tmp/fernweave-checkpoints-{spark.sparkContext.applicationId}"
    return found


#: Rows' hashes are spread evenly from 0 to this. A share of the rows is a bound on the hash: in whole numbers of 63
#: bits it can't round to nothing, however many rows there are.
LAST_HASH = (1 << 63) - 1


def hash_bound(rows: int, n: int) -> int:
    """Of n hashes, at least ``rows`` are up to this with all but vanishing probability."""
    wanted = 1.3 * rows + 10 * math.sqrt(rows) + 20  # n may be an estimate, off by a few per cent
    return LAST_HASH if n <= wanted else max(1, int(LAST_HASH * (wanted / n)))


def sampled(rows: DataFrame, most: int, key: str, seed: int, within: str | None = None) -> DataFrame:
    """At most ``most`` rows of different ``key`` (for each value of the column ``within``, if given), those with the
    smallest hashes of it, with the hash as ``_hash``; all, where there are fewer. A key that repeats counts once:
    copies are merged in each task, and only what lies below a bound on the hash is shuffled at all. To the driver
    goes a number, or one for each value of ``within``."""
    hashed = rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1))
    groups = [within] if within else []
    counts = hashed.groupBy(*groups).agg(F.approx_count_distinct("_hash").alias("n")).collect()
    if not any(r.n for r in counts):
        return hashed
    if within:
        bound = F.create_map(*[F.lit(x) for r in counts for x in (r[0], hash_bound(most, r.n))])[F.col(within)]
    else:
        bound = F.lit(hash_bound(most, counts[0].n))
    once = hashed.filter(F.col("_hash") <= bound).dropDuplicates(["_hash", *groups])
    if not within:
        return once.orderBy("_hash").limit(most)
    place = F.row_number().over(Window.partitionBy(within).orderBy("_hash"))
    return once.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def lean(run):
    """``run``, a function of a task's batches, which in the end gives back to the system what it has freed: Spark keeps
    its Python workers for other tasks, and what malloc() holds back would stay with them."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def slices(batch, rows: int = 1024) -> Iterator:
    """A record batch in portions, whose values as Python objects, and what is made of them, are held one at a time."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def in_one_task(rows: DataFrame, order: list[str], run, schema: str, sample: DataFrame, source: DataFrame) -> list:
    """What ``run`` makes of bounded rows, in one task, to the driver: models. Nothing for no rows; but if that is
    because ``sample`` is empty where ``source``, of which it was drawn, isn't, that raises."""
    made = rows.repartition(1).sortWithinPartitions(*order).mapInPandas(lean(run), schema).collect()
    if not made and sample.isEmpty() and not source.isEmpty():
        raise ValueError("there are rows to learn from, but the sample of them is empty")
    return made


def within_chars(batches: Iterable[pd.DataFrame], text: str, most: int) -> Iterator[pd.DataFrame]:
    """The batches' rows, up to the one at which their texts pass ``most`` characters; the first row in any case."""
    n = 0
    for b in batches:
        sizes = b[text].str.len()
        before = n + sizes.cumsum() - sizes
        yield b[(before + sizes <= most) | (before == 0)]
        n += int(sizes.sum())
        if n > most:
            return


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the frame as Parquet to the shared folder and reads it back, so that no
    executor's loss makes Spark compute it again. Files, not blocks: they outlive every executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/fernweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes what written() made, once nothing that is still to run reads it."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if top.rsplit("/", 1)[-1].startswith("fernweave-"):
                path = jvm.org.apache.hadoop.fs.Path(top)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What is broadcast has at most so many bytes; beyond, a key's rows go to so many places.
BROADCAST_BYTES, SALTS = 16 << 20, 16


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], size: int, how: str) -> DataFrame:
    """``rows`` joined (inner, left or left_anti) with ``found``, which has ``size`` bytes, or fewer. A small one is
    broadcast. Otherwise rows of one key, of which there may be very many, are dealt over SALTS places, to each of
    which all of ``found`` goes. The places are drawn by the rows' order: ``rows`` must come straight from files, whose
    order a task that runs again finds unchanged, not out of a shuffle."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), keys, how)
    everywhere = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.floor(F.rand(7) * SALTS).cast("int")
    return rows.withColumn("_salt", salt).join(everywhere, [*keys, "_salt"], how).drop("_salt")


#: Keys with more rows than HOT_ROWS, and than a HOT_KEYS-th of all rows, are looked up by a broadcast.
HOT_ROWS, HOT_KEYS = 256, 100_000


def spread(rows: DataFrame, per_key: DataFrame, key: str, n: int) -> DataFrame:
    """``rows``, of which there are at most ``n``, joined (inner) with ``per_key``: one row a key, with the number of the
    key's rows as ``_c``. No task gets all rows of a key that has very many: of such keys, HOT_KEYS at most by that
    number, the few columns of ``per_key`` are broadcast, and their rows stay where they are."""
    many = F.col("_c") > max(HOT_ROWS, n // HOT_KEYS)
    hot, others = F.broadcast(per_key.filter(many)), per_key.filter(~many)
    cold = rows.join(F.broadcast(per_key.filter(many).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(others, key)).drop("_c")


def over_batches(docs: DataFrame, run) -> DataFrame:
    """mapInArrow() that keeps the schema; columns are told by their places, so that they may have any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_whole_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 4096) -> DataFrame:
    """Deals the rows by ``keys`` and hands ``fn`` frames of at least ``rows`` rows (but for the last) that
    never cut a group: for many small groups far cheaper than a call for each. Only for bounded groups."""
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n < rows:
                continue
            frame = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
            last = frame[keys].iloc[-1]
            tail = (frame[keys] == last).all(axis=1).to_numpy()
            if not tail.all():
                yield fn(frame[~tail].reset_index(drop=True))
                frame = frame[tail].reset_index(drop=True)
            held, n = [frame], len(frame)
        if held:
            frame = pd.concat(held, ignore_index=True)
            yield fn(frame)

    return dealt.mapInPandas(lean(run), schema)
