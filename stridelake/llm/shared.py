"""What the corpus operators share: tables in the cluster's shared folder, membership filters, skew-proof ranks.

Intermediate tables are written to the folder named in ``spark.checkpoint.dir``, so a lost executor
costs a reread and never a recomputation of nondeterministic values.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: White space that separates words: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: By the pigeonhole principle at most this many keys hold 1/HEAVY_KEYS of all rows each.
HEAVY_KEYS = 4096
#: Texts of a batch that a Python worker gets: some MB, in place of a whole task's rows, which the JVM and the worker hold twice each.
BATCH_ROWS = 1000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a single-process session may fall back to a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="stridelake-")
    atexit.register(shutil.rmtree, base, True)
    spark.sparkContext.setCheckpointDir(f"file://{base}")
    return f"file://{base}"


class Workspace:
    """Tables of one operator run. ``finish`` keeps the result and removes the rest. Python workers get ``batch_rows`` rows at once while a table is written."""

    def __init__(self, spark: SparkSession, name: str, batch_rows: int | None = None):
        self.spark = spark
        self.batch_rows = batch_rows
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: list[str] = []
        atexit.register(self._delete, self.path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is the cluster's scratch space
            pass

    def put(self, df: DataFrame, name: str, partition_by: Sequence[str] = (), **options: str) -> DataFrame:
        """Write once, read back: cuts lineage and fixes nondeterministic values."""
        df = self._nameable(df)
        to = f"{self.path}/{name}"
        with self._batched():
            df.write.options(**({"compression": "zstd"} | options)).partitionBy(*partition_by).parquet(to)
        if name not in self.held:
            self.held.append(name)
        return self.spark.read.schema(df.schema).parquet(to)

    @contextlib.contextmanager
    def _batched(self) -> Iterator[None]:
        before = int(self.spark.conf.get(_ARROW_ROWS))
        if not self.batch_rows or 0 < before <= self.batch_rows:
            yield
            return
        self.spark.conf.set(_ARROW_ROWS, self.batch_rows)
        try:
            yield
        finally:
            self.spark.conf.set(_ARROW_ROWS, before)

    @staticmethod
    def _nameable(df: DataFrame) -> DataFrame:
        return df.withColumns({f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema if isinstance(f.dataType, T.NullType)}) if any(isinstance(f.dataType, T.NullType) for f in df.schema) else df

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")
            if name in self.held:
                self.held.remove(name)

    def keep(self, *names: str) -> None:
        """Remove all tables but these: a lazy result with whole texts reads them when it is written, and is never stored twice."""
        self.drop(*[x for x in self.held if x not in names])

    def finish(self, df: DataFrame) -> DataFrame:
        """Store a narrow result."""
        out = self.put(df, "result")
        self.drop(*[x for x in self.held if x != "result"])
        return out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. All-ASCII texts take the vectorised path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: A block of Spark's bitmap functions: 4096 bytes.
BITMAP_BITS = 32768
#: Bits a key and most blocks of a filter: 16 MB, for 8 million keys at full accuracy.
KEY_BITS, MOST_BLOCKS = 16, 4096


@dataclass(frozen=True)
class KeyFilter:
    """A one-hash Bloom filter as rows of 4 KB (_block, _bits). Beyond MOST_BLOCKS it gets fuller, and a full one passes every row: slower, never wrong."""

    rows: DataFrame
    blocks: int


def _slot(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks * BITMAP_BITS).cast("long"))


def filter_blocks(n_keys: int, most: int = MOST_BLOCKS) -> int:
    return min(most, max(8, -(-n_keys * KEY_BITS // BITMAP_BITS)))


def filter_rows(keys: DataFrame, key: Column, blocks: int, *by: str) -> DataFrame:
    """[by,] _block, _bits of the filter of ``key``, or of one filter for each ``by``."""
    slots = keys.select(*by, _slot(key, blocks).alias("_slot"))
    return slots.groupBy(*by, (F.col("_slot") / BITMAP_BITS).cast("int").alias("_block")).agg(F.bitmap_construct_agg((F.col("_slot") % BITMAP_BITS)).alias("_bits"))


def key_filter(keys: DataFrame, key: Column) -> KeyFilter:
    """A filter of ``key``, sized by the number of keys (a written table is counted from its footers) and small enough to broadcast."""
    blocks = filter_blocks(keys.count())
    return KeyFilter(filter_rows(keys, key, blocks), blocks)


def flagged(df: DataFrame, key: Column, bloom: KeyFilter, flag: str = "_maybe", by: str | None = None) -> DataFrame:
    """``df`` with a boolean: False means that ``key`` is certainly not in the filter (with ``by``, that of its row's value)."""
    bit = F.col("_slot") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn("_slot", _slot(key, bloom.blocks))
        .withColumn("_block", (F.col("_slot") / BITMAP_BITS).cast("int"))
        .join(F.broadcast(bloom.rows), [*([by] if by else []), "_block"], "left")
        .withColumn(flag, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_slot % 8 as int))")) != 0, F.lit(False)))
        .drop("_slot", "_block", "_bits")
    )


def ranked(df: DataFrame, group: Sequence[str], order: Column, ties: Sequence[Column] = (), amount: str | None = None, rank: str = "rank", start: str = "start", top_bits: int = 10) -> DataFrame:
    """0-based rank in each group by a 64-bit ``order`` (ties by ``ties``) and, with ``amount``, its running sum before the row.

    A group is cut by the order's top bits, so a group that holds a third of all rows is ranked by
    many tasks; bucket offsets come from a pre-aggregated table of at most 2**top_bits rows a group.
    """
    keys = [*group, "_bucket"]
    cut = df.withColumn("_order", order).withColumn("_bucket", F.shiftright("_order", 64 - top_bits))
    sums = [F.count(F.lit(1)).alias("_n"), F.sum(F.col(amount) if amount else F.lit(0)).alias("_sum")]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(*sums).select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0"),
    )
    inside = Window.partitionBy(*keys).orderBy("_order", *ties)
    out = cut.withColumn("_rn", F.row_number().over(inside))
    if amount:
        out = out.withColumn("_run", F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(offsets, keys).withColumn(rank, F.col("_rank0") + F.col("_rn") - 1)
    if amount:
        out = out.withColumn(start, F.col("_sum0") + F.col("_run"))
    return out.drop("_order", "_bucket", "_rn", "_run", "_rank0", "_sum0")


def numbered(work: Workspace, df: DataFrame, order: Sequence[str], name: str, number: str = "nth") -> DataFrame:
    """``df`` with 0-based numbers in ``order``, by a range-partitioned sort: no task sees all rows, and the driver one count a partition."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = work.put(sorted_.withColumn("_at", F.monotonically_increasing_id()), name)  # written: the places are fixed from here on
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(number, here).drop("_at", "_part", "_before")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, how: str = "inner") -> DataFrame:
    """Join rows to their group's one row in ``groups``, whose ``size`` is its number of rows.

    Groups of 1/HEAVY_KEYS of all rows or more are HEAVY_KEYS at most, so these may be broadcast; no other
    group is large, so the shuffle of the rest has no hot key.
    """
    least = max(2, (groups.agg(F.sum(size)).first()[0] or 0) // HEAVY_KEYS + 1)
    extra = [c for c in groups.columns if c not in keys]
    heavy = F.broadcast(groups.where(F.col(size) >= least).select(*keys, F.struct(*extra).alias("_heavy")))
    first = rows.join(heavy, list(keys), "left")
    hot = first.where("_heavy is not null").select(*rows.columns, "_heavy.*")
    rest = first.where("_heavy is null").drop("_heavy").join(groups.where(F.col(size) < least), list(keys), how)
    return hot.select(*rows.columns, *extra).unionByName(rest.select(*rows.columns, *extra))
