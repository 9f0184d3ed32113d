"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Each input partition is a memtable, flushed as a run of (digest, id) entries sorted by digest. Compaction goes level
by level: FAN_IN memtables merge to one run of level 1, with one row a digest (the identifier that stays, the number
of entries), and FAN_IN runs of a level merge to one of the next. From level 1 on every run has a filter, and only digests that
another run of the merge may hold are shuffled; the others move on as they are. ``add`` puts further rows into an index: their
run waits on its level until FAN_IN are there. Digests with more than one entry are hits; their texts are verified byte by byte
before any copy is dropped.

Defined results: a null text counts as empty; an empty text is a text like any other; rows that repeat
an identifier with an equal text are copies of which one stays; a null identifier loses against any
other; an empty table gives no rows; further columns are carried along and never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import MOST_BLOCKS, KeyFilter, Workspace, filter_blocks, filter_rows, flagged, key_filter, lower_ascii

#: Runs that merge at a time.
FAN_IN = 4
ROW = ["_digest", "_keep", "_entries"]


def normalised(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def kept_id(keep: str, of: str = "_id") -> Column:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    return F.min(of) if keep == "smallest" else F.max(of)


def flush(work: Workspace, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "memtables") -> DataFrame:
    """Sorted memtables (_id, _digest, _run), one an input partition, numbered round by FAN_IN squared: no shuffle."""
    entries = df.select(F.col(id_col).alias("_id"), digest_of(normalised(text_col)).alias("_digest"), (F.spark_partition_id() % FAN_IN**2).alias("_run"))
    return work.put(entries.sortWithinPartitions("_digest"), name)


def merge_memtables(work: Workspace, memtables: DataFrame, keep: str, name: str) -> DataFrame:
    """Level 1: runs of one row a digest. Partial aggregation leaves one row a digest and task, so a hot digest shuffles few rows."""
    runs = memtables.groupBy(F.expr(f"_run div {FAN_IN}").alias("_run"), "_digest").agg(kept_id(keep).alias("_keep"), F.count(F.lit(1)).alias("_entries"))
    return work.put(runs, name)


def other_filters(level: DataFrame) -> KeyFilter:
    """For each run (_run) a filter of what all other runs of the level hold."""
    blocks = filter_blocks(level.count(), MOST_BLOCKS // FAN_IN)
    own = filter_rows(level, F.col("_digest"), blocks, "_run")
    theirs = own.select("_block", F.col("_run").alias("_other"), F.col("_bits").alias("_held"))
    return KeyFilter(own.select("_run", "_block").join(theirs, "_block").where("_run != _other").groupBy("_run", "_block").agg(F.bitmap_or_agg("_held").alias("_bits")), blocks)


def merge_runs(work: Workspace, level: DataFrame, keep: str, name: str) -> DataFrame:
    """One run of the next level from the runs of ``level`` (_run and ROW, one row a digest and run)."""
    split = flagged(level, F.col("_digest"), other_filters(level), by="_run")
    alone = split.where("not _maybe").select(*ROW)
    merged = split.where("_maybe").groupBy("_digest").agg(kept_id(keep, "_keep").alias("_keep"), F.sum("_entries").alias("_entries"))
    return work.put(alone.unionByName(merged.select(*ROW)), name)


@dataclass
class MergeIndex:
    """``memtables``: every entry (_id, _digest). ``levels``: the runs that wait on level 2 and above, each one row a digest.
    ``whole``: all runs merged, by the number of flushes.

    A digest whose texts differ (none, as far as anyone knows of SHA-256) is told apart by its texts' bytes in ``entries``.
    """

    work: Workspace
    keep: str = "smallest"
    memtables: list[DataFrame] = field(default_factory=list)
    levels: list[list[DataFrame]] = field(default_factory=list)
    whole: dict[int, DataFrame] = field(default_factory=dict)

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Flush the rows of ``df`` and merge what is full."""
        k = len(self.memtables)
        self.memtables.append(flush(self.work, df, id_col, text_col, f"memtables-{k}"))
        run = merge_runs(self.work, merge_memtables(self.work, self.memtables[-1], self.keep, f"runs-{k}"), self.keep, f"level-2-{k}")
        self.work.drop(f"runs-{k}")
        for n in range(len(self.levels) + 1):
            if n == len(self.levels):
                self.levels.append([])
            self.levels[n].append(run)
            if len(self.levels[n]) < FAN_IN:
                break
            run = merge_runs(self.work, _numbered(self.levels[n]), self.keep, f"level-{n + 3}-{k}")
            self.levels[n] = []

    def level(self) -> DataFrame:
        """One row a digest of all runs."""
        runs = [run for level in self.levels for run in level]
        if len(runs) == 1:
            return runs[0]
        k = len(self.memtables)
        if k not in self.whole:
            self.whole[k] = merge_runs(self.work, _numbered(runs), self.keep, f"whole-{k}")
        return self.whole[k]

    def entries(self) -> DataFrame:
        rows = self.memtables[0]
        for more in self.memtables[1:]:
            rows = rows.unionByName(more)
        return rows.select("_id", "_digest")

    def probe(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of ``df`` whose text the index holds, with the identifier that the index keeps."""
        held = self.level()
        digests = df.select(F.col(id_col).alias("_probe"), digest_of(normalised(text_col)).alias("_digest"))
        maybe = flagged(digests, F.col("_digest"), key_filter(held, F.col("_digest"))).where("_maybe").drop("_maybe")
        return maybe.join(held, "_digest").select(F.col("_probe").alias(id_col), F.col("_keep").alias("keep_id"))


def _numbered(runs: list[DataFrame]) -> DataFrame:
    out = runs[0].withColumn("_run", F.lit(0))
    for k, run in enumerate(runs[1:], 1):
        out = out.unionByName(run.withColumn("_run", F.lit(k)))
    return out


def new_index(spark: SparkSession, keep: str = "smallest") -> MergeIndex:
    kept_id(keep)
    return MergeIndex(Workspace(spark, "merge-index"), keep)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> MergeIndex:
    index = new_index(df.sparkSession, keep)
    index.add(df, id_col, text_col)
    return index


def verify(hits: DataFrame, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Byte verification of all hits: digests whose least and greatest texts differ.

    A filter picks the texts to compare before anything is shuffled, and each task
    sends one least and one greatest text a digest, however many copies it has.
    """
    text = df.select(normalised(text_col).alias("_text")).withColumn("_digest", digest_of(F.col("_text")))
    maybe = flagged(text, F.col("_digest"), key_filter(hits, F.col("_digest"))).where("_maybe")
    ends = maybe.groupBy("_digest").agg(F.min("_text").alias("_least"), F.max("_text").alias("_greatest"))
    return ends.where("_least != _greatest").select("_digest")


def entries(index: MergeIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``, which the index was built of: _id, _digest, _keep, _entries, _stays. Exactly one row of a group stays."""
    work = index.work
    hits = work.put(index.level().where("_entries > 1"), "hits")
    collided = work.put(verify(hits, df, text_col), "collided")
    rows = index.entries().withColumn("_part", F.lit(""))
    hits = hits.withColumn("_part", F.lit(""))
    if not collided.isEmpty():  # equal digests, other bytes: the text itself is the key
        text = df.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_part")).withColumn("_digest", digest_of(F.col("_part")))
        clash = text.join(collided, "_digest", "left_semi").select("_id", "_digest", "_part")
        rows = rows.join(collided, "_digest", "left_anti").unionByName(clash)
        told = clash.groupBy("_digest", "_part").agg(kept_id(index.keep).alias("_keep"), F.count(F.lit(1)).alias("_entries")).where("_entries > 1")
        hits = work.put(hits.join(collided, "_digest", "left_anti").unionByName(told.select(*ROW, "_part")), "told")
    # What the hits' filter rules out is alone and isn't shuffled.
    split = flagged(rows, F.col("_digest"), key_filter(hits, F.col("_digest")))
    key = ["_digest", "_part"]
    held = split.where("_maybe").drop("_maybe").join(hits, key, "left")
    own = [F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_entries"), F.lit(True).alias("_stays")]
    alone = split.where("not _maybe").select("_id", "_digest", *own).unionByName(held.where("_entries is null").select("_id", "_digest", *own))
    copies = held.where("_entries is not null")
    winner = F.col("_id").eqNullSafe(F.col("_keep"))
    # Rows that repeat the winning identifier differ in nothing: they are counted, and the first of the count stays.
    counted = copies.where(winner).groupBy("_id", *key, "_keep", "_entries").agg(F.count(F.lit(1)).alias("_n"))
    first = counted.select("_id", "_digest", "_keep", "_entries", F.explode(F.expr("sequence(1L, _n)")).alias("_nth")).withColumn("_stays", F.col("_nth") == 1).drop("_nth")
    return alone.unionByName(copies.where(~winner).select("_id", "_digest", "_keep", "_entries", F.lit(False).alias("_stays"))).unionByName(first)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    index = build_index(df, id_col, text_col, keep)
    rows = entries(index, df, id_col, text_col)
    return index.work.finish(
        rows.select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_entries").alias("group_size"),
            F.col("_stays").alias("kept"),
            F.lower(F.hex("_digest")).alias("text_sha256"),
        )
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all columns. Texts without a copy are never shuffled."""
    index = build_index(df, id_col, text_col, keep)
    key = F.concat_ws(":", F.col("_id").cast("string"), F.hex("_digest")).alias("_key")
    gone = entries(index, df, id_col, text_col).where("not _stays").select(key, F.col("_id").eqNullSafe(F.col("_keep")).alias("_twin"))
    gone = index.work.put(gone.distinct(), "gone")
    index.work.keep("gone")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), digest_of(normalised(text_col)).alias("_digest"))
    split = flagged(rows.select("_row", key), F.col("_key"), key_filter(gone, F.col("_key")))
    clear = split.where("not _maybe").select("_row")
    held = split.where("_maybe").drop("_maybe").join(gone, "_key", "left")
    one = held.where("_twin").dropDuplicates(["_key"]).select("_row")
    return clear.unionByName(held.where("_twin is null").select("_row")).unionByName(one).select("_row.*")
