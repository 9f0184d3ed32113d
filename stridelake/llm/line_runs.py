"""Repeated runs of lines, found by prefix doubling over line-identifier sequences and deleted but for their first copy.

A document's sequence is its lines with a word; lines without one are no part of it, so runs go on across them, and
those between two deleted lines of a run are deleted with it. Every line that occurs more than once gets a rank in the order
of digests; suffixes of the sequences are then ranked by their first 2, 4, 8, ... lines: the rank pair of a suffix and of the suffix
half a length further on is ranked anew, over the whole corpus, until no prefix of that length repeats. Suffixes of one
rank are a longest-common-prefix interval of at least that many lines. In each interval the first suffix,
in order of identifier and line, is the original, and every other starts a later copy of it. A suffix counts with its
deepest interval, and copies that go on side by side with their original, line by line, are one run: so a run is always
one that repeats as a whole, however long, and not what copies of several originals cover together.

Runs of ``min_lines`` lines or more are deleted, and so are copies of lines of ``min_words`` words or more, each by itself; a
run inside another isn't counted. DataFrame operations only; ranks come from a range-partitioned sort, so no task sees all rows.

Defined results: a null text is empty, and has one empty line; a line ends at a line feed; rows that repeat
both identifier and text are one document and share its result; an empty table gives no rows; a null identifier
comes before all others; further columns are never read (``delete_runs`` carries them along).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, Workspace, flagged, key_filter

KEY = ["_id", "_text"]
#: A line of so many words is a passage of its own.
MIN_WORDS = 30


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _rows(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_text"), F.col(id_col).alias("_order"), *more)


def _named(work: Workspace, rows: DataFrame, pair: list[str], name: str, *more: str) -> DataFrame:
    """``rows`` whose ``pair`` occurs more than once, with an order-preserving ``rank`` of the pair and its ``first`` place."""
    place = F.struct("_order", *KEY, "line")
    groups = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("_rows"), F.min(place).alias("first")).where("_rows > 1").drop("_rows")
    ranks = groups.repartitionByRange(*pair).sortWithinPartitions(*pair).withColumn("rank", F.monotonically_increasing_id())
    ranks = work.put(ranks, f"{name}-ranks")  # written: the ranks are fixed from here on
    return work.put(rows.join(ranks, pair).select("_order", *KEY, "line", "rank", "first", *more), name)


def copied_runs(work: Workspace, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _text, runs (array of start, end, counted in lines with a word): the runs to delete of each document that has any; they may overlap."""
    if min_lines < 1 or min_words < 1:
        raise ValueError(f"min_lines and min_words must be at least 1, not {min_lines} and {min_words}")
    lines = _rows(df, id_col, text_col, F.posexplode(F.filter(_lines(F.col(text_col)), _has_word)).alias("line", "_line"))
    long = F.lit(True) if min_lines == 1 else F.regexp_count("_line", F.lit(WORD)) >= min_words
    lines = lines.select("_order", *KEY, "line", F.unhex(F.sha2("_line", 256)).alias("_digest"), long.alias("long"))
    suffixes = _named(work, work.put(lines, "lines"), ["_digest"], "level-1", "long")
    work.drop("lines", "level-1-ranks")
    length, later = 1, []
    while not suffixes.isEmpty():
        copies = suffixes.where(F.struct("_order", *KEY, "line") > F.col("first"))
        if length == 1:
            copies = copies.where("long")
        long = F.col("long") if length == 1 else F.lit(False)
        later.append(work.put(copies.select(*KEY, "line", F.struct((F.col("line") + length).alias("end"), F.col("first._id").alias("_id"), F.col("first._text").alias("_text"), (F.col("first.line") - F.col("line")).alias("shift")).alias("copy"), long.alias("long")), f"copies-{length}"))
        ahead = suffixes.select(*KEY, (F.col("line") - length).alias("line"), F.col("rank").alias("_next"))
        both = suffixes.select("_order", *KEY, "line", F.col("rank").alias("_own")).join(ahead, [*KEY, "line"])
        length *= 2
        suffixes = _named(work, both, ["_own", "_next"], f"level-{length}")
        work.drop(f"level-{length // 2}", f"level-{length}-ranks")
    if not later:
        return work.put(df.sparkSession.createDataFrame([], "_id string, _text long, runs array<struct<start: int, end: int>>"), "runs")
    found = later[0]
    for level in later[1:]:
        found = found.unionByName(level)
    deepest = found.groupBy(*KEY, "line").agg(F.max("copy").alias("copy"), F.max("long").alias("long"))
    # Side by side: the same original, as far off, and no gap.
    side = [*KEY, "copy._id", "copy._text", "copy.shift"]
    order = Window.partitionBy(*side).orderBy("line")
    opened = deepest.withColumn("_before", F.max("copy.end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = opened.withColumn("_run", F.sum(F.when(F.col("_before") >= F.col("line"), 0).otherwise(1)).over(order))
    named = [*KEY, F.col("copy._id").alias("_from"), F.col("copy._text").alias("_of"), F.col("copy.shift").alias("_shift"), "_run"]
    runs = run.groupBy(*named).agg(F.min("line").alias("start"), F.max("copy.end").alias("end"), F.max("long").alias("long")).where((F.col("end") - F.col("start") >= min_lines) | F.col("long"))
    # Inside another: one that starts no later ends no sooner.
    wide = Window.partitionBy(*KEY).orderBy("start", F.desc("end"), "_from", "_of").rowsBetween(Window.unboundedPreceding, -1)
    outer = runs.withColumn("_past", F.max("end").over(wide)).where("_past is null or _past < end")
    return work.put(outer.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs")


def _cleaned(df: DataFrame, runs: DataFrame, id_col: str, text_col: str, carried: Column) -> DataFrame:
    """_row, _lines, _kept, runs (in lines of the text) of every row; only documents that lose a line are joined."""
    key = F.concat_ws(":", F.col("_text").cast("string"), "_id").alias("_key")
    lost = runs.select(key, "runs")
    rows = _rows(df, id_col, text_col, carried.alias("_row"), F.col(text_col).alias("_whole")).select("_row", "_whole", key)
    split = flagged(rows, F.col("_key"), key_filter(lost, F.col("_key")))
    held = split.where("_maybe").drop("_maybe").join(lost, "_key", "left")
    clear = split.where("not _maybe").drop("_maybe").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    both = clear.unionByName(held.select(*clear.columns)).withColumn("_lines", _lines(F.col("_whole")))
    filled = both.withColumn("_at", F.when(F.col("runs").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _has_word(F.col("_lines")[i]))))
    both = filled.withColumn("runs", F.expr("transform(runs, r -> struct(_at[r.start] as start, _at[r.end - 1] + 1 as end))")).drop("_at")
    kept = F.when(F.col("runs").isNull(), F.col("_lines")).otherwise(F.expr("filter(_lines, (x, i) -> not exists(runs, r -> r.start <= i and i < r.end))"))
    return both.withColumn("_kept", kept)


def run_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: id, n_lines, n_deleted, n_runs, longest_run (in lines with a word), kept_sha256 (of the text that stays)."""
    work = Workspace(df.sparkSession, "line-runs")
    runs = copied_runs(work, df, id_col, text_col, min_lines, min_words)
    longest = F.array_max(F.expr("transform(runs, r -> size(filter(slice(_lines, r.start + 1, r.end - r.start), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')))"))
    out = _cleaned(df, runs, id_col, text_col, F.struct(F.col(id_col).alias("id")))
    return work.finish(
        out.select(
            F.col("_row.id").alias(id_col),
            F.size("_lines").cast("long").alias("n_lines"),
            (F.size("_lines") - F.size("_kept")).cast("long").alias("n_deleted"),
            F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long").alias("n_runs"),
            F.coalesce(longest, F.lit(0)).cast("long").alias("longest_run"),
            F.sha2(F.concat_ws("\n", "_kept"), 256).alias("kept_sha256"),
        )
    )


def delete_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the later copies deleted from its texts; a null text stays null."""
    work = Workspace(df.sparkSession, "line-runs")
    runs = copied_runs(work, df, id_col, text_col, min_lines, min_words)
    out = _cleaned(df, runs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    text = F.when(F.col("_whole").isNull(), None).otherwise(F.concat_ws("\n", "_kept"))
    work.keep("runs")
    return out.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns])
