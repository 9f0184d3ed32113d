"""Mix sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source's documents form one stream in shuffled order, cut into blocks of equally many words. A
source gets as many slots as its target fills blocks; slot cells lie side by side on a line of 2**k
cells, and point i of the van der Corput sequence visits the cells so that any run of consecutive slots
holds all sources in proportion. Slots are ranked per source; slot r of a source reads block r of its
stream, going round when the stream ends, and the last slot is cut where the target is met.

Defined results: a null text has no words; a null source is a source of its own, last in order; an
empty or wordless document is taken with 0 words; equal rows are told apart by their place in the
stream; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, Workspace, numbered, ranked

#: Cells that one row is expanded to at a time.
CHUNK = 65536
#: So many sources may be broadcast, at some 200 bytes each.
FEW_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """``sources``: _key, nth, source_size, target. ``stream``: doc_id, size, _key, _text, _mixed, rank, start.
    ``slots``: _key, slot, block, epoch, words, position (the place in the mix, ascending)."""

    work: Workspace
    sources: DataFrame
    stream: DataFrame
    slots: DataFrame
    block_words: int
    seed: int


def _measured(text_col: str, source_col: str) -> list[Column]:
    """_key (the source, null last), size (words) and _text (the text's hash)."""
    return [
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("_text"),
    ]


def _shuffled(seed: int) -> Column:
    """A row's place in its source's shuffled order."""
    return F.xxhash64("doc_id", F.lit(seed))


def source_targets(work: Workspace, sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """_key, nth, source_size and target of each source. ``weights`` repeat over the sources in order of code point.

    The words wanted are shared by weight; sources above ``most`` times their size get that, and the excess is shared by weight
    among the rest, until none is above. A round is one sum over the sources, of which there may be many.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per_source = numbered(work, sizes.groupBy("_key").agg(F.sum("size").alias("source_size")), ["_key"], "numbered")
    weighed = per_source.withColumn("_weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    weighed = work.put(weighed, "weighed")
    total, n = weighed.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    want, level, full = (total or 0) * float(share), 0.0, -1
    while n:
        above = F.col("_cap") < F.lit(level) * F.col("_weight")
        held, rest, now = weighed.agg(F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.sum(F.when(~above, F.col("_weight"))), F.sum(above.cast("int"))).first()
        if now == full or not rest:
            break
        full, level = now, (want - held) / rest
    return weighed.select("_key", "nth", "source_size", F.least(F.col("_cap"), F.lit(level) * F.col("_weight")).alias("target"))


def schedule(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The schedule of a mix of ``share`` times all words, with no source beyond ``most`` times its size."""
    work = Workspace(df.sparkSession, "mix")
    sizes = work.put(df.select(F.col(id_col).alias("doc_id"), *_measured(text_col, source_col)), "sizes")
    sources = work.put(source_targets(work, sizes, weights, share, most).withColumn("_goal", F.round("target").cast("long")), "sources")
    shuffled = sizes.withColumn("_mixed", _shuffled(seed))
    stream = work.put(ranked(shuffled, ["_key"], F.col("_mixed"), [F.col("doc_id"), F.col("_text"), F.col("size")], amount="size"), "stream")

    per_epoch = F.ceil(F.col("source_size") / block_words)
    full = F.floor(F.col("_goal") / F.col("source_size"))
    n_slots = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(full * per_epoch + F.ceil((F.col("_goal") - full * F.col("source_size")) / block_words)).cast("long")
    line = ranked(sources.withColumn("_slots", n_slots), [], F.shiftleft("nth", 62 - max(1, sources.count().bit_length())), amount="_slots", start="_cell0").drop("rank")
    total = sources.select(F.sum(n_slots)).first()[0] or 0
    bits = max(1, (max(1, total) - 1).bit_length())
    chunks = line.where("_slots > 0").withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_slots - 1) div {CHUNK})"))).repartition("_key", "_chunk")
    cells = chunks.withColumn("_cell", F.explode(F.expr(f"sequence(_chunk * {CHUNK}L, least(_slots, (_chunk + 1) * {CHUNK}L) - 1)"))).withColumn("_cell", F.col("_cell") + F.col("_cell0"))
    # Point i of the van der Corput sequence is i's bits mirrored; cell c is visited at c's bits mirrored.
    visited = cells.withColumn("position", F.conv(F.reverse(F.lpad(F.bin("_cell"), bits, "0")), 2, 10).cast("long"))
    # ranked() cuts by an order's top bits, so positions are spread over 62 of them.
    spread = F.shiftleft("position", max(0, 62 - bits))
    slots = ranked(visited.select("_key", "source_size", "_goal", "position"), ["_key"], spread, rank="slot")
    # A pass over the stream takes per_epoch slots, whose last is as short as the rest of the stream.
    slots = (
        slots.withColumn("epoch", F.floor(F.col("slot") / per_epoch))
        .withColumn("block", F.col("slot") - F.col("epoch") * per_epoch)
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words, F.col("_goal") - F.col("epoch") * F.col("source_size") - F.col("block") * block_words))
    )
    return Mix(work, sources, stream, work.put(slots.select("_key", "slot", "block", "epoch", "words", "position"), "slots"), block_words, seed)


def segments(mix: Mix) -> DataFrame:
    """The words of each block that a document holds: _key, rank, block, offset (in the block), length."""
    b = mix.block_words
    held = mix.stream.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    begin, end = F.greatest(F.col("start"), F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return held.select("_key", "rank", "doc_id", "block", (begin - F.col("block") * b).alias("offset"), (end - begin).alias("length"), (begin - F.col("start")).alias("first_word"))


def mixed_segments(mix: Mix) -> DataFrame:
    """The mix itself, in order of (position, offset): from word ``first_word`` of doc_id, ``words`` words."""
    return (
        segments(mix)
        .join(mix.slots.withColumnRenamed("words", "_limit"), ["_key", "block"])
        .withColumn("words", F.least(F.col("length"), F.col("_limit") - F.col("offset")))
        .where("words > 0")
        .select("position", "offset", "doc_id", "first_word", "words", "epoch")
    )


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    limits = mix.slots.groupBy("_key", "block").agg(F.collect_list("words").alias("_limits"))  # as many as passes: few
    got = (
        segments(mix)
        .join(limits, ["_key", "block"])
        .select("_key", "rank", F.expr("aggregate(_limits, 0L, (a, x) -> a + greatest(0L, least(length, x - offset)))").alias("_got"))
        .groupBy("_key", "rank")
        .agg(F.sum("_got").alias("_got"))
    )
    sources = mix.sources.select("_key", "source_size", "target")
    if mix.sources.count() <= FEW_SOURCES:  # else it isn't small, and a plain join serves
        sources = F.broadcast(sources)
    return mix.stream.join(got, ["_key", "rank"], "left").join(sources, "_key").select("doc_id", "size", "source_size", "target", F.coalesce("_got", F.lit(0)).alias("taken"))


def mix_sources(df: DataFrame, **options) -> DataFrame:
    mix = schedule(df, **options)
    return mix.work.finish(taken_words(mix))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, to the nearest whole document: only where a
    source's target ends does the mix cut a document. Wordless documents pass once. Rows that share
    identifier, source and text share their count.

    The schedule's last epoch reads a source's stream up to one place, so per source a number of passes and one
    place in the shuffled order tell how often any row is taken: that table has a row a source, and no text is shuffled.
    """
    mix = schedule(df, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    epochs = mix.slots.groupBy("_key", "epoch").agg(F.sum("words").alias("_words")).join(mix.sources.select("_key", "source_size"), "_key")
    whole = F.col("_words") == F.col("source_size")
    passes = epochs.groupBy("_key").agg(F.sum(whole.cast("int")).alias("_passes"), F.coalesce(F.sum(F.when(~whole, F.col("_words"))), F.lit(0)).alias("_rest"))
    place = [F.col(c) for c in ("_mixed", "doc_id", "_text", "size")]
    ended = mix.stream.where("size > 0").join(passes.where("_rest > 0"), "_key").where("start < _rest and _rest <= start + size")
    # Equal rows at the end share their count: one more if at least half of their words are taken.
    edge = ended.select("_key", "_rest", F.struct(*place).alias("_edge"))
    twins = mix.stream.join(edge, "_key").where(F.struct(*place).eqNullSafe(F.col("_edge")))
    cut = twins.groupBy("_key", "_edge").agg((2 * (F.max("_rest") - F.min("start")) >= F.sum("size")).cast("int").alias("_more"))
    cuts = mix.work.put(mix.sources.select("_key").join(passes.select("_key", "_passes"), "_key", "left").join(cut, "_key", "left"), "cuts")
    if cuts.count() <= FEW_SOURCES:  # else it isn't small, and a plain join serves
        cuts = F.broadcast(cuts)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("doc_id"), *_measured(text_col, source_col)).withColumn("_mixed", _shuffled(mix.seed))
    here = F.struct(*place)
    last = F.when(here < F.col("_edge"), 1).when(here.eqNullSafe(F.col("_edge")), F.col("_more")).otherwise(0)
    times = F.when(F.col("size") == 0, 1).otherwise(F.coalesce("_passes", F.lit(0)) + F.when(F.col("_edge").isNull(), 0).otherwise(last)).cast("int")
    out = rows.join(cuts, "_key").withColumn("_times", times).where("_times > 0")
    mix.work.keep("cuts")
    return out.withColumn("_nth", F.explode(F.expr("sequence(1, _times)"))).select("_row.*")
