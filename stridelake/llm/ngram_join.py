"""Jaccard self-join on word 5-grams by adaptive multi-match prefixes, for near-duplicate classes.

Two documents link when the Jaccard similarity of their sets of distinct shingles is at least 0.8.

1.  Equal sets fall together: a set is one node, known by a 64-bit signature.
2.  A set with more than ``n - ceil(0.8 n)`` shingles of its own can't link. Shingles of a fixed share of the
    hash space are counted over the whole corpus (least against greatest signature, so map tasks send one
    row a shingle, however common), and sets that are ruled out by these alone leave: nearly all.
3.  The others' shingles are counted in full, and each set orders its own from rare to common. Its prefix
    has ``n - ceil(0.8 n) + l`` shingles: linked sets share at least ``l`` in their prefixes. ``l`` grows with
    the estimated candidate cost of the prefix, the sum of its shingles' counts, so that sets of common
    shingles need more matches before anything is verified; a pair uses the smaller of its two l.
4.  Near copies would meet in every list of their prefixes. So each set is first compared with the centre that
    it matches most, and sets that share half with one centre are a family.
5.  Pairs of a family meet once, in cells of bounded size, not once a list: prefixes are matched and matches verified there.
6.  Pairs of different families meet in the lists, are counted, and verified if they match often enough.

So every link but those to centres, which are verified as well, comes from l matches in the prefixes, and no candidate is
dropped but by a bound. Cells return rows a set, not a pair. For components alone only members that don't link to their
centre ask in step 5, which is linear in a family of near copies; numbers of links and listed links need every
pair of different texts of a family, the former without making rows of them.

Defined results: words are runs without ASCII white space, A-Z lower-cased; with fewer than five words the
whole sequence is the one shingle; a null text or one without words has an empty set, and is linked with nothing;
rows that repeat an identifier share its least component; a null identifier comes after all others; an empty table
gives no rows; further columns are never read (``keep_one`` carries them along).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, SPACE, Spans, chained, give_back, joined, mix, returning, text_slices, words
from .components import components
from .shared import BATCH_ROWS, Workspace, flagged, key_filter

SIMILARITY = Fraction(4, 5)
SHINGLE = 5
#: The share of the hash space that step 2 counts.
COUNTED_SHARE = Fraction(1, 3)
MOST_MATCHES = 8
#: Sets and shingles of a block: a cell holds two.
BLOCK, BLOCK_TOKENS = 768, 1_000_000


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin (and, last, the length)."""
    data, starts = joined(texts)
    data = LOWER[data]
    begin, end = words(data) if not SPACE[data].all() else (np.zeros(0, np.int64),) * 2
    word = Spans(data).hash(begin, end)
    first = np.searchsorted(begin, starts)
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    at = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    left = first[1:][owner] - at  # words from here to the text's end; where they don't fill a shingle, a constant stands for the lacking ones
    hashes = chained([np.where(left > i, word[np.minimum(at + i, len(word) - 1)], np.uint64(i)) for i in range(k)]) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One signed 64-bit signature a set, 0 for an empty one."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    size = np.diff(starts)
    return np.where(size > 0, mix(sums[starts[1:]] - sums[starts[:-1]] + size.astype(np.uint64)), 0).astype(np.uint64).view(np.int64)


def _sets(df: DataFrame, id_col: str, text_col: str, columns: str, share: Fraction | None = None) -> DataFrame:
    """Per row, of: doc_id, x (the text's hash), n, s (signature), tokens (shingle hashes, with ``share`` only the least part of the hash space)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("x") if "x" in columns.split() else F.lit(0).cast("long").alias("x"))
    kinds = {"doc_id": source.schema["doc_id"].dataType.simpleString(), "x": "long", "n": "long", "s": "long", "tokens": "array<long>"}
    names = columns.split()
    limit = np.uint64(min(2**64 - 1, int(2**64 * share))) if share else None

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returning(stream):
            for part, texts in text_slices(batch, batch.column(1)):
                hashes, starts = shingle_sets(texts)
                out = {"doc_id": part.column(0), "x": part.column(2), "n": pa.array(np.diff(starts), pa.int64()), "s": pa.array(signatures(hashes, starts))}
                if "tokens" in names:
                    if limit is not None:
                        small = hashes < limit
                        starts = np.concatenate(([0], np.cumsum(small)))[starts]
                        hashes = hashes[small]
                    out["tokens"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    return source.mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in names))


def _least_overlap(n: str) -> str:
    """SQL: the least number of shingles that a set of n shares with any set it links to."""
    return f"((({n}) * {SIMILARITY.numerator} + {SIMILARITY.denominator - 1}) div {SIMILARITY.denominator})"


def _enough(overlap: str, a: str, b: str) -> str:
    """SQL: whether an overlap makes two sets of a and b shingles similar enough."""
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    return f"({overlap}) * {q} >= (({a}) + ({b}) - ({overlap})) * {p}"


def possible_nodes(work: Workspace, df: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Step 2: s, n, keep of the sets that may link. A shingle whose least and greatest signatures agree is its set's own."""
    token = _sets(df, id_col, text_col, "s tokens", COUNTED_SHARE).where("s != 0").select(F.explode("tokens").alias("t"), "s")
    own = token.groupBy("t").agg(F.min("s").alias("s"), F.max("s").alias("other")).where("s = other")
    singles = own.groupBy("s").agg(F.count(F.lit(1)).alias("own"))
    left = nodes.join(singles, "s", "left").where(f"n - coalesce(own, 0L) >= {_least_overlap('n')}")
    return work.put(left.select("s", "n", "keep", "rows"), "possible")


def prefixes(work: Workspace, sets: DataFrame) -> DataFrame:
    """Step 3: s, n, shared (shingles that others have too), own (the rest), l and pre: the prefix shingles that others have too, from rare to common."""
    rows = sets.select("s", "n", F.explode("tokens").alias("t"))
    counts = work.put(rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    common = rows.join(counts, "t")
    per_set = common.groupBy("s", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("ts")).withColumn("shared", F.size("ts")).where(f"shared >= {_least_overlap('n')}")
    base = f"(n - {_least_overlap('n')})"
    # The set's own shingles come first in its order; what is left of the prefix is `room` of the others.
    room = per_set.withColumn("own", F.expr("n - shared")).withColumn("room", F.expr(f"greatest(0L, {base} + 1 - own)"))
    cost = "aggregate(slice(ts, 1, cast(room as int)), 0L, (a, x) -> a + x.df)"
    matches = f"cast(least({MOST_MATCHES}, greatest(1, shared div 4), 1 + floor(log2(1 + {cost} / (4.0 * greatest(room, 1L)))) div 2) as int)"
    chosen = room.withColumn("l", F.expr(matches)).withColumn("pre", F.expr(f"transform(slice(ts, 1, cast(least(shared, {base} + l - own) as int)), x -> x.t)"))
    return work.put(chosen.select("s", "n", "shared", "own", "l", "pre"), "prefixes")


def postings(chosen: DataFrame) -> DataFrame:
    """t, s, n, shared, l and pos, the place of t in its set's order."""
    return chosen.select("s", "n", "shared", "own", "l", F.posexplode("pre").alias("k", "t")).select("t", "s", "n", "shared", (F.col("own") + F.col("k")).alias("pos"), "l")


def overlaps(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v, both (shared shingles of the whole sets) and similar (whether that is enough)."""
    a = sets.select(F.col("s").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    b = sets.select(F.col("s").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    found = pairs.select("u", "v").join(a, "u").join(b, "v").withColumn("both", F.size(F.array_intersect("tu", "tv")).cast("long"))
    return found.select("u", "v", "both", "nu", F.expr(_enough("both", "nu", "nv")).alias("similar"))


def families(work: Workspace, sets: DataFrame, posted: DataFrame) -> DataFrame:
    """Step 4: s, h, similar: each set's family, named by its centre h, and whether it links to the centre.

    A posting list's centre has the least shingles of its own. Of the centres that a set matches often enough, it is
    compared with that of most postings, so that near copies meet in few centres; with half of its shingles or more in
    common it joins the centre's family. A centre stays in its own unless the other has more followers.
    """
    centre = posted.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct((F.col("shared") / F.col("n")).alias("q"), "n", "s", "l")).alias("c")).where("m > 1").select("t", F.col("c.s").alias("v"), F.col("c.n").alias("nv"), F.col("c.l").alias("lv"))
    # Written first, here and below: a join of two written tables may be split where a key is hot, one that shares an aggregation's shuffle may not.
    near = posted.join(work.put(centre, "centres"), "t").where("s != v").where(_enough("least(n, nv)", "n", "nv"))
    votes = work.put(near.groupBy("s", "v").agg(F.count(F.lit(1)).alias("k"), F.first(F.least("l", "lv")).alias("least")).where("k >= least"), "votes")
    fame = work.put(votes.groupBy("v").agg(F.sum("k").alias("fame")), "fame")
    best = votes.join(fame, "v").groupBy("s").agg(F.max(F.struct("fame", "v")).alias("c")).select(F.col("s").alias("u"), F.col("c.v").alias("v"))
    met = work.put(overlaps(sets, best).where("both * 2 >= nu"), "met")
    fans = work.put(met.groupBy("v").agg(F.count(F.lit(1)).alias("fans")), "fans")
    followers = met.join(fans, "v").select(F.col("u").alias("s"), F.struct("fans", F.col("v").alias("h"), "similar").alias("c"))
    centres = fans.select(F.col("v").alias("s"), F.struct("fans", F.col("v").alias("h"), F.lit(True).alias("similar")).alias("c"))
    return work.put(followers.unionByName(centres).groupBy("s").agg(F.max("c").alias("c")).select("s", "c.h", "c.similar"), "families")


def _incidence(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of every token that several lists have, and the number of columns."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    held = count[column] > 1
    return owner[held], new[column[held]], int((count > 1).sum())


def common_tokens(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Matrix of the numbers of tokens that a list of a and one of b share; each list has distinct tokens."""
    owner, column, n = _incidence([*a, *b])
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)))
    for begin in range(0, n, width):
        i, j = np.searchsorted(column, (begin, begin + width))
        part = np.zeros((len(a) + len(b), min(width, n - begin)), np.float32)
        part[owner[i:j], column[i:j] - begin] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out.astype(np.int64)


def matching(a: list[tuple], b: list[tuple]) -> np.ndarray:
    """Which pairs share enough prefix tokens. Members are (n, own, l, pre); a pair uses the smaller of its two l."""
    la, lb = (np.array([x[2] for x in y]) for y in (a, b))
    least = np.minimum(la[:, None], lb[None, :])
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    out = np.zeros(least.shape, bool)
    for l in np.unique(least):  # noqa: E741
        cut = lambda x: x[3][: max(0, x[0] - -(-x[0] * p // q) + l - x[1])]  # noqa: B023, E731
        out |= (least == l) & (common_tokens([cut(x) for x in a], [cut(x) for x in b]) >= l)
    return out


def _cell(rows: list[dict], pairs: bool) -> list[tuple]:
    """One cell of a family: asked sets against given ones. Per set its root among these and the rows that it links to, or the links themselves."""
    asked, given = [r for r in rows if r["asked"]], [r for r in rows if r["given"]]
    if not asked or not given:
        return []
    kind = lambda r: (r["n"], r["own"], r["l"], r["pre"])
    may = matching([kind(r) for r in asked], [kind(r) for r in given])
    sa, sg = np.array([r["s"] for r in asked]), np.array([r["s"] for r in given])
    may &= sa[:, None] != sg[None, :]
    i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(i):
        return []
    asked, given, sa, sg = [asked[k] for k in i], [given[k] for k in j], sa[i], sg[j]
    both = common_tokens([r["tokens"] for r in asked], [r["tokens"] for r in given])
    p, q = SIMILARITY.numerator, SIMILARITY.denominator
    na, ng = (np.array([r["n"] for r in x]) for x in (asked, given))
    linked = may[np.ix_(i, j)] & (both * q >= (na[:, None] + ng[None, :] - both) * p)
    if pairs:
        return [(sa[x].item(), sg[y].item(), both[x, y].item()) for x, y in zip(*np.nonzero(linked)) if sa[x] < sg[y]]
    weight = np.array([r["rows"] for r in given], np.int64)
    # Least signatures spread along the links until nothing changes: a forest of the cell's links.
    root_a, root_g = sa.copy(), sg.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(root_a, np.where(linked, root_g[None, :], top).min(axis=1))
        new_g = np.minimum(root_g, np.where(linked, new_a[:, None], top).min(axis=0))
        if np.array_equal(new_a, root_a) and np.array_equal(new_g, root_g):
            break
        root_a, root_g = new_a, new_g
    out = list(zip(sa.tolist(), root_a.tolist(), (linked @ weight).tolist()))
    return [x for x in out if x[2]] + [(s, r, 0) for s, r in zip(sg.tolist(), root_g.tolist()) if s != r]


def inside(work: Workspace, family: DataFrame, sets: DataFrame, chosen: DataFrame, nodes: DataFrame, every: bool, pairs: bool = False) -> DataFrame:
    """Step 5: the links of each family, matched by prefixes and verified in cells of at most BLOCK x BLOCK sets.

    With ``every`` all members ask; else those that don't link to their centre, whose links may join components.
    Rows are s, root (its least set by the cell's links) and others (rows that s links to), or with ``pairs`` s, root
    (the other set) and others (their shared shingles).
    """
    member = family.withColumn("asked", F.lit(True) if every else ~F.col("similar"))
    whole = member.join(chosen, "s")
    size = whole.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("volume"), F.sum(F.col("asked").cast("long")).alias("m0"), F.sum(F.when(F.col("asked"), F.col("n"))).alias("volume0")).where("m > 1 and m0 > 0")
    blocks = lambda m, volume: F.expr(f"cast(ceil(greatest({m} / {BLOCK}D, {volume} / {BLOCK_TOKENS}D)) as int)")
    size = work.put(size.select("h", blocks("m0", "volume0").alias("n0"), blocks("m", "volume").alias("n1")), "cells")
    dealt = whole.join(size, "h").withColumn("o", F.expr("cast(pmod(xxhash64(s), n0) as int)")).withColumn("b", F.expr("cast(pmod(xxhash64(s), n1) as int)"))
    # A member asks in its row of cells and is given in its column; in one cell it does both.
    cells = """flatten(array(
        if(asked, transform(sequence(0, n1 - 1), j -> named_struct('i', o, 'j', j, 'asked', true, 'given', j = b)), array()),
        filter(transform(sequence(0, n0 - 1), i -> named_struct('i', i, 'j', b, 'asked', false, 'given', true)), c -> not asked or c.i != o)))"""
    placed = dealt.select("h", "s", "n", "own", "l", "pre", F.explode(F.expr(cells)).alias("c")).select("h", "c.i", "c.j", "c.asked", "c.given", "s", "n", "own", "l", "pre")
    rows = placed.join(sets.select("s", "tokens"), "s").join(nodes.select("s", "rows"), "s").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "s")

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def done(force: bool) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["s", "root", "others"])
                out.clear()

        for batch in returning(stream):
            plain = {c: batch.column(c).to_pylist() for c in ("h", "i", "j", "asked", "given", "s", "n", "own", "l", "rows")}
            lists = {}
            for c in ("pre", "tokens"):
                array = batch.column(c)
                flat, ends = array.values.to_numpy(zero_copy_only=False), array.offsets.to_numpy()
                lists[c] = [flat[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for k in range(batch.num_rows):
                now = plain["h"][k], plain["i"][k], plain["j"][k]
                if now != key:
                    out += _cell(held, pairs)
                    key, held = now, []
                    yield from done(False)
                held.append({c: x[k] for c, x in plain.items()} | {c: x[k] for c, x in lists.items()})
        out += _cell(held, pairs)
        held = []
        yield from done(True)
        give_back()

    return rows.mapInArrow(read, "s long, root long, others long")


def between(work: Workspace, posted: DataFrame, family: DataFrame) -> DataFrame:
    """Step 6: u, v: pairs of different families (or of none) with enough matches in their prefixes.

    Rows of a list's largest family meet only rows of others, and a list within one family is left out.
    """
    rows = posted.join(family.select("s", "h"), "s", "left").withColumn("h", F.coalesce("h", "s"))
    top = rows.groupBy("t", "h").agg(F.count(F.lit(1)).alias("m")).groupBy("t").agg(F.max(F.struct("m", "h")).alias("x"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("t", F.col("x.h").alias("top"))
    lists = work.put(rows.join(work.put(top, "top"), "t"), "lists")
    base = lambda x: f"({x}n - {_least_overlap(x + 'n')})"
    l = "least(a.l, b.l)"  # noqa: E741
    met = f"a.t = b.t and a.h != b.h and (b.h = b.top or a.s < b.s) and a.pos < {base('a.')} + {l} and b.pos < {base('b.')} + {l} and {_enough('least(a.shared, b.shared)', 'a.n', 'b.n')}"
    found = lists.where("h != top").alias("a").join(lists.alias("b"), F.expr(met))
    pair = [F.expr("least(a.s, b.s)").alias("u"), F.expr("greatest(a.s, b.s)").alias("v"), F.expr(l).alias("l")]
    return found.select(*pair).groupBy("u", "v", "l").agg(F.count(F.lit(1)).alias("k")).where("k >= l").select("u", "v")


@dataclass(frozen=True)
class _Join:
    """``digest``: doc_id, x, n, s of every row. ``nodes``: s, n, keep, rows of every set. The rest: of sets that may link."""

    work: Workspace
    digest: DataFrame
    nodes: DataFrame
    sets: DataFrame
    chosen: DataFrame
    family: DataFrame
    across: DataFrame


def _joined(df: DataFrame, id_col: str, text_col: str, name: str) -> _Join:
    work = Workspace(df.sparkSession, name, batch_rows=BATCH_ROWS)
    digest = work.put(_sets(df, id_col, text_col, "doc_id x n s"), "digest")
    # A null identifier comes after all others.
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "x")
    nodes = work.put(digest.where("s != 0").groupBy("s").agg(F.max("n").alias("n"), F.min(first).alias("keep"), F.count(F.lit(1)).alias("rows")), "nodes")
    possible = possible_nodes(work, df, nodes, id_col, text_col)
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    some = flagged(source, F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))), key_filter(possible, F.xxhash64("keep.doc_id", "keep.x"))).where("_maybe")
    sets = work.put(_sets(some, "doc_id", "text", "n s tokens").join(possible.select("s"), "s", "left_semi").dropDuplicates(["s"]).select("s", "n", "tokens"), "sets")
    chosen = prefixes(work, sets)
    posted = postings(chosen)
    family = families(work, sets, posted)
    across = work.put(overlaps(sets, between(work, posted, family)).where("similar").select("u", "v", "both"), "across")
    return _Join(work, digest, nodes, sets, chosen, family, across)


def _classes(df: DataFrame, id_col: str, text_col: str, links: bool, name: str = "ngram-join") -> tuple[Workspace, DataFrame]:
    """One row a row of ``df``: doc_id, x, n_shingles, class_id, n_links and first, the component's first (z, doc_id, x)."""
    j = _joined(df, id_col, text_col, name)
    work = j.work
    within = work.put(inside(work, j.family, j.sets, j.chosen, j.nodes, links), "within")
    hubs = j.family.where("similar and s != h").select(F.col("s").alias("u"), F.col("h").alias("v"))
    edges = hubs.unionByName(j.across.select("u", "v")).unionByName(within.where("s != root").select(F.col("s").alias("u"), F.col("root").alias("v")))
    rooted = components(work, edges, "components")
    # Components are told by their first row; a component's rows are pre-aggregated to one a set.
    classed = j.nodes.join(rooted.withColumnRenamed("node", "s"), "s", "left").select("s", "keep", "rows", F.coalesce("root", "s").alias("root"))
    n_links = F.lit(0).cast("long")
    if links:
        weight = j.nodes.select("s", "rows")
        ways = j.across.select(F.col("u").alias("s"), F.col("v").alias("to")).unionByName(j.across.select(F.col("v").alias("s"), F.col("u").alias("to")))
        ways = ways.join(weight.withColumnRenamed("s", "to"), "to").select("s", F.col("rows").alias("others"))
        counts = ways.unionByName(within.select("s", "others")).groupBy("s").agg(F.sum("others").alias("others"))
        classed = classed.join(counts, "s", "left")
        n_links = F.col("rows") - 1 + F.coalesce("others", F.lit(0))
    classed = work.put(classed.withColumn("n_links", n_links).select("s", "keep", "root", "n_links"), "classed")
    least = work.put(classed.groupBy("root").agg(F.min("keep").alias("first")), "firsts")
    told = work.put(classed.join(least, "root").select("s", F.col("keep.doc_id").alias("class_id"), "first", "n_links"), "classes")
    full = j.digest.where("s != 0").join(told, "s").select("doc_id", "x", F.col("n").alias("n_shingles"), "class_id", "first", "n_links")
    alone = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "x").alias("first")
    empty = j.digest.where("s = 0").select("doc_id", "x", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), alone, F.lit(0).cast("long").alias("n_links"))
    return work, full.unionByName(empty)


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the least identifier that links lead to), class_id (the least with the same set);
    with ``links`` also n_links (the other rows that this one links to itself, copies included)."""
    work, rows = _classes(df, id_col, text_col, links)
    return work.finish(rows.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), "class_id", *["n_links"] * links))


def near_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """class_a, class_b, shared, size_a, size_b: every link between different sets, by the sets' least identifiers. With class_id of
    ``near_classes`` as membership this is the whole join. As long as there are links: quadratic in a family."""
    j = _joined(df, id_col, text_col, "ngram-links")
    within = inside(j.work, j.family, j.sets, j.chosen, j.nodes, True, pairs=True).select(F.col("s").alias("u"), F.col("root").alias("v"), F.col("others").alias("both"))
    side = lambda s, x: j.nodes.select(F.col("s").alias(s), F.col("keep.doc_id").alias(f"class_{x}"), F.col("n").alias(f"size_{x}"))
    found = within.unionByName(j.across).join(side("u", "a"), "u").join(side("v", "b"), "v")
    return j.work.finish(found.select("class_a", "class_b", F.col("both").alias("shared"), "size_a", "size_b"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that come first in their components, one of each, with all columns.

    The first has the least identifier (null last); rows that share it are told apart by their texts, and of rows that
    repeat both, one stays. A row without words is a component of its own and stays, repeated or not.
    """
    work, rows = _classes(df, id_col, text_col, False, "near-dedup")
    own = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "x")
    key = F.xxhash64("doc_id", "x").alias("_key")
    # Rows to drop, and rows of which one stays: known by identifier and text, so another row of that identifier isn't touched.
    groups = rows.where("n_shingles > 0").groupBy("doc_id", "x").agg(F.max(own == F.col("first")).alias("_stays"), F.count(F.lit(1)).alias("_n")).where("not _stays or _n > 1")
    gone = work.put(groups.select(key, F.col("doc_id").alias("_id"), F.col("x").alias("_x"), "_stays"), "gone")
    work.keep("gone")
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).withColumn("_key", F.xxhash64("doc_id", "x"))
    split = flagged(source, F.col("_key"), key_filter(gone, F.col("_key")))
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("x") == F.col("_x"))
    held = split.where("_maybe").join(gone.withColumnRenamed("_key", "_gone"), (F.col("_key") == F.col("_gone")) & same, "left")
    one = held.where("_stays").dropDuplicates(["_key", "doc_id", "x"])
    return split.where("not _maybe").select("_row").unionByName(held.where("_stays is null").select("_row")).unionByName(one.select("_row")).select("_row.*")
