"""Personal data by bootstrapped contextual extraction.

Plain patterns find the certain entities (e-mail addresses, IP addresses, card and phone numbers); these are the
seeds. The words around a seed make lexical patterns, exact ones and general ones (its shape, single words, labels with
their punctuation, a gap for a word, what follows), and the same patterns around other identifier-like strings link those to
the seeds' kind. Spark scores this graph of patterns and instances in rounds. A pattern's trust in a kind is the sum of
its instances' scores for that kind, over the number of its instances of any kind and one: what stands before cards and
addresses alike tells nothing. Patterns with enough certain instances and trust vote, and an unseen instance's score is the
noisy-or of their trust. Instances above ``least_score`` are certain from the next round on, so that they make patterns
of their own. Those that end above it are personal data wherever they occur, and so are strings that spell a seed in
another way. A string without the form of a kind (a card's check digit, an address's parts) never gets that kind.

Spans are (kind, start, end) in code points, end exclusive. The seeds' spans always stay.

Defined results: a null text is empty; an empty text has no spans; equal rows get equal spans; an empty table gives
no rows; further columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .shared import Workspace

KINDS = ("email", "ip", "card", "phone")

# The certain patterns. Those that could start in the middle of a run only do so where a match has ended,
# so that long runs are read once; what is found is the same.
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_NEXT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# What else could be an identifier: number groups, long digit strings with letters, IPv6, spelled-out addresses.
_CANDIDATE = re.compile(
    r"""(?<![\w@])(?:
        [A-Za-z0-9._%+-]{1,64}\ ?(?:\[at\]|\(at\)|@|\ at\ )\ ?[A-Za-z0-9-]{1,63}(?:\ ?(?:\[dot\]|\(dot\)|\ dot\ )\ ?[A-Za-z0-9-]{2,63})+
        | [A-Za-z0-9._%+-]{1,64}\ ?(?:\[at\]|\(at\))\ ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{2,63})+
        | (?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}
        | \(?[0-9](?:[\ ().\-/]{0,2}[0-9]){6,18}
    )(?![\w@])""",
    re.X,
)
_RUN = re.compile(r"[0-9]+|[^\W0-9_]+")
_WORD = re.compile(r"\w+")
_CONTEXT = 80  # code points to either side that hold the context's words


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the certain entities, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at = 0
    while (sign := text.find("@", at)) >= 0:
        found = _EMAIL_HERE.match(text, at) or _EMAIL_NEXT.search(text, at)
        if not found:
            break
        out.append((0, found.start(), found.end()))
        at = max(found.end(), sign)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def possible_kinds(value: str) -> list[int]:
    """Kinds that an identifier-like string could be, by its form alone."""
    digits = _NOT_DIGIT.sub("", value)
    if "@" in value or re.search(r"\bat\b|[\[(]at[\])]", value):
        return [0]
    if value.count(":") >= 3:
        return [1]
    parts = value.split(".")
    ip = len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return [k for k, yes in ((1, ip), (2, 13 <= len(digits) <= 19 and luhn(digits)), (3, 7 <= len(digits) <= 15)) if yes]


def same_value(value: str) -> str:
    """What makes two strings the same identifier: the digits of a number, the lower-case letters of anything else."""
    value = " ".join(value.lower().split())
    if re.search("[a-z@:]", value) or value.count(".") == 3:
        return value
    return _NOT_DIGIT.sub("", value)


def shape(value: str) -> str:
    """Runs of digits as their length, runs of letters as one."""
    return _RUN.sub(lambda m: f"d{len(m[0])}" if m[0][0].isdigit() else "a", value)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a slot, on its line: its own shape, one to three words before it, the same with a gap, a label with
    its punctuation, one word to either side, and one or two after it. Numbers are told from words, not from each other."""
    before = text[max(0, start - _CONTEXT) : start].rpartition("\n")[2]
    after = text[end : end + _CONTEXT].partition("\n")[0]
    plain = lambda w: "0" if w.isdigit() else w
    left = [plain(w.lower()) for w in _WORD.findall(before)][-3:]
    right = [plain(w.lower()) for w in _WORD.findall(after)][:2]
    out = ["=" + shape(text[start:end])] + ["<" + " ".join(left[-k:]) for k in (1, 2, 3) if len(left) >= k]
    if len(left) >= 2:
        out.append(f"<{left[-2]} *")
    label = before[len(before.rstrip(" :=#-\"'(<[")) :].strip()
    if left and label:
        out.append(f"<{left[-1]}{label}")
    if left and right:
        out.append(f"{left[-1]}_{right[0]}")
    out += [">" + " ".join(right[:k]) for k in (1, 2) if len(right) >= k]
    return out


def slots(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[bool, int, int, str, list[int], list[str]]]]:
    """The certain spans, and (seed, start, end, value, kinds, patterns) of every seed and candidate."""
    spans = base_spans(text)
    out = [(True, a, b, same_value(text[a:b]), [k], contexts(text, a, b)) for k, a, b in spans]
    if _DIGIT.search(text) or any(sign in text for sign in ("@", "[at]", "(at)", " dot ", "[dot]", "(dot)")):
        taken = sorted((a, b) for _, a, b in spans)
        i = 0
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if any(x < b and a < y for x, y in taken[i : i + 8]):
                continue
            if kinds := possible_kinds(m[0].lower()):
                out.append((False, a, b, same_value(m[0]), kinds, contexts(text, a, b)))
    return spans, out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, spans (certain ones), slots (seeds and candidates with their patterns). Reads every text once."""
    source = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    slot = pa.list_(pa.struct([("seed", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("kinds", pa.list_(pa.int32())), ("patterns", pa.list_(pa.string()))]))

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [slots(value.as_py()) for value in batch.column(1)]
            spans = [[dict(zip(("kind", "start", "end"), x)) for x in f[0]] for f in found]
            others = [[dict(zip(("seed", "start", "end", "value", "kinds", "patterns"), x)) for x in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(others, slot)], names=["doc_id", "spans", "slots"])

    return source.mapInArrow(
        read,
        f"doc_id {source.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: int, start: long, end: long>>, "
        "slots array<struct<seed: boolean, start: long, end: long, value: string, kinds: array<int>, patterns: array<string>>>",
    )


def graph(work: Workspace, found: DataFrame) -> DataFrame:
    """pattern, value, kind, seed: the edges between patterns and instances; written once, read every round."""
    slot = found.select(F.explode("slots").alias("x")).select("x.seed", "x.value", F.explode("x.kinds").alias("kind"), "x.patterns")
    edge = slot.select(F.explode("patterns").alias("pattern"), "value", "kind", "seed")
    return work.put(edge.groupBy("pattern", "value", "kind").agg(F.max("seed").alias("seed")), "graph")


def scored(work: Workspace, edges: DataFrame, rounds: int = 3, least_score: float = 0.7, least_seeds: int = 2, least_trust: float = 0.5) -> DataFrame:
    """value, kind, score of the instances that any pattern vouches for, after all rounds.

    Only patterns of unseen instances are followed. Sums over patterns are aggregated before they are shuffled, and a
    general pattern with very many instances is one row when it meets them.
    """
    asked = edges.groupBy("pattern").agg(F.max((~F.col("seed")).cast("int")).alias("asks"), F.count_distinct("value").alias("n")).where("asks = 1").select("pattern", "n")
    # Both sides are written, so that Spark may split the join where a pattern is hot.
    edges = work.put(edges.join(work.put(asked, "patterns"), "pattern"), "asked")
    unseen, scores = edges.where("not seed"), None
    for k in range(rounds):
        held = edges.withColumn("score", F.col("seed").cast("double"))
        if scores is not None:
            known = scores.select("value", "kind", F.when(F.col("score") >= least_score, 1.0).otherwise(F.col("score")).alias("found"))
            held = held.join(known, ["value", "kind"], "left").withColumn("score", F.greatest("score", F.coalesce("found", F.lit(0.0))))
        trust = held.groupBy("pattern", "kind").agg((F.sum("score") / (F.max("n") + 1)).alias("trust"), F.sum((F.col("score") >= 1).cast("int")).alias("certain"))
        trust = work.put(trust.where((F.col("certain") >= least_seeds) & (F.col("trust") >= least_trust)).select("pattern", "kind", "trust"), f"trust-{k}")
        voted = unseen.select("pattern", "value", "kind").join(trust, ["pattern", "kind"])
        # Rounded, as the order of a sum is not fixed.
        scores = work.put(voted.groupBy("value", "kind").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("trust")))), 9).alias("score")), f"scores-{k}")
    return scores


def discovered(work: Workspace, found: DataFrame, least_score: float = 0.7, **options) -> DataFrame:
    """value, kind of unseen identifiers that the pattern graph is sure of, or that spell a seed in another way."""
    edges = graph(work, found)
    scores = scored(work, edges, least_score=least_score, **options)
    slot = found.select(F.explode("slots").alias("x")).select("x.seed", "x.value", F.explode("x.kinds").alias("kind")).groupBy("value", "kind").agg(F.max("seed").alias("seen"), F.max(~F.col("seed")).alias("unseen"))
    spelled = slot.where("seen and unseen").select("value", "kind", F.lit(1.0).alias("score"))
    best = scores.where(F.col("score") >= least_score).unionByName(spelled).groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("x"))
    return work.put(best.select("value", (-F.col("x.col2")).alias("kind")), "discovered")


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (kind, start, end) by kind and start; kind is an index of KINDS."""
    work = Workspace(df.sparkSession, "pii")
    found = work.put(scan(df, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "scan")  # written: the numbers are fixed
    unseen = discovered(work, found, **options)
    places = found.select("_row", F.explode("slots").alias("x")).where("not x.seed").select("_row", F.col("x.value").alias("value"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))
    new = places.join(unseen, "value").groupBy("_row").agg(F.collect_list(F.struct(F.col("kind").cast("int").alias("kind"), "start", "end")).alias("new"))
    spans: ArrayType = found.schema["spans"].dataType
    added = F.coalesce(F.col("new").cast(spans), F.array().cast(spans))
    return work.finish(found.join(new, "_row", "left").select("doc_id", F.sort_array("spans").alias("base"), F.sort_array(F.concat("spans", added)).alias("spans")))


def _written(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({column}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of what find_spans() returns."""
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_written("base")), 256).alias("base_sha256"), F.expr(_written("spans")).alias("spans"))


def redact(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in square brackets. Identifiers must be unique."""
    names = ", ".join(f"'[{k}]'" for k in KINDS)
    spans = found.where("size(spans) > 0").select(F.col("doc_id").alias("_id"), F.expr("array_sort(transform(spans, x -> struct(x.start as start, x.end as end, x.kind as kind)))").alias("_spans"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(spans, "_id", "left")
    step = f"if(x.start < a.at, a, struct(concat(a.done, substring(_text, a.at + 1, cast(x.start as int) - a.at), element_at(array({names}), x.kind + 1)) as done, cast(x.end as int) as at))"
    text = F.expr(f"if(_spans is null, _text, aggregate(_spans, struct('' as done, 0 as at), (a, x) -> {step}, a -> concat(a.done, substring(_text, a.at + 1))))")
    return rows.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns])
