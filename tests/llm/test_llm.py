"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, empty and long texts, ties and clashing columns."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stridelake.llm import bytewords, exact_dedup, gam, html_paths, line_runs, mixing, ngram_join, packing, pii, transport_stream, warc_bundle
from stridelake.llm.queries import ORACLES, QUERIES
from stridelake.llm.shared import Workspace, flagged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names operators use inside.
CLASH = ["_id", "_row", "_text", "_digest", "_key", "rank", "size", "s", "n", "t", "score", "kept", "block", "runs", "_maybe", "spans"]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau", "mu"]) + str(rng.randrange(60)) for _ in range(n))


def corpus():
    rng = random.Random(7)
    base = words(rng, 150)
    texts = [None, "", " \n\t ", "one two", "One two", "a b c d e", "word " * 3000, "x" * 50_000, base, base.upper(), base, "é" * 10 + " Ünï", "É" * 10 + " Ünï"]
    for _ in range(40):  # a family of near copies
        w = base.split()
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [words(rng, rng.randrange(1, 200)) for _ in range(40)]
    passage = words(rng, 60)
    texts += [passage + " " + words(rng, rng.randrange(5, 30)) for _ in range(30)]
    rows = [(i, t, rng.choice(["a", "b", None, "Ω"]), "en") for i, t in enumerate(texts)]
    return rows + [rows[8], rows[3], (None, "one two", "a", None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(corpus(), "doc_id long, text string, source string, lang string")
    return plain.withColumns({c: F.lit("clash") for c in CLASH}).repartition(5).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs, empty):
    rows = corpus()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    got = exact_dedup.duplicate_groups(docs, keep="largest").collect()
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want.update((i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.deduplicate(docs, keep="smallest")
    assert kept.columns == docs.columns
    assert Counter(lower(r.text) for r in kept.select("text").collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    index = exact_dedup.build_index(docs.where("doc_id < 9"))
    assert {r.doc_id: r.keep_id for r in index.probe(docs.where("doc_id in (4, 9, 20)")).collect()} == {4: 3, 9: 8}
    with pytest.raises(ValueError):
        exact_dedup.kept_id("newest")


def test_merge_index_takes_further_memtables(spark, docs):
    rows = [(i, t) for i, t, *_ in corpus()]
    index = exact_dedup.new_index(spark)
    parts = [[r for k, r in enumerate(rows) if k % 5 == j] for j in range(5)]
    for j, part in enumerate(parts):
        index.add(spark.createDataFrame(part, "doc_id long, text string").repartition(3))
        assert sum(map(len, index.levels)) == (j + 1 if j < 3 else j - 2) and [len(x) for x in index.levels][-1] >= 1
        groups = defaultdict(list)
        for i, t in (r for p in parts[: j + 1] for r in p):
            groups[hashlib.sha256(lower(t).encode()).digest()].append(i)
        want = {d: (min((i for i in ids if i is not None), default=None), len(ids)) for d, ids in groups.items()}
        assert {bytes(r._digest): (r._keep, r._entries) for r in index.level().collect()} == want
    split = flagged(index.levels[0][0].withColumn("_run", F.lit(0)).unionByName(index.levels[1][0].withColumn("_run", F.lit(1))), F.col("_digest"), exact_dedup.other_filters(exact_dedup._numbered([index.levels[0][0], index.levels[1][0]])), by="_run")
    assert split.where("not _maybe").count() > 0 < split.where("_maybe").count()  # only what the runs may share is merged
    everything = spark.createDataFrame(rows, "doc_id long, text string")
    assert exact_dedup.entries(index, everything).where("_stays").count() == len({lower(t) for _, t in rows})


def shingles(text):
    w = WORD.findall(lower(text))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def near_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)].append(i)
    return Counter((i, len(x), min(least[find(a)]) if x else i) for a, (i, x) in enumerate(sets))


def test_ngram_join(docs, empty):
    got = ngram_join.near_classes(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_components(corpus())
    assert ngram_join.near_classes(empty).count() == 0
    kept = ngram_join.keep_one(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _, c in near_components(corpus()) if i is not None and i == c}


def test_ngram_join_counts_every_link(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    for n in (40, 90, 200):  # families that drift: some members link to their neighbours only
        w = words(rng, n).split()
        for _ in range(25):
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = f"drift{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(w[rng.randrange(6) :])))
    sets = [shingles(t) for _, t in rows]
    want = Counter((i, sum(1 for b, y in enumerate(sets) if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y))) for a, ((i, _), x) in enumerate(zip(rows, sets)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter((r.doc_id, r.n_links) for r in ngram_join.near_classes(df, links=True).collect()) == want
    assert ngram_join.near_classes(df.limit(0), links=True).count() == 0


def test_ngram_join_tells_sets_by_the_whole_signature(spark, monkeypatch):
    whole = ngram_join.signatures
    monkeypatch.setattr(ngram_join, "signatures", lambda hashes, starts: np.where(np.diff(starts) > 0, (whole(hashes, starts) >> 48 << 48) | 5, 0))
    base = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"x{k}" for k in range(30)))]
    got = ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_ngram_join_lists_links_in_cells_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rng = random.Random(6)
    base = words(rng, 140).split()
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(140)] = f"edit{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"{words(rng, 30)} {' '.join(base[:20])}") for i in range(10)]  # a shared passage, no link
    least, sets = {}, {}
    for i, t in rows:
        sets.setdefault(shingles(t), i)
        least[i] = sets[shingles(t)]
    kinds = list(sets.items())
    want = {(i, j, len(x & y)) for x, i in kinds for y, j in kinds if i < j and 100 * len(x & y) >= 80 * len(x | y)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_links(df).collect()
    assert {(min(r.class_a, r.class_b), max(r.class_a, r.class_b), r.shared) for r in got} == want and len(got) == len(want) > 50
    classes = ngram_join.near_classes(df, links=True).collect()
    assert {r.doc_id: r.class_id for r in classes} == least
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in classes) == near_components([(*r, None, None) for r in rows])
    size = Counter(least.values())
    links = Counter()
    for i, j, _ in want:
        links[i] += size[j]
        links[j] += size[i]
    assert {r.doc_id: r.n_links for r in classes} == {i: size[least[i]] - 1 + links[least[i]] for i in least}


def test_keep_one_goes_by_rows(spark):
    text = words(random.Random(1), 40)
    rows = [(3, text), (5, text + " more"), (5, "an unrelated text of some more words"), (3, text), (7, None), (7, None), (None, text), (None, "alone here")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[4], rows[5], rows[7]])


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_words_that_defeat_polynomial_hashes(spark, n):
    tokenizers = pytest.importorskip("tokenizers")
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, _ = ngram_join.shingle_sets([a.encode(), b.encode()])
    assert hashes[0] != hashes[1]
    tokenizer = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    got = packing.WordIds(packing.default_tokenizer()).encode([a.encode(), b.encode(), a.encode()])
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b, a)]


def test_span_hashes_and_comparisons():
    rng = random.Random(9)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(400)] * 2
    data, starts = bytewords.joined(parts)
    spans = bytewords.Spans(data)
    begin, end = starts[:-1], starts[1:] - 1
    hashes = spans.hash(begin, end)
    assert len({*hashes.tolist()}) == len({*parts}) and (hashes[:400] == hashes[400:]).all()
    assert spans.equal(begin[:400], end[:400], begin[400:], end[400:])
    for k in range(0, 400, 7):
        for m in range(k, 400, 31):
            assert spans.equal(begin[[k]], end[[k]], begin[[m]], end[[m]]) == (parts[k] == parts[m])


def test_words_of_one_hash_go_to_the_tokenizer_whole(monkeypatch):
    monkeypatch.setattr(bytewords.Spans, "hash", lambda self, begin, end: (end - begin).astype(np.uint64))
    encoder = packing.WordIds(packing.default_tokenizer())
    texts = ["one two six", "abc"]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_shingle_hashes_match_sets():
    texts = ["", "a b", "A  b\tc\nd e f", "x y z", "w " * 40]
    hashes, starts = ngram_join.shingle_sets([t.encode() for t in texts])
    assert [b - a for a, b in zip(starts, starts[1:])] == [len(shingles(t)) for t in texts]
    assert len(set(ngram_join.signatures(hashes, starts)[1:4])) == 3 and ngram_join.signatures(hashes, starts)[0] == 0


def test_mixing(docs, empty):
    def run():
        return mixing.mix_sources(docs, block_words=64).toPandas()

    got = run()
    size = Counter()
    for _, t, s, _ in corpus():
        size[s] += len(WORD.findall(t or ""))
    order = sorted(x for x in size if x is not None) + [None]
    weight = dict(zip(order, [5, 2, 1, 5]))
    target, fixed, want = {}, set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest = want - sum(2 * size[s] for s in fixed)
        target = {s: 2.0 * size[s] if s in fixed else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    by_size = {size[s]: target[s] for s in order}
    for total, part in got.groupby("source_size"):
        assert part.target.iloc[0] == pytest.approx(by_size[total]) and abs(part.taken.sum() - by_size[total]) <= 1
    assert (got.taken <= 2 * got["size"]).all() and len(got) == len(corpus())
    columns = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(columns, ignore_index=True), run().sort_values(columns, ignore_index=True))
    assert mixing.mix_sources(empty).count() == 0
    mix = mixing.schedule(docs, block_words=64)
    parts = mixing.mixed_segments(mix).toPandas()
    assert parts.words.sum() == got.taken.sum()
    slots = mix.slots.orderBy("position").toPandas()
    half = slots.iloc[: len(slots) // 2]  # any stretch holds the sources in proportion
    share, whole = half.groupby("_key").size() / len(half), slots.groupby("_key").size() / len(slots)
    assert (share - whole).abs().max() < 0.05
    applied = mixing.apply_mix(docs, block_words=64)
    assert applied.columns == docs.columns
    taken = Counter()
    for r in applied.select("source", "text").collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
    longest = {s: max(len(WORD.findall(t or "")) for _, t, x, _ in corpus() if x == s) for s in size}
    assert all(abs(taken[s] - by_size[size[s]]) <= longest[s] / 2 + 1 for s in size)
    assert mixing.apply_mix(empty).count() == 0


def test_what_each_document_gives_to_the_mix(spark, docs):
    mix = mixing.schedule(docs, block_words=32)
    goal = {r._key: (r._goal, r.source_size) for r in mix.sources.collect()}
    stream = defaultdict(list)
    for r in mix.stream.collect():
        stream[r._key].append((r.rank, r.start, r.size, r.doc_id))
    want = Counter()
    for key, rows in stream.items():
        at, (words_wanted, total) = 0, goal[key]
        for _, start, size, doc in sorted(rows):
            assert start == at  # one stream, gapless
            at += size
            taken = 0 if not total else words_wanted // total * size + min(max(words_wanted % total - start, 0), size)
            want[doc, size, taken] += 1
        assert at == total
    got = mixing.taken_words(mix).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == want
    # The order of slots: cells side by side, visited at their mirrored numbers.
    slots = mix.slots.collect()
    bits = max(1, (len(slots) - 1).bit_length())
    cells = [r._key for r in sorted(slots, key=lambda r: int(format(r.position, f"0{bits}b")[::-1], 2))]
    assert cells == sorted(cells) and len({r.position for r in slots}) == len(slots)
    for key, rows in stream.items():
        own = sorted((r.position, r.slot) for r in slots if r._key == key)
        assert [s for _, s in own] == list(range(len(own)))


def test_apply_mix_goes_by_source_and_text(spark):
    rows = [(1, "a b c d", "A"), (1, "w x y z", "B"), (1, "p q r s", "B"), (2, "one two", None), (2, "one two", None), (3, None, "A"), (None, "k l m n", "B")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(map(tuple, mixing.apply_mix(df).collect()))
    want = {r.doc_id: r for r in mixing.mix_sources(df.where("doc_id = 2")).collect()}
    assert got[rows[0]] == 2 and got[rows[5]] == 1 and max(got.values()) <= 4 and want[2].taken <= 4
    per_row = {(r.doc_id, r.size, r.source_size): r.taken for r in mixing.mix_sources(df).collect()}
    assert per_row[1, 4, 4] == 8
    b = sum(n for r, n in got.items() if r[2] == "B") * 4
    target = next(r.target for r in mixing.mix_sources(df).collect() if r.source_size == 12)
    assert abs(b - target) <= 2 and got == Counter(map(tuple, mixing.apply_mix(df.repartition(3)).collect()))


def test_best_fit_plan_equals_best_fit_on_documents():
    rng = random.Random(1)
    for _ in range(60):
        cap = rng.choice([8, 20, 64])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 200))]
        runs, n = packing.plan_best_fit(Counter(lengths), cap)
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(cap - x)
        assert n == len(rooms)
        places = [(r.sequence0 + k // r.per_sequence, r.offset0 + k % r.per_sequence * r.length, r.length) for r in runs for k in range(r.count)]
        assert Counter(p[2] for p in places) == Counter(lengths)
        ends = defaultdict(int)
        for s, at, length in sorted(places):
            assert ends[s] == at
            ends[s] = at + length
        assert all(e <= cap for e in ends.values())
    with pytest.raises(ValueError):
        packing.plan_best_fit({9: 1}, 8)


def test_packing(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = packing.default_tokenizer()
    tokenizer = tokenizers.Tokenizer.from_file(path)
    import zlib

    got = packing.pack_documents(docs, max_tokens=256).toPandas()
    want = Counter()
    for i, t, *_ in corpus():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for p, a in enumerate(range(0, len(ids), 256)))
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.to_numpy() == np.concatenate(([0], np.cumsum(part.length)[:-1]))).all() and part.length.sum() <= 256
    assert got.sequence_id.nunique() == packing.plan_best_fit(Counter(got.length.tolist()), 256)[1]
    assert packing.pack_documents(empty).count() == 0


def test_word_ids_equal_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    encoder = packing.WordIds(packing.default_tokenizer())
    tokenizer = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(3)
    odd = ["", "don't can't!'s 's A1B2 ١٢ é. …!a! ﬁ x²", "<|endoftext|> a<|startoftext|>b", "日本語。abc 😀😀!", "x\x1cy\x85z\xa0q"]
    odd += ["".join(rng.choice("ab'.,!1 \n\té…²A") for _ in range(14)) for _ in range(300)]
    for t in odd:
        assert encoder.encode([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert [x.tolist() for x in encoder.encode([t.encode() for t in odd if "<|" not in t])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in odd if "<|" not in t]


def test_transport_stream(docs, empty):
    got = {r.doc_id: r for r in transport_stream.store_and_probe(docs.where("doc_id is not null")).collect()}
    for i, t, *_ in corpus():
        if i is None:
            continue
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert "cc=0;damaged=0" in r.feature and r.media_bytes % 188 == 0
    assert got[7].ticks == [transport_stream.unit_ticks(k) for k in range(len(got[7].ticks))] and len(got[7].access_offsets) == 2 and got[7].access_offsets[0] % 188 == 0
    assert got[8].media_sha256 == got[10].media_sha256 and got[8].feature == got[10].feature
    assert transport_stream.store_and_probe(empty).count() == 0
    points = transport_stream.access_points(transport_stream.store_texts(docs.where("doc_id = 7"))).where("random_access").collect()
    assert [p.unit for p in points] == [0, 8] and points[1].ticks == transport_stream.unit_ticks(8)


def test_transport_stream_faults():
    payload = random.Random(0).randbytes(9000 // 64 * 64)
    media = bytearray(transport_stream.mux(payload))
    assert transport_stream.demux(bytes(media)).samples == payload
    lost = bytes(media[: 10 * 188] + media[11 * 188 :])
    found = transport_stream.demux(lost)
    assert found.continuity_errors == 1 and found.damaged == 1 and found.samples != payload
    media[5 * 188] = 0
    assert transport_stream.demux(bytes(media)).damaged >= 1
    media[10] ^= 255  # in the program association table
    assert transport_stream.demux(bytes(media)).samples == b""
    assert transport_stream.demux(b"").units == []


def test_warc(spark):
    rows = [(5, "http://a/5", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "http://a/1 b\n", None), (2, "u", ""), (4, "u", "é" * 4000), (3, "again", "<p>x</p>"), (7, "u", "<p>only</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in CLASH}).repartition(2)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundle.archive_and_read(pages).collect())
    x, none, long, only = (t.encode() for t in ("<p>x</p>", "", "é" * 4000, "<p>only</p>"))
    d = warc_bundle.payload_digest
    assert got == Counter([(3, 8, d(x), "response", None)] * 2 + [(5, 8, d(x), "revisit", 3), (9, 8, d(x), "revisit", 3), (1, 0, d(none), "response", None), (2, 0, d(none), "revisit", 1), (4, 8000, d(long), "response", None), (7, 11, d(only), "response", None)])
    assert all(r.record_type == "response" for r in warc_bundle.archive_and_read(pages, revisit_bytes=9).collect())
    assert warc_bundle.archive_and_read(pages.limit(0)).count() == 0
    bundles = warc_bundle.write_bundles(Workspace(spark, "t"), pages, frame_bytes=300)
    back = {r.page_id: bytes(r.payload) for r in warc_bundle.read_bundles(bundles, with_payload=True).where("record_type = 'response'").collect()}
    assert back == {"3": x, "1": none, "4": long, "7": only}
    index = warc_bundle.record_index(bundles).collect()
    contents = [bytes(r.content) for r in bundles.collect()]
    assert len(index) == len(rows) and max(r.frame for r in index) >= 1
    reader = next(b for b in map(warc_bundle.BundleReader, contents) if any(u == "urn:page:4" for u, *_ in b.index()))
    assert warc_bundle.parse_record(reader.record("urn:page:4"))[1] == long
    with pytest.raises(KeyError):
        reader.record("urn:page:77")
    for broken in (b"", contents[0][:-3], contents[0][5:]):
        with pytest.raises(ValueError):
            warc_bundle.BundleReader(broken)
    holed = bytearray(contents[0])
    holed[20] ^= 255
    with pytest.raises(ValueError):
        warc_bundle.BundleReader(bytes(holed)).frame(0)


def test_warc_identifiers_of_any_kind(spark):
    ids = ["None", None, "a\tb\nc", "", "é <x>", "urn:page:1", "100%", None]
    pages = spark.createDataFrame([(x, "u", f"<p>{k}</p>") for k, x in enumerate(ids)] + [(None, "u", "<p>0</p>")], "page_id string, url string, html string")
    got = warc_bundle.archive_and_read(pages).collect()
    assert Counter(r.page_id for r in got) == Counter([*ids, None])
    assert [r.refers_to for r in got if r.record_type == "revisit"] == ["None"]
    index = warc_bundle.record_index(warc_bundle.write_bundles(Workspace(spark, "t"), pages)).collect()
    assert Counter(r.page_id for r in index) == Counter([*ids, None])
    numbered = spark.createDataFrame([(None, "u", "x"), (2, "u", "x"), (None, "u", None)], "page_id long, url string, html string")
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in warc_bundle.archive_and_read(numbered).collect()) == Counter([(2, "response", None), (None, "revisit", 2), (None, "response", None)])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies, as all do.</div><div id="content"><h1>Head &amp line</h1>
<p>First   paragraph, with a <b>bold</b> word; and more of it.<script>if (a<b) "</p>"</script><p>Second&nbsp;one<br>goes on, for a while, and ends here.
<ul><li>one<li>two</ul><form><input name=q>Search</form></div><aside>Also read</aside><section class="comments"><p>Nice, very nice, I like it a lot.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_html(spark):
    assert html_paths.main_text(PAGE) == "Head & line\nFirst paragraph, with a bold word; and more of it.\nSecond one goes on, for a while, and ends here.\none\ntwo"
    cases = {None: "", "": "", "just text": "just text", "<nav>only a menu</nav>": "", "<p>a<p>b": "a\nb", '<p title="open>x</p><p>y': "x\ny", "3 < 4 <b": "3 < 4", "<div><!-- c -->ok<!-- open": "ok", "<p>" + "w " * 60000: ("w " * 60000).strip()}
    for source, text in cases.items():
        assert html_paths.main_text(source or "") == text
    pages = spark.createDataFrame([(i, None, s) for i, s in enumerate(cases)], "page_id long, url string, html string").withColumns({c: F.lit(0) for c in CLASH})
    got = {r.page_id: (r.text, r.n_chars) for r in html_paths.extract(pages).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(cases.values())} and html_paths.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 10, 100])
@pytest.mark.parametrize("page", ["<article><h1>Head</h1><div class=body>{}</div><section>Short end.</section></article>", "<h1>Head</h1><div class=body>{}</div><div class=end><p>Another one ends it, as well it may.</div>"])
def test_html_keeps_the_parts_beside_a_long_one(page, n):
    lines = html_paths.main_text("<html><body>" + page.format("<p>A long sentence, that goes on." * n)).split("\n")
    assert lines[0] == "Head" and lines[1 : n + 1] == ["A long sentence, that goes on."] * n and lines[n + 1 :] in (["Short end."], ["Another one ends it, as well it may."])


@pytest.mark.parametrize("n", [40, 1000])
def test_html_paths_are_smoothed_on_pages_of_any_size(n):
    rng = random.Random(n)
    source = "".join("".join(f"<div class={rng.choice('pqrs')}>" for _ in range(d)) + "Some text, and more. " * rng.randrange(1, 9) + "</div>" * d for d in (rng.randrange(12) for _ in range(n)))
    page = html_paths.Page(source)

    def way(p):
        return () if p <= 0 else (*way(page.parent[p]), p)

    rows = defaultdict(list)
    for path, _, text in page.nodes:
        rows[path].append((len(text), len(html_paths.PUNCTUATION.findall(text))))
    assert (len(rows) > 200) == (n > 200)
    weight = {p: math.sqrt(len(x)) for p, x in rows.items()}
    mean = {p: [sum(y) / len(x) for y in zip(*x)] for p, x in rows.items()}
    ways = {p: way(p) for p in rows}
    got = html_paths.path_scores(page)
    assert got.keys() == rows.keys()
    for p in list(rows)[:60]:
        w = {o: weight[o] * html_paths.NEAR ** (len(ways[p]) + len(ways[o]) - 2 * len(os.path.commonprefix([ways[p], ways[o]]))) for o in rows}
        text, marks = (sum(w[o] * mean[o][k] for o in rows) / sum(w.values()) for k in (0, 1))
        assert got[p][0] == pytest.approx(text * math.log1p(marks) + math.log1p(text), rel=1e-9)


def test_html_of_other_languages_and_long_references():
    text = html_paths.main_text
    assert text('<p>first</p><svg class="icon"/><p>second</p>') == "first\nsecond"
    assert text("<p>a <svg><g><svg/><text>no</text></g></svg> b</p>") == "a b" and text("<p>a</p><math><mi>x</mi><p>b</p>") == "a\nb"
    assert text("<p>a</p><svg><foreignObject><p>no</p></foreignObject></svg><p>b</p>") == "a\nb" and text("<p>a</p><svg>") == "a"
    for n in (8, 5000):
        assert text(f"<p>x &#{'9' * n}; y &#{'0' * n}65; z") == "x \ufffd y A z"
    assert text("<p>&#65 &#; &#x41; &# &amp;#65;") == "A &#; A &# &#65;"


def test_deep_pages_are_read_in_linear_time():
    import time

    begun = time.process_time()
    deep = "<div>" * 20_000 + "Deep text, as it is." + "<p>more.</div>" * 20_000
    assert html_paths.main_text(deep).startswith("Deep text, as it is.\nmore.\nmore.")
    assert html_paths.main_text("<ul><li>" * 20_000 + "x") == "x"
    assert time.process_time() - begun < 8


def test_classifier(spark, docs, empty, monkeypatch):
    rng = random.Random(5)
    good = [(i, words(rng, 80).capitalize() + ".") for i in range(300)]
    bad = [(1000 + i, " | ".join(rng.choice(["BUY", "NOW", "$$$"]) for _ in range(80))) for i in range(100)]
    rows = spark.createDataFrame(good + bad + [(5000, None), (5000, ""), (5001, "z" * 200_000)], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(1, None, 0), (2, 1, 1), (9999, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = gam.classify(rows, labels, rounds=20).toPandas()
    held = got[got.held_out & (got.doc_id < 5000)]
    assert len(held) > 40 and (held.predicted == (held.doc_id < 1000)).mean() == 1 and got.score.between(0, 1).all() and len(got) == 403
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    columns = ["doc_id", "score"]
    pd.testing.assert_frame_equal(got[columns].sort_values(columns, ignore_index=True), gam.classify(rows, labels, rounds=20).toPandas()[columns].sort_values(columns, ignore_index=True))
    kept = gam.keep_good(rows.where("doc_id < 5000"), labels, rounds=20)
    assert kept.columns == rows.columns and kept.count() == 300
    unlabelled = gam.classify(docs, labels.limit(0)).toPandas()
    assert (unlabelled.score == 0.5).all() and len(unlabelled) == len(corpus())
    assert gam.classify(empty, labels).count() == 0
    again = spark.createDataFrame([(1, f"One of {k} rows of the same identifier.") for k in range(50)] + good + bad, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(gam, "fit", lambda x, y, whole=gam.fit, **options: seen.append(len(x)) or whole(x, y, **options))
    gam.train(again, labels, max_rows=30, rounds=2)
    assert 25 <= seen[0] <= 30


def test_features_are_counts():
    texts = ["", "One two, two!", "A b c\nA b c\nd | e", "é É ß 12", "x" * 300 + " " + "y" * 300, "  \n "]
    got = gam.features([t.encode() for t in texts])
    column = {name: got[:, k] for k, name in enumerate(gam.FEATURES)}
    for k, t in enumerate(texts):
        raw, ws, lines = t.encode(), WORD.findall(t), t.split("\n")
        n = max(len(raw), 1)
        pairs = {(a, b) for a, b in zip(ws, ws[1:])}
        want = {
            "upper": sum(65 <= b <= 90 for b in raw) / n, "lower": sum(97 <= b <= 122 for b in raw) / n, "digit": sum(48 <= b <= 57 for b in raw) / n, "line": raw.count(b"\n") / n, "bar": raw.count(b"|") / n,
            "log_words": math.log1p(len(ws)), "word_length": sum(len(w.encode()) for w in ws) / max(len(ws), 1), "distinct_words": len(set(ws)) / max(len(ws), 1),
            "capital_words": sum("A" <= w[0] <= "Z" for w in ws) / max(len(ws), 1), "distinct_lines": len(set(lines)) / len(lines), "distinct_pairs": (len(pairs) + 1) / max(len(ws), 1),
        }
        for name, value in want.items():
            assert column[name][k] == pytest.approx(value), (name, t)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000], rounds=10)
    assert ((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() > 0.9
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.-+% 0()_é9") for _ in range(24))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 100_000, "+1 " * 50_000):
        pii.slots(text)


def test_contextual_pii(spark, empty):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 5)} please call me at +1 (555) 010-{1000 + i} or mail x{i}@mail.example.com today") for i in range(12)]
    rows += [(50, "so please call me at 555 867 5309 or not"), (51, "number 555 867 5309 again, ünï 20240101"), (52, "spelled 1.555.010.1003 here"), (53, None), (54, ""), (53, None), (55, "4111 1111 1111 1111 and 10.0.0.1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    found = pii.find_spans(df)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    for i, t in rows:
        base = plain_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == n for x in base) for n in range(4)]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))
    start = rows[12][1].index("555")
    assert got[50].spans == f"phone:{start}:{start + 12}"  # the seeds' context found it
    assert got[51].spans == "phone:7:19"  # and it is the same number elsewhere
    assert got[53].spans == got[54].spans == "" and found.count() == len(rows)
    assert pii.redact(df.where("doc_id = 55"), found.dropDuplicates(["doc_id"])).first().text == "[card] and [ip]"
    assert pii.find_spans(empty).count() == 0


def brute_scores(rows, rounds=3, least_score=0.7, least_seeds=2, least_trust=0.5):
    edges, seeds = defaultdict(set), set()
    for _, t in rows:
        for seed, _, _, value, kinds, patterns in pii.slots(t or "")[1]:
            for k in kinds:
                if seed:
                    seeds.add((value, k))
                for p in patterns:
                    edges[p].add((value, k, seed))
    scores = {}
    for _ in range(rounds):
        votes = defaultdict(list)
        for found in edges.values():
            certain_here = {(v, k) for v, k, seed in found if seed}
            if all((v, k) in certain_here for v, k, _ in found):
                continue
            n = len({v for v, _, _ in found})
            for kind in {k for _, k, _ in found}:
                value = {v: 1.0 if (v, kind) in certain_here or scores.get((v, kind), 0) >= least_score else scores.get((v, kind), 0.0) for v, k, _ in found if k == kind}
                trust = sum(value.values()) / (n + 1)
                if sum(x >= 1 for x in value.values()) >= least_seeds and trust >= least_trust:
                    for v in value:
                        if (v, kind) not in certain_here:
                            votes[v, kind].append(trust)
        scores = {x: round(1 - math.prod(1 - t for t in ts), 9) for x, ts in votes.items()}
    return scores


def test_pattern_graph_bootstraps(spark):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 3)} please call me at +1 (555) 010-{1000 + i} today") for i in range(8)]
    rows += [(20 + i, f"please call me at 555 867 53{i:02} now") for i in range(3)]  # found by the seeds' context
    rows += [(30 + i, f"{words(rng, 2)} reach the desk under 555 867 53{i:02} ok") for i in range(3)]  # a second context of theirs
    rows += [(40, "reach the desk under 555/111/2222 ok"), (41, "ask 555/999/0000 then"), (42, "card 1219538112535716 isn't one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    new = lambda: Workspace(spark, "t")
    work = new()
    got = {(r.value, r.kind): r.score for r in pii.scored(work, pii.graph(work, pii.scan(df))).collect()}
    want = brute_scores(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    found = {r.value for r in pii.discovered(new(), pii.scan(df)).collect()}
    assert {"5558675300", "5558675302", "5551112222"} <= found and not {"5559990000", "1219538112535716"} & found
    work = new()
    once = {r.value for r in pii.scored(work, pii.graph(work, pii.scan(df)), rounds=1).collect()}
    assert "5558675300" in once and "5551112222" not in once


def test_long_digit_strings(spark):
    texts = ["0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1", "1." * 4000, "0" * 6000]
    assert [len(pii.base_spans(t)) for t in texts[:2]] == [1, 0]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (None, ""), (None, "+1 (555) 010-1000")], "doc_id long, text string")
    got = pii.digest(pii.find_spans(df)).collect()
    assert len(got) == 7 and sum(r.n_phone for r in got) == 1 and [r.n_ip for r in got if r.doc_id == 0] == [1]


def brute_runs(rows, min_lines, min_words):
    """Per document: the text that stays, n_deleted, n_runs, longest_run, by windows of 1, 2, 4, ... lines."""
    docs = sorted({(-1 if i is None else i, t or "") for i, t in rows})
    seqs = [[(k, x) for k, x in enumerate(t.split("\n")) if WORD.search(x)] for _, t in docs]
    first, deepest = {}, [{} for _ in docs]
    for n in (2**j for j in range(12)):
        for d, seq in enumerate(seqs):
            for k in range(len(seq) - n + 1):
                at = first.setdefault((n, tuple(x for _, x in seq[k : k + n])), (d, k))
                if at != (d, k) and (n > 1 or min_lines == 1 or len(WORD.findall(seq[k][1])) >= min_words):
                    long = n == 1 and len(WORD.findall(seq[k][1])) >= min_words or bool(deepest[d].get(k, (0, 0, 0, 0))[3])
                    deepest[d][k] = (n, at[0], at[1] - k, long)
    out = {}
    for d, (i, t) in enumerate(docs):
        runs, open_ = [], {}
        for k, (n, of, shift, long) in sorted(deepest[d].items()):
            run = open_.get((of, shift))
            if run and run[1] >= k:
                run[1], run[2] = max(run[1], k + n), run[2] or long
            else:
                run = open_[of, shift] = [k, k + n, long]
                runs.append(run)
        runs = {(a, b) for a, b, long in runs if b - a >= min_lines or long}
        runs = [(a, b) for a, b in runs if not any((x, y) != (a, b) and x <= a and b <= y for x, y in runs)]
        gone = {x for a, b in runs for x in range(seqs[d][a][0], seqs[d][b - 1][0] + 1)}
        out[i] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(gone), len(runs), max((b - a for a, b in runs), default=0))
    return out


PARAGRAPHS = [(1, "p one\n\np two\n \np three\n\nend"), (2, "start\n\np one\n\n\np two\n\np three\n\nlast"), (3, "p two\n\nelse")]
OVERLAPS = [(1, "l1\nl2"), (2, "l2\nl3"), (3, "l1\nl2\nl3"), (4, "x\nl1\nl2\nl3\ny")]


def run_rows():
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["aa", "bb", "cc", "", " ", "dd ee", "a line of five words"]) for _ in range(rng.randrange(14)))) for i in range(25)]
    rows += [(100, None), (None, "aa\nbb"), (101, "solo\nline"), (102, "\n".join(f"l{k}" for k in range(41))), (103, "\n".join(f"l{k}" for k in range(41))), (104, "r " * 50_000), (105, "own\n" + "\n".join(f"l{k}" for k in range(7, 20)))]
    return rows


@pytest.mark.parametrize("min_lines, min_words", [(1, 1), (2, 5), (3, 30)])
def test_line_runs(spark, empty, min_lines, min_words):
    rows = run_rows()
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    want = brute_runs(rows, min_lines, min_words)
    for r in line_runs.run_report(df, min_lines=min_lines, min_words=min_words).collect():
        text, n_deleted, n_runs, longest = want[-1 if r.doc_id is None else r.doc_id]
        assert (r.kept_sha256, r.n_deleted, r.n_runs, r.longest_run) == (hashlib.sha256(text.encode()).hexdigest(), n_deleted, n_runs, longest), r
    assert want[103][1:] == (41, 1, 41) and want[105][1:] == (13, 1, 13)
    if min_lines == 2:
        cleaned = line_runs.delete_runs(df)
        assert cleaned.columns == df.columns and cleaned.where("doc_id = 100").first().text is None and cleaned.where("doc_id = 103").first().text == ""
        assert line_runs.run_report(empty).count() == 0
        with pytest.raises(ValueError):
            line_runs.copied_runs(Workspace(spark, "t"), df, min_lines=0)


def test_runs_are_what_repeats_as_a_whole(spark):
    got = {r.doc_id: (r.n_deleted, r.n_runs, r.longest_run) for r in line_runs.run_report(spark.createDataFrame(OVERLAPS, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (3, 2, 2), 4: (3, 2, 2)}
    df = spark.createDataFrame(PARAGRAPHS, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_runs.delete_runs(df).collect()} == {1: PARAGRAPHS[0][1], 2: "start\n\n\nlast", 3: PARAGRAPHS[2][1]}
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"a b\n{long}\nc"), (2, f"x\n{long}\na b\ny")]
    assert {r.doc_id: r.text for r in line_runs.delete_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: rows[0][1], 2: "x\na b\ny"}


@pytest.mark.parametrize("name, rows", [("op7_all_runs", PARAGRAPHS), ("op7_all_runs", [(k, f"{k % 3}\n\n\t\n{k % 2}\n{k}\n{k % 5}") for k in range(12)]), ("op7_line_runs", OVERLAPS), ("op7_line_runs", [r for r in run_rows() if r[0] is not None])])
def test_runs_equal_their_sql(spark, tmp_path, name, rows):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", "kept_sha256"]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    sql = ORACLES[name].replace("from documents,", f"from read_parquet('{tmp_path}/documents.parquet/*.parquet') as documents,")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())
