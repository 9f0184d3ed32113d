"""Registered queries of the corpus operators, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, gam, html_paths, line_runs, mixing, ngram_join, packing, pii, transport_stream, warc_bundle
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@_query(
    "op6_exact_dedup",
    f"""
    with t as (select doc_id, translate(coalesce(text, ''), {_AZ}) as k from documents),
    g as (select k, max(doc_id) as keep_id, count(*) as group_size from t group by k)
    select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(k) as text_sha256
    from t join g using (k)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


@_query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@_query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query("op10_transport_stream")
def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.store_and_probe(table(spark, sf_dir, "documents"))


@_query(
    "op2_warc_bundle",
    """
    with p as (select page_id, coalesce(html, '') as payload from pages),
    d as (select *, sha1(payload) as hex, min(page_id) over (partition by payload) as first from p),
    b as (select *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') as bits from d)
    select page_id, cast(strlen(payload) as bigint) as payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            cast(1 + list_sum(list_transform(range(5), lambda j: case when substr(bits, i * 5 + j + 1, 1) = '1' then 1 << (4 - j) else 0 end)) as int), 1)), '') as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id != first then first end as refers_to
    from b
    """,
)
def op2_warc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundle.archive_and_read(table(spark, sf_dir, "pages"))


@_query("op9_html_paths")
def op9_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(table(spark, sf_dir, "pages"))


@_query("op8_additive_model")
def op8_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query(
    "op1_ngram_join",
    rf"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as ws from documents),
    sh as materialized (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as g(i) where len(ws) > 0),
    n as materialized (select doc_id, count(*) as n from sh group by 1),
    often as (select s from sh group by s having count(*) > 1),
    few as materialized (select * from sh where s in (select s from often)),
    pairs as (select a.doc_id as u, b.doc_id as v, count(*) as common from few a join few b on a.s = b.s and a.doc_id != b.doc_id group by 1, 2),
    links as materialized (select u, v, common = x.n and common = y.n as same from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 80 * (x.n + y.n - common)),
    reach as (select u, v from links union select r.u, l.v from reach r join links l on l.u = r.v),
    c as (select u, least(u, min(v)) as component_id from reach group by u),
    k as (select u, count(*) as n_links, least(u, min(v) filter (where same)) as class_id from links group by u)
    select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(component_id, w.doc_id) as component_id, coalesce(class_id, w.doc_id) as class_id, cast(coalesce(n_links, 0) as bigint) as n_links
    from w left join n on n.doc_id = w.doc_id left join c on c.u = w.doc_id left join k on k.u = w.doc_id
    """,
)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"), links=True)


def _runs_sql(min_lines: int, min_words: int) -> str:
    """SQL twin of ``line_runs.run_report``: windows of 1, 2, 4, ... lines as lists, for sequences of up to 32,768 lines."""
    return rf"""
    with lines as (
        select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line
        from documents, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) as g(i)
    ),
    filled as (select *, row_number() over (partition by doc_id order by i) - 1 as k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
    seqs as (select doc_id, list(line order by k) as seq, list(words order by k) as words from filled group by doc_id),
    windows as (
        select doc_id, k, n, words[k + 1] as words, seq[k + 1 : k + n] as content
        from seqs, (select cast(pow(2, unnest(range(0, 16))) as bigint) as n), unnest(range(0, len(seq) - n + 1)) as g(k) where n <= len(seq)
    ),
    firsts as (select *, min(struct_pack(d := doc_id, k := k)) over (partition by n, content) as f from windows),
    copies as (select doc_id, k, n, k + n as stop, f.d as d, f.k - k as shift, n = 1 and words >= {min_words} as long from firsts where (doc_id != f.d or k != f.k) and (n > 1 or {min_lines} = 1 or words >= {min_words})),
    deepest as (select *, bool_or(long) over (partition by doc_id, k) as any_long from copies qualify n = max(n) over (partition by doc_id, k)),
    opened as (select *, max(stop) over (partition by doc_id, d, shift order by k rows between unbounded preceding and 1 preceding) as before from deepest),
    numbered as (select *, sum(case when before >= k then 0 else 1 end) over (partition by doc_id, d, shift order by k) as run from opened),
    found as (select doc_id, d, shift, run, min(k) as a, max(stop) as b from numbered group by 1, 2, 3, 4 having max(stop) - min(k) >= {min_lines} or bool_or(any_long)),
    outers as (select * from (select *, max(b) over (partition by doc_id order by a, b desc, d rows between unbounded preceding and 1 preceding) as past from found) where past is null or past < b),
    totals as (select doc_id, count(*) as n_runs, max(b - a) as longest_run from outers group by doc_id),
    gone as (select distinct o.doc_id, unnest(generate_series(x.i, y.i)) as i from outers o join filled x on x.doc_id = o.doc_id and x.k = o.a join filled y on y.doc_id = o.doc_id and y.k = o.b - 1),
    marked as (select l.*, g.i is not null as deleted from lines l left join gone g on l.doc_id = g.doc_id and l.i = g.i)
    select m.doc_id, count(*) as n_lines, count(*) filter (where deleted) as n_deleted,
        coalesce(max(t.n_runs), 0) as n_runs, coalesce(max(t.longest_run), 0) as longest_run,
        sha256(coalesce(string_agg(line, chr(10) order by m.i) filter (where not deleted), '')) as kept_sha256
    from marked m left join totals t on t.doc_id = m.doc_id group by m.doc_id
    """


@_query("op7_line_runs", _runs_sql(2, line_runs.MIN_WORDS))
def op7_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied runs of two lines or more, and copied lines of MIN_WORDS words or more."""
    return line_runs.run_report(table(spark, sf_dir, "documents"))


@_query("op7_all_runs", _runs_sql(1, 1))
def op7_all_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied lines of any length, too."""
    return line_runs.run_report(table(spark, sf_dir, "documents"), min_lines=1)


@_query("op5_contextual_pii")
def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))
