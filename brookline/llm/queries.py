"""The operators' queries, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import VOCABULARY, pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licences

    return scan_licences(table(spark, sf_dir, "documents")).select("doc_id", "n_found", "families", "spans")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bm25 import search

    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0").selectExpr("doc_id as qid", "text")).withColumn("score", F.round("score", 6))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), keep=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import VOCABULARY, digests, read_ids, scratch, write_ids

    path = scratch(spark)
    write_ids(table(spark, sf_dir, "documents"), path, vocabulary(VOCABULARY))
    return digests(read_ids(spark, path))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_license_scan, op3_mixing, op4_simhash, op5_pii, op6_quality, op7_exact_dedup, op8_packing, op9_bm25_topk, op10_suffix_dedup, op11_whitening, op12_resampling, op13_token_files)}

_SUFFIXES = """
        with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        s as materialized (select doc_id, i, substr(h, 2 * i + 1, 100) as w from (select *, unnest(range(0, length(h) // 2 - 49)) as i from d)),
        f as (select w, min(doc_id) as first_id from s group by w),
        g as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as starts from s join f using (w) where first_id < doc_id),
        r as (select doc_id, min(i) as lo, max(i) + 50 as hi from (select *, sum(starts) over (partition by doc_id order by i) as n from g) group by doc_id, n),
        k as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from r),
        t as (select doc_id, sum(hi - lo)::bigint as n_removed, count(*) as n_spans, max(hi) as tail, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' order by lo) as kept from k join d using (doc_id) group by doc_id)
        select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(case when tail is null then h else kept || substr(h, 2 * tail + 1) end)) as kept_sha256 from d left join t using (doc_id)"""

_BM25 = """
        with w as materialized (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+')) as term from documents),
        l as (select doc_id, count(*) as dl from w group by 1),
        n as (select count(*) as n, (select sum(dl) from l) / count(*) as mean from documents),
        tf as materialized (select doc_id, term, count(*) as tf from w group by all),
        df as (select term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, n group by term, n),
        q as (select doc_id as qid, term, idf from tf join df using (term) where doc_id % 100 = 0),
        s as (select qid, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) order by term) as score from q join tf using (term) join l using (doc_id), n group by 1, 2)
        select qid, rank, doc_id, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id)::int as rank from s) where rank <= 10"""

# What op1 and op2 learn has to give on the tables as they are: every page's text is that of its one <article>, and every
# statement of a licence is a line of one of five forms.
_ARTICLES = """
        with a as (select page_id, url, string_split_regex(replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' '), '</?(?:p|h1)>') as parts from pages),
        b as (select page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) as text from a)
        select page_id, url, text, length(text) as n_chars from b"""

_LICENCES = """
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
        p as (select *, (sum(length(line) + 1) over (partition by doc_id order by i))::bigint - length(line) - 1 as start from l),
        f as (select doc_id, start, start + length(rtrim(line, '.')) as stop, case when contains(line, 'GNU General Public License') then 'gpl' when contains(line, 'All rights reserved') then 'proprietary' when contains(line, 'CC BY-NC') then 'cc-by-nc' when contains(line, 'the MIT License') then 'mit' when contains(line, 'the Apache License') then 'apache' end as family from p)
        select d.doc_id, count(family) as n_found, coalesce(string_agg(distinct family, ',' order by family), '') as families, coalesce(string_agg(family || ':' || start || ':' || stop, ',' order by start), '') as spans from documents d left join f on f.doc_id = d.doc_id and family is not null group by d.doc_id"""

_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]", "id": r"[^ \t\n\x0b\f\r0-9@_]*[0-9@_][^ \t\n\x0b\f\r]*"}


def _pii_sql() -> str:
    """All spans: the base forms, and the identifiers in the place of patterns that the bootstrapping trusts."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"list_transform(list_filter(string_split_regex({}, '[ \t\n\x0b\f\r]+'), lambda w: w <> ''), lambda w: case when regexp_matches(w, '[0-9@_]') then '0' else " + lower.format("w") + " end)"
    before = words.format("case when i > 2 then ps[i-2] || ' 0 ' else '' end || case when i > 1 then ps[i-1] || ' 0 ' else '' end || ps[i]")
    after = words.format("ps[i+1] || coalesce(' 0 ' || ps[i+2], '') || coalesce(' 0 ' || ps[i+3], '')")
    key = "regexp_extract(v, '[A-Za-z0-9]{20,}')"
    steps = [
        "x as (" + " union all ".join(f"select doc_id, '{k}' as kind, {i} as k, regexp_extract_all(coalesce(text, ''), '{p}') as ms, string_split_regex(coalesce(text, ''), '{p}') as ps from documents" for i, (k, p) in enumerate(_KINDS.items())) + ")",
        "e as (select *, unnest(ms) as m, generate_subscripts(ms, 1) as i from x where len(ms) > 0)",
        """s as (select doc_id, kind, k, m, regexp_replace(m, '[^0-9]', '', 'g') as d, coalesce(length(regexp_extract(m, '^[^A-Za-z0-9]+')), 0) as lead, regexp_replace(regexp_replace(m, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') as v,
            list_sum(list_transform(ps[1:i], lambda p: length(p)))::bigint + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p))), 0)::bigint as a, """
        + f"{before} as bw, {after} as aw from e)",
        """f as materialized (select *, a + length(m) as b from s where case kind when 'email' then true when 'id' then false when 'ip' then list_max(list_transform(string_split(m, '.'), lambda p: p::double)) <= 255 when 'phone' then length(d) between 9 and 15
            else length(d) between 12 and 19 and list_sum(list_transform(range(length(d)), lambda j: case when j % 2 = 0 then substr(d, length(d) - j, 1)::int else 2 * substr(d, length(d) - j, 1)::int - case when substr(d, length(d) - j, 1)::int > 4 then 9 else 0 end end)) % 10 = 0 end)""",
        f"t as (select doc_id, a + lead as a, a + lead + length(v) as b, {lower.format('v')} as v, length(regexp_replace({key}, '[^0-9]', '', 'g')) >= 4 and length(regexp_replace({key}, '[0-9]', '', 'g')) >= 4 and regexp_matches(md5({lower.format('v')}), '^[01234567]') as seed, bw, aw from s where kind = 'id' and v <> '')",
        "u as materialized (select * from t where not exists (select 1 from f where f.doc_id = t.doc_id and f.a < t.b and f.b > t.a))",
        f"i as (select doc_id, a, b, v, seed::int::double as seed, bw, aw from u union all select doc_id, a, b, {lower.format('m')}, 1.0, bw, aw from f)",
        """c as materialized (select * exclude (bw, aw, cs), unnest(cs) as c from (select *, list_filter([case when len(bw) > 1 then '< ' || bw[-2] || ' ' || bw[-1] end, case when len(aw) > 1 then '> ' || aw[1] || ' ' || aw[2] end, case when len(bw) > 0 and len(aw) > 0 then '= ' || bw[-1] || ' ' || aw[1] end], lambda c: c is not null) as cs from i))""",
        "g0 as (select c, v, max(seed) as seed from c group by c, v)",
        "g as materialized (select * from g0 where c in (select c from g0 group by c having count(*) >= 3))",
        "w0 as (select w, unnest(w) as x, generate_subscripts(w, 1) as j from (select " + words.format("coalesce(text, '')") + " as w from documents))",
        "w1 as (select x, unnest([case when j > 2 then '< ' || w[j-2] || ' ' || w[j-1] end, case when j + 2 <= len(w) then '> ' || w[j+1] || ' ' || w[j+2] end, case when j > 1 and j < len(w) then '= ' || w[j-1] || ' ' || w[j+1] end]) as c from w0 where x <> '0')",
        "n as materialized (select c, coalesce((select count(distinct x) from w1 where w1.c = g.c), 0) as n from g group by c)",
        "p as (select c, count(*) filter (where seed = 0 and regexp_matches(v, '^[^a-z@_]+$') and length(regexp_replace(v, '[^0-9]', '', 'g')) < 7) as plain from g group by c)",
        "v0 as (select v, 0.0 as score from g group by v)",
    ]
    for r in range(8):  # what is trusted is settled after fewer rounds
        steps.append(f"c{r} as materialized (select c, sum(greatest(seed, score)) as total, sum(greatest(seed, score)) / (sum(greatest(seed, score)) + any_value(n) + any_value(plain) + 1) as conf from g join v{r} using (v) join n using (c) join p using (c) group by c)")
        steps.append(f"v{r + 1} as materialized (select v, max(case when seed = 0 and total >= 3 and conf >= 0.6 then 0.5 else 0 end) as score from g join c{r} using (c) group by v)")
    steps += [
        "y as (select distinct doc_id, 'id' as kind, 5 as k, a, b from c semi join (select c from c7 where conf >= 0.6 and total >= 3) using (c) where exists (select 1 from u where u.doc_id = c.doc_id and u.a = c.a and u.b = c.b))",
        "z as (select doc_id, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) filter (where kind <> 'id') as base, string_agg(kind || ':' || a || ':' || b, ',' order by a, k) as spans, count(*) as n_spans, " + ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in _KINDS) + " from (select doc_id, kind, k, a, b from f union all select * from y) group by doc_id)",
    ]
    return f"with {', '.join(steps)} select d.doc_id, " + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in _KINDS) + ", sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_spans, 0) as n_spans from documents d left join z using (doc_id)"


_RESAMPLING = """
        with recursive b as (select i, i as c, 0 as r from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, r + 1 from b where r < 8),
        tab as (select list(c order by i) as t from b where r = 8),
        w as materialized (select 's' as side, doc_id as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from documents
            union all select 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark),
        u as (select distinct word, hex(encode(word)) as h from w),
        k as materialized (select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::bigint + 1, 2))::bigint)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 as bucket from u, tab),
        n as (select bucket, count(*) filter (where side = 's')::double as s, count(*) filter (where side = 't')::double as t from w join k using (word) group by bucket),
        a as (select sum(s) as s_all, sum(t) as t_all from n),
        g as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from n, a),
        f as (select id as doc_id, count(*) as n_features, sum(gain)::bigint as weight from w join k using (word) join g using (bucket) where side = 's' group by id),
        d as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from documents left join f using (doc_id)),
        e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from d),
        o as (select doc_id, row_number() over (order by score desc, doc_id) as rank from e where n_features >= 20)
        select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from o) then rank end as rank from e left join o using (doc_id)"""


ORACLE_SQL = {
    "op12_resampling": _RESAMPLING,
    "op5_pii": _pii_sql(),
    "op1_html_extract": _ARTICLES,
    "op2_license_scan": _LICENCES,
    "op3_mixing": mixing.oracle(),
    "op7_exact_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as raw, regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g') as norm from documents),
        r as (select doc_id, norm, first_value(doc_id) over (partition by norm order by length(raw) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r""",
    "op9_bm25_topk": _BM25,
    "op10_suffix_dedup": _SUFFIXES,
}
