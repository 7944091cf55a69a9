"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe, decontaminate, exact_dedup, fill_in_middle, ngram_lm, packing, secrets, simhash, suffix_dedup, toxicity, url_filter, wavelet, whitening,
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A production vocabulary; a file of the installed package, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_decontamination, op2_secret_scan, op3_url_filter, op4_token_shards, op5_exact_dedup, op6_toxicity, op7_stupid_backoff,
        op8_suffix_dedup, op9_simhash, op10_bpe_round_trip, op11_whitening, op12_best_fit_packing, op13_fill_in_middle,
    )
    return {f.__name__: f for f in made}


def _secret_sql() -> str:
    """Spans from the pieces between matches, as prefix sums of lengths."""
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        p = rule.pattern.replace("'", "''")
        parts.append(
            f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, length(list_aggregate(gaps[1:i], 'string_agg', '')) + coalesce(length(list_aggregate(whole[1:i-1], 'string_agg', '')), 0) as start,
                   length(whole[i]) as n, length(part[i]) as got
            from (select doc_id, whole, part, gaps, unnest(range(1, len(whole) + 1)) as i from (
                select doc_id, regexp_extract_all(body, '{p}', 0) as whole, regexp_extract_all(body, '{p}', {rule.group}) as part, string_split_regex(body, '{p}') as gaps
                from d where regexp_matches(body, '{p if rule.group else p.replace("[0-9a-f]+", "[0-9a-f]{24}")}')))
            where length(part[i]) >= {rule.least}"""
        )
    return f"""
with d as (select doc_id, coalesce(text, '') as body from documents),
f as ({' union all '.join(parts)}),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || start || ':' || (start + n), ',' order by start, rank) as spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)"""


EXACT_DEDUP_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by k) as group_size,
       doc_id = first_value(doc_id) over w as kept, sha256(k) as text_sha256
from d window w as (partition by k order by n desc, doc_id)"""


STUPID_BACKOFF_SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
o as (select doc_id, len(w) as n, unnest(range(1, len(w) + 1)) as i, w from d),
g as (select doc_id, n, i, w[i] as g1, case when i > 1 then w[i-1] || ' ' || w[i] end as g2, case when i > 2 then w[i-2] || ' ' || w[i-1] || ' ' || w[i] end as g3 from o),
l as (select *, count(*) over (partition by g1) - count(*) over (partition by doc_id, g1) as c1,
             case when g2 is null then 0 else count(*) over (partition by g2) - count(*) over (partition by doc_id, g2) end as c2,
             case when g3 is null then 0 else count(*) over (partition by g3) - count(*) over (partition by doc_id, g3) end as c3,
             count(*) over () as total from g),
p as (select *, lag(c1) over (partition by doc_id order by i) as b1, lag(c2) over (partition by doc_id order by i) as b2 from l),
s as (select doc_id, case when c3 > 0 then log10(c3 / b2) when c2 > 0 then log10(c2 / b1) + case when i > 2 then log10(0.4) else 0 end
                          else log10(greatest(c1, 0.5) / greatest(total - n, 1)) + log10(0.4) * least(i - 1, 2) end as s from p),
r as (select doc_id, sum(s) as s from s group by doc_id)
select doc_id, len(w) as n_words, round(coalesce(s, 0), 6) as log_score, case when len(w) > 0 then round(s / len(w), 6) else 0 end as mean_log_score
from d left join r using (doc_id)"""


SUFFIX_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as i from d)),
m as (select s, min(doc_id) as f from w group by s),
c as (select w.doc_id, i from w join m using (s) where f < w.doc_id),
k as (select doc_id, i, sum(case when i > before + 50 then 1 else 0 end) over (partition by doc_id order by i) as k from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from c)),
r as (select doc_id, min(i) as a, max(i) + 50 as z from k group by doc_id, k),
p as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as pz from r),
b as (select p.doc_id, string_agg(substr(h, 2 * pz + 1, 2 * (a - pz)), '' order by a) as body, sum(z - a) as gone, count(*) as spans, max(z) as last from p join d on d.doc_id = p.doc_id group by p.doc_id)
select d.doc_id, len(h) // 2 as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(unhex(case when gone is null then h else body || substr(h, 2 * last + 1) end)) as kept_sha256
from d left join b using (doc_id)"""


FILL_IN_MIDDLE_SQL = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents),
r as (select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as z,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, z - a) as middle, substr(t, z + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then z - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p"""


def oracle_sql() -> dict[str, str]:
    return {"op13_fill_in_middle": FILL_IN_MIDDLE_SQL, "op7_stupid_backoff": STUPID_BACKOFF_SQL, "op8_suffix_dedup": SUFFIX_SQL, "op2_secret_scan": _secret_sql(), "op5_exact_dedup": EXACT_DEDUP_SQL}
