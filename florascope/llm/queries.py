"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, jaccard, licenses, line_dedup, negatives, packing, quality, secrets, simhash, toxicity, warc, whitening
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id", "n_links")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.held_out("doc_id", 3, 1)
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = toxicity.held_out("doc_id", 5, 0)
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "window_start")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _lowered(s: str) -> str:
    return f"translate(coalesce({s}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op3_sql() -> str:
    digit = "(instr('0123456789abcdef', substr(h, {}, 1)) - 1)"
    pair = f"({digit.format('5 * i // 4 + 1')} * 16 + {digit.format('5 * i // 4 + 2')})"
    return f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
 d as (select h, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((({pair} >> cast(3 - 5 * i % 4 as int)) & 31) + 1 as int), 1)), '') as payload_digest, max(page_id) as response_id from (select * from p) z group by h)
select page_id, payload_bytes, payload_digest, case when page_id = response_id then 'response' else 'revisit' end as record_type, case when page_id <> response_id then response_id end as refers_to
from p join d using (h)"""


def op4_sql() -> str:
    starts = [
        f"list_transform(list_filter(range(len(w)), lambda i: {' and '.join(f'w[i + {k + 1}] = {_quoted(x)}' for k, x in enumerate(p.split()))}), lambda i: {{'ord': i, 'label': {_quoted(label)}}})"
        for p, label in licenses.PHRASES.items()
    ]
    templates = ", ".join(
        f"({_quoted(label)}, {len(t)}, {licenses.need(w, licenses.THRESHOLD)}, {licenses.block_size(w)}, [{', '.join(map(_quoted, t))}])" for label, w in licenses.TEMPLATES for t in [licenses.template_words(w)]
    )
    return f"""
with d as (select row_number() over () as rid, doc_id, {_lowered('text')} as s from documents),
 b as (select rid, doc_id, list_filter(regexp_split_to_array(s, '{licenses.BETWEEN}'), lambda x: x <> '') as w from d),
 p as (select rid, doc_id, len(w) as n_words, list_concat({', '.join(starts)}) as ord from b),
 q as (select label, nt, need, size, unnest(words) as word from (values {templates}) v(label, nt, need, size, words)),
 x as (select rid, unnest(w) as word, unnest(range(len(w))) as pos from b),
 h as (select rid, label, nt, need, size, word, pos from x join q using (word)),
 e as (select rid, label from h group by rid, label, need having count(distinct word) >= need),
 m as (select u.rid, u.label, u.pos, count(distinct v.word) as n, any_value(u.nt) as nt, any_value(u.need) as need from h u join e using (rid, label) join h v
  on v.rid = u.rid and v.label = u.label and v.pos >= u.pos and v.pos < u.pos + u.size group by u.rid, u.label, u.pos),
 f as (select rid, list(distinct label) as found, max(n * 1e0 / nt) as c from m where n >= need group by rid)
select doc_id, cast(n_words as bigint) as n_words, cast(len(ord) as bigint) as n_base,
 cast(list_min(list_transform(ord, lambda x: x.ord)) as bigint) as first_word, cast(list_max(list_transform(ord, lambda x: x.ord)) as bigint) as last_word,
 array_to_string(list_sort(list_distinct(list_transform(ord, lambda x: x.label))), ',') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(list_transform(ord, lambda x: x.label), coalesce(found, [])))), ',') as labels,
 case when len(ord) > 0 then 1e0 else coalesce(c, 0e0) end as score
from p left join f using (rid)"""


def op7_sql() -> str:
    kinds = " union all ".join(
        f"select rid, {k} as k, {_quoted(kind)} as kind, unnest(string_split_regex(s, {_quoted(p)})) as gap, unnest(regexp_extract_all(s, {_quoted(p)})) as m, "
        f"unnest(regexp_extract_all(s, {_quoted(p)}, {int(kind == 'assign')})) as v, unnest(range(len(s) + 1)) as ord from d where regexp_matches(s, {_quoted(p)})"
        for k, (kind, p) in enumerate(secrets.PATTERNS.items())
    )
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as s from documents),
 r as ({kinds}),
 e as (select rid, k, kind, m, v, sum(length(gap) + length(m)) over (partition by rid, k order by ord) as fin from r where m is not null),
 a as (select rid, k, kind, cast(fin - length(m) as bigint) as beg, cast(fin as bigint) as fin from e where case kind when 'assign' then length(v) >= 8 when 'access' then length(m) >= 16
  when 'secret' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') else true end),
 u as (select * from a where kind <> 'secret' or not exists (select 1 from a b where b.rid = a.rid and b.kind in ('assign', 'access', 'hex', 'endpoint') and b.beg < a.fin and b.fin > a.beg)),
 n as (select rid, k, kind, beg, fin,
  exists (select 1 from u b where b.rid = u.rid and b.kind in ('access', 'account') and b.beg <= u.fin + {secrets.SCOPE} and b.fin >= u.beg - {secrets.SCOPE}) as near_id,
  exists (select 1 from u b where b.rid = u.rid and b.kind in ('assign', 'hex', 'secret') and b.beg <= u.fin + {secrets.SCOPE} and b.fin >= u.beg - {secrets.SCOPE}) as near_secret,
  exists (select 1 from u b where b.rid = u.rid and b.kind = 'endpoint' and b.beg <= u.fin + {secrets.SCOPE} and b.fin >= u.beg - {secrets.SCOPE}) as near_end from u),
 g as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(concat_ws(':', kind, beg, fin), ',' order by beg, k) filter (k < 3) as base, string_agg(concat_ws(':', kind, beg, fin), ',' order by beg, k) as spans
  from n where k < 3 or case kind when 'secret' then near_id or near_end when 'endpoint' then near_id and near_secret else near_secret end group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (rid)"""


def op10_sql(keep: str = "doc_id, n_lines, n_dropped, text", docs: str = "documents") -> str:
    blank = "' ' || " + " || ".join(f"chr({ord(c)})" for c in line_dedup.BLANK.strip(" "))
    return f"""
with d as (select row_number() over () as rid, * from {docs}),
 x as (select rid, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ord from d where text is not null),
 c as (select source, line, count(distinct rid) as n from x where trim(line, {blank}) <> '' group by source, line),
 p as (select source, count(*) as pages from d group by source),
 b as (select c.source, c.line from c join p on c.source is not distinct from p.source where n >= {line_dedup.MIN_PAGES} and n > pages * {line_dedup.RATIO}e0),
 m as (select x.rid, x.ord, x.line, b.line is not null as bad from x left join b on x.source is not distinct from b.source and x.line = b.line),
 g as (select rid, cast(count(*) as int) as n_lines, cast(count(*) filter (bad) as int) as n_dropped, coalesce(string_agg(line, chr(10) order by ord) filter (not bad), '') as kept from m group by rid)
select {keep} from (select d.* exclude (text), coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, kept as text from d left join g using (rid)) z"""


def op9_sql() -> str:
    split = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{licenses.BETWEEN}'), lambda x: x <> '')"
    grams = "unnest(list_transform(range({n} - {k} + 1), lambda i: array_to_string(w[i + 1 : i + {k}], ' ')))"
    return f"""
with i as (select item_id, w, len(w) as n, least(len(w), 5) as k from (select item_id, {split} as w from benchmark) z where len(w) > 0),
 ig as (select item_id, k, n, g, count(*) as c from (select item_id, k, n, {grams.format(n="n", k="k")} as g from i) z group by all),
 d as (select doc_id, {split} as w from documents),
 ks as (select distinct k from i),
 dg as (select doc_id, k, len(w) as nd, {grams.format(n="len(w)", k="k")} as g, unnest(range(len(w) - k + 1)) as pos from d cross join ks where len(w) >= k),
 h as (select doc_id, item_id, dg.k, n, n - dg.k + 1 as m, least(n, nd) - dg.k + 1 as mw, nd, pos, g, c from dg join ig using (k, g)),
 cand as (select doc_id, item_id, k, n, m, mw, nd, unnest(range(greatest(0, pos - mw + 1), least(pos, nd - least(n, nd)) + 1)) as s, pos, g, c from h),
 o as (select doc_id, item_id, m, mw, s, sum(least(cw, c)) as o from (select doc_id, item_id, m, mw, s, g, c, count(*) as cw from cand group by all) z group by doc_id, item_id, m, mw, s),
 v as (select doc_id, item_id, s, cast(o as double) / cast(m + mw - o as double) as similarity from o),
 r as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, s) as rn from v where similarity >= {decontam.SIMILARITY}e0)
select doc_id, item_id, similarity, cast(s as int) as window_start from r where rn = 1"""


def op11_sql() -> str:
    k = jaccard.WORDS
    gram = " || ' ' || ".join(["word", *[f"lead(word, {i}) over w" for i in range(1, k)]])
    return f"""
with recursive d as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array({_lowered('text')}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 a as (select rid, unnest(w) as word, unnest(range(len(w))) as pos from d where len(w) >= {k}),
 g as (select distinct rid, x from (select rid, {gram} as x from a window w as (partition by rid order by pos)) z where x is not null
  union all select rid, array_to_string(w, ' ') as x from d where len(w) between 1 and {k - 1}),
 h as (select rid, count(*) as n, md5(string_agg(x, chr(10) order by x)) as h from g group by rid),
 c as (select h, any_value(n) as n, min(rid) as class, min(doc_id) as first_id, count(*) as copies from h join d using (rid) group by h),
 t as (select class, n, x from c join g on rid = class),
 o as (select a.class as u, b.class as v, any_value(a.n) as nu, any_value(b.n) as nv, count(*) as common from t a join t b using (x) where a.class <> b.class and 100 * least(a.n, b.n) >= {jaccard.PERCENT} * greatest(a.n, b.n) group by a.class, b.class),
 l as (select u, v from o where 100 * common >= {jaccard.PERCENT} * (nu + nv - common)),
 r as (select class as u, class as v from c union select r.u, l.v from r join l on r.v = l.u),
 m as (select r.u as class, min(first_id) as component_id from r join c on c.class = r.v group by r.u),
 p as (select l.u as class, sum(copies) as linked from l join c on c.class = l.v group by l.u)
select doc_id, cast(coalesce(h.n, 0) as bigint) as n_shingles, case when h.n is null then doc_id else component_id end as component_id, cast(coalesce(copies - 1 + coalesce(linked, 0), 0) as bigint) as n_links
from d left join h using (rid) left join c on h.h = c.h left join m using (class) left join p using (class)"""


def op12_sql() -> str:
    n = negatives
    return f"""
with e as (select vec_id, case when vec_id % {n.RELABEL_EVERY} = 0 then (label + 1) % {n.LABELS} else label end as label, list_transform(embedding, lambda c: floor({n.SCALE} * cast(c as double))) as x
  from (select distinct vec_id, label, embedding from embeddings) z where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % {n.ANCHORS_EVERY} = 0),
 p as (select anchor_id, other_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as r from s where same) z where r <= {n.POSITIVES}),
 g as (select anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as rank
  from s join p using (anchor_id) where not same and {n.LOWER} * positive_score <= 100 * score and 100 * score <= {n.UPPER} * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from g where rank <= {n.NEGATIVES}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_warc": op3_warc,
        "op4_license_scan": op4_license_scan,
        "op5_toxicity": op5_toxicity,
        "op6_ann": op6_ann,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality": op8_quality,
        "op9_decontamination": op9_decontamination,
        "op10_line_dedup": op10_line_dedup,
        "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": op3_sql(),
        "op4_license_scan": op4_sql(),
        "op7_secret_scan": op7_sql(),
        "op9_decontamination": op9_sql(),
        "op10_line_dedup": op10_sql(),
        "op11_ngram_jaccard_join": op11_sql(),
        "op12_hard_negatives": op12_sql(),
    }
