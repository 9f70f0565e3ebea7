"""The opN_ queries: each operator with production parameters over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, divergence, langid, licenses, line_dedup, mixing, quality_crf, quality_rules, sentencepiece, sharding, simhash, toxicity
from .common import stored, table

SHARDS = 40
#: A .model file; on the driver, or in any store that Spark reads.
PIECES = os.environ.get("QUORUMLENS_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: A tokenizer .json of a byte-level BPE, likewise.
BYTES = os.environ.get("QUORUMLENS_BYTES", "/opt/tokenizers/byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(table(spark, sf_dir, "documents"), max_docs=10, min_left=0.3)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cleaned = line_dedup.LineIndex(spark).insert(docs).clean(docs, min_docs=10)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), threshold=0.8)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    vocabulary = sentencepiece.load(spark, model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = sentencepiece.decode(sentencepiece.encode(docs, vocabulary, paths=True), vocabulary)
    spaces = F.replace(F.col("text"), F.lit(sentencepiece.SPACE), F.lit(" "))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return back.select(
        "doc_id", size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), size("path_ids").alias("n_path_ids"), F.xxhash64("path_ids").alias("path_xxhash64"),
        "n_corrected", F.col("decoded").eqNullSafe(spaces).alias("round_trip"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"), weights=[1.0] * SHARDS, grown_weight=1.0)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, field).select("doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_alignment(spark: SparkSession, sf_dir: str, a: str = BYTES, b: str = PIECES) -> DataFrame:
    encoded = alignment.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), alignment.load(spark, a, b))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    # texts are encoded once; what later steps read of them is written
    encoded = stored(encoded.select("doc_id", *alignment.COUNTS, digest.alias("groups_sha256"), "links", "times"), "encoded")
    out = alignment.with_counts(encoded, alignment.pair_counts(encoded))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_ann": op6_ann,
    "op7_licenses": op7_licenses,
    "op8_langid": op8_langid,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
    "op11_divergence": op11_divergence,
    "op12_quality_crf": op12_quality_crf,
    "op13_alignment": op13_alignment,
}

_CTRL = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
with d as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_CTRL}) <> '') as ls
  from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, (select unnest(range(5)) as k) group by doc_id),
lines as (select doc_id, source, trim({_LOWER.format("x")}, {_CTRL}) as k from (select doc_id, source, unnest(string_split(t, chr(10))) as x from d)),
freq as (select source, k from lines where k <> '' group by source, k having count(distinct doc_id) > 10),
gone as (select l.doc_id, sum(len(regexp_extract_all(l.k, '[^\x20\x09-\x0D]+'))) as n
         from lines l join freq f on l.k = f.k and l.source is not distinct from f.source group by l.doc_id),
base as (
  select d.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
         least(coalesce(gone.n, 0), len(ws))::bigint as n_line_words
  from d left join cov using (doc_id) left join gone using (doc_id))
select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_line_words >= 0.3::double * n_words as kept
from base""",
    "op2_line_dedup": rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, trim({_LOWER.format("line")}, {_CTRL}) as key from l),
freq as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, freq.key is not null as gone from k left join freq using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
    "op4_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         greatest(0.05::double, case when length(coalesce(text, '')) > 0
           then length(translate(text, '#*$%&|<>0123456789', ''))::double / length(text) else 1.0::double end) as q,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':11'), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u
  from documents),
k as (select *, -ln(u) / q as key from d),
b as (select *, least(4095, floor((1 - exp(-key)) * 4096))::bigint as bucket from k),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from d group by source),
w as (select *, ([5.0, 2.0, 1.0])[((r - 1) % 3 + 1)::bigint]::double as weight, 2.0::double * source_size as cap from s),
o as (select *, coalesce(sum(cap) over (order by cap / weight, r rows between unbounded preceding and 1 preceding), 0)::double as capped,
             sum(weight) over (order by cap / weight, r rows between current row and unbounded following)::double as free,
             (sum(source_size) over ())::double * 1.5::double as total from w),
lev as (select coalesce(arg_min((total - capped) / free, cap / weight) filter (where (total - capped) / free <= cap / weight), max(cap / weight)) as level from o),
t as (select w.source, source_size, least(cap, weight * level) as target from w, lev),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from t),
g as (select *, floor(target - epochs * source_size)::bigint as budget from e),
p as (select b.doc_id, b.size, g.source_size, g.target, g.epochs, g.budget,
             coalesce(sum(b.size) over (partition by b.source order by b.bucket, b.key, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0)::bigint as prior
      from b join g on b.source is not distinct from g.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - prior)))::bigint as taken from p""",
    "op11_divergence": rf"""
with w as (
  select rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as rid from documents)),
k as (select lang, term from w group by lang, term having count(distinct rid) >= 30),
v as (select lang, count(*)::hugeint as v from k group by lang),
c as (select lang, source, term, count(*)::hugeint as n from w join k using (lang, term) group by all),
g as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
n as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c using (lang, source) group by all),
p as (select n.lang, n.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (n.total + 5 * v.v) as p
      from n join k using (lang) join v using (lang) left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
l as (select k.lang, k.term, 1 + (1000000000::hugeint * (m.n + 5)) // (t.total + 5 * v.v) as q
      from k join v using (lang) join (select lang, term, sum(n)::hugeint as n from c group by all) m using (lang, term)
      join (select lang, sum(n)::hugeint as total from c group by all) t using (lang)),
pair as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
         from g a join g b on a.lang = b.lang and a.source <> b.source
         left join (select x.lang, x.source as sa, y.source as sb, sum(abs(x.p - y.p)) as value
                    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
           on s.lang = a.lang and s.sa = a.source and s.sb = b.source),
term as (select p.lang, p.source, p.term as item, (p.p - l.q)::bigint as value from p join l using (lang, term) where p.n > 0 and p.p > l.q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
      union all
      select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from term)
select * from r where part = 'pair' or rank <= 50""",
}
