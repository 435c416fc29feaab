"""The registered queries of this subpackage, with their SQL where SQL can state them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.session import scratch_path

from . import balltree, divergence, htmltext, mixing, nbsvm, neardup, packing, pii, quality, rans, search, toxicity, warc

QUERIES, ORACLES = {}, {}

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Workers on this machine import the package from here; a cluster has it installed or shipped.

    Rows hold whole texts, so Arrow batches hold fewer rows than by default.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def register(name, sql=None):
    def keep(fn):
        def query(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- packing

@register("op2_pack_best_fit")
def op2(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


# ---------------------------------------------------------------- token files

@register("op3_rans_files")
def op3(spark, sf):
    folder = scratch_path(spark, "rans")
    blocks = rans.write(table(spark, sf, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"),
                        vocabulary=49_408, spaced=False, end_id=2)
    docs = rans.read(blocks, folder)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# ---------------------------------------------------------------- near duplicates

@register("op4_minhash_neardup")
def op4(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"))


# ---------------------------------------------------------------- personal data

def same(kind):
    return lambda s: s["kind"] == kind


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@register("op6_pii_spans", r"""
    with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
    p(ord, kind, pattern, base, words, bonus) as (values
        (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.8, 'mail|contact|write|address', 0.15),
        (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 0.5, 'host|server|address', 0.3),
        (3, 'card', '[0-9](?:[\x20-]?[0-9])+', 0.7, 'card|visa|credit|payment', 0.25),
        (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 0.6, 'phone|call|tel|fax|mobile', 0.3),
        (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b', 0.8, 'iban|account|bank', 0.2),
        (6, 'aws_key', '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', 0.8, 'key|access|aws', 0.2),
        (7, 'secret', '\b[0-9a-f]{16,64}\b', 0.3, 'password|passwd|pwd|token|secret|key|auth', 0.5)),
    f as (select rid, text, ord, kind, base, words, bonus, regexp_extract_all(text, pattern) as found,
                 string_split_regex(text, pattern) as gaps from t, p),
    g as (select * exclude (found, gaps), unnest(found) as m, unnest(gaps[1:len(found)]) as gap,
                 unnest(range(len(found))) as i from f where len(found) > 0),
    h as (select *, sum(length(gap) + length(m)) over (partition by rid, ord order by i) as stop,
                 regexp_replace(m, '[^0-9]', '', 'g') as digits from g),
    k as (select *, cast(stop - length(m) as bigint) as start from h where case kind
        when 'ip' then regexp_full_match(m, '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}')
        when 'card' then length(digits) between 13 and 19 and list_sum([
            cast(digits[length(digits) - j] as integer) * (1 + j % 2)
            - case when cast(digits[length(digits) - j] as integer) * (1 + j % 2) > 9 then 9 else 0 end
            for j in range(length(digits))]) % 10 = 0
        when 'phone' then length(digits) between 9 and 15
        when 'iban' then list_reduce([cast(c as bigint) for c in string_split(array_to_string([
            case when c between '0' and '9' then c else cast(ascii(c) - 55 as varchar) end
            for c in string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')], ''), '')],
            lambda a, b: (a * 10 + b) % 97) = 1
        else true end),
    n as (select *, base + case when regexp_matches(lower(substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0))), words)
                 then bonus else 0 end as score from k),
    s as (select rid, ord, kind, start, kind || ':' || start || ':' || cast(stop as bigint) as span from n
          where ord <= 4 or score >= 0.5),
    a as (select rid, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
                 count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
                 string_agg(span, ',' order by ord, start) filter (ord <= 4) as base, string_agg(span, ',' order by ord, start) as spans
          from s group by rid)
    select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
           coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from t left join a using (rid)""")
def op6(spark, sf):
    found = pii.find(table(spark, sf, "documents"))
    count = [F.size(F.filter("spans", same(kind))).cast("bigint").alias(f"n_{kind}")
             for kind in pii.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


# ---------------------------------------------------------------- quality rules

@register("op8_quality_log_ratio")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf, "labels")))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


# ---------------------------------------------------------------- exact search

@register("op5_term_at_a_time", """
    with v as (
        select vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as w
        from embeddings
        where vec_id is not null and embedding is not null
          and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
    s as (
        select q.vec_id as query_id, c.vec_id,
               cast(list_inner_product(cast(q.w as double[]), cast(c.w as double[])) as bigint) as score
        from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
    r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5""")
def op5(spark, sf):
    return search.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


# ---------------------------------------------------------------- toxicity

@register("op10_ftrl_toxicity")
def op10(spark, sf):
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


# ---------------------------------------------------------------- mixing

@register("op1_pfair_mix", """
    with recursive d as (
        select doc_id, source, coalesce('=' || source, '') as key, length(coalesce(text, '')) as size,
               md5(coalesce(cast(doc_id as varchar), '') || ':' || cast(length(coalesce(text, '')) as varchar)) as digest
        from documents),
    p as (
        select *, coalesce(sum(size) over (partition by key order by digest, doc_id
                           rows between unbounded preceding and 1 preceding), 0) as start from d),
    w as (select key, pow(greatest(sum(size), 1), 0.5) as w from d group by key),
    a0 as (select key, cast(case when bool_and(w = round(w)) over () and sum(w) over () <= 100000 then w else
               greatest(1, round(least(greatest(ceil(16 * sum(w) over () / min(w) over ()), 2000), 100000) * w / sum(w) over ())) end
             as bigint) as share from w),
    a as (select key, case when (select count(distinct share) from a0) > 256
                      then cast(round(pow(2e0, round(log2(share) * 64) / 64)) as bigint) else share end as share from a0),
    s as (select list(key order by share, key) as keys, list(share order by share, key) as sh, cast(sum(share) as bigint) as q,
                 count(*) as n from a),
    e as (
        select cast(0 as bigint) as t, [cast(0 as bigint) for i in range(1, n + 1)] as done, cast(null as bigint) as pick from s
        union all
        select t + 1, [done[i] + case when i = pick then 1 else 0 end for i in range(1, n + 1)], pick from (
            select t, done, n, list_min([ceil((done[i] + 1) * q / sh[i])::bigint * (n + 1) + i for i in range(1, n + 1)
                if done[i] < sh[i] and floor(done[i] * q / sh[i]) <= t]) % (n + 1) as pick
            from e, s where t < q)),
    f as (select keys[pick] as key, t - 1 as slot from e, s where pick is not null),
    g as (select key, slot, row_number() over (partition by key order by slot) - 1 as j from f),
    b as (select p.*, a.share, s.q, cast(floor(start / 65536) as bigint) as block from p join a using (key), s)
    select doc_id, source, cast(start as bigint) as start, block,
           cast((block // share) * q + floor((block % share) * q / share) as bigint) as release,
           cast((block // share) * q + ceil((block % share + 1) * q / share) as bigint) as deadline,
           cast((block // share) * q + g.slot as bigint) as slot
    from b join g on g.key = b.key and g.j = block % share""")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return mixing.mix(docs, F.col("size")).select("doc.doc_id", "source", "start", "block", "release", "deadline", "slot")


# ---------------------------------------------------------------- web archives

@register("op9_warc_index")
def op9(spark, sf):
    folder = scratch_path(spark, "warc")
    pages = table(spark, sf, "pages")
    warc.write(pages, folder)
    return warc.read(pages.select(warc.url_key(F.col("url")).alias("key")), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---------------------------------------------------------------- main text of pages

@register("op7_lstm_main_text")
def op7(spark, sf):
    pages = table(spark, sf, "pages")
    return htmltext.extract(pages, htmltext.fit(pages)).withColumn("n_chars", F.length("text").cast("bigint"))


# ---------------------------------------------------------------- source divergence

@register("op11_source_divergence", r"""
    with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    t as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    c as (select lang, source, term, count(*) as n, count(distinct rid) as docs from t group by all),
    k as (select lang, term, cast(sum(n) as bigint) as lang_n from c group by all having sum(docs) >= 30),
    g as (select distinct lang, source from d),
    v as (select lang, count(*) as v, sum(lang_n) as total from k group by lang),
    s as (select lang, source, sum(n) as total from c semi join k using (lang, term) group by all),
    h as (select g.lang, g.source, coalesce(s.total, 0) as total, v.v, v.total as lang_total
          from g left join s using (lang, source) left join v using (lang)),
    p as (select h.lang, h.source, k.term, coalesce(c.n, 0) as n,
                 1 + (cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 5)) // (h.total + 5 * h.v) as p,
                 1 + (cast(1000000000 as hugeint) * (k.lang_n + 5)) // (h.lang_total + 5 * h.v) as q
          from h join k using (lang) left join c on c.lang = h.lang and c.source = h.source and c.term = k.term),
    f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    u as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(f.value, 0) as bigint) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
          union all select lang, source, 'term', term, cast(p - q as bigint) from p where n > 0 and p > q),
    r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from u)
    select * from r where part = 'pair' or rank <= 50""")
def op11(spark, sf):
    return divergence.audit(table(spark, sf, "documents"), least_docs=30, terms=50)


# ---------------------------------------------------------------- ranked search

@register("op12_ball_tree_search", r"""
    with d as (select row_number() over () as rid, doc_id,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    i as (select item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
          from benchmark),
    t as (select rid, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    q as (select distinct item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from i),
    c as (select rid, doc_id, term, count(*) as tf from t group by all),
    l as (select rid, cast(sum(tf) as bigint) as n from c group by rid),
    s as (select count(*) as docs, cast(sum(n) as bigint) as total from l),
    w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from c, s group by term, docs),
    x as (select rid, doc_id, term,
                 w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) as x
          from c join l using (rid) join w using (term), s),
    r as (select item_id, doc_id, rid, cast(sum(x) as bigint) as score from q join x using (term) group by all having sum(x) > 0),
    k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank,
                 doc_id, score from r)
    select * from k where rank <= 10""")
def op12(spark, sf):
    return balltree.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)


# ---------------------------------------------------------------- quality classifier

@register("op13_nbsvm_quality")
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    scored = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", nbsvm.held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
