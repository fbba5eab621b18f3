"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chats, collocations, decontaminate, html_text, langid, licenses, minhash, prefix_bpe, simhash, token_files, url_lists, vector_codes
from .shared import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = prefix_bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    said = langid.predict(docs, model)
    return said.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


def captures(pages: DataFrame) -> DataFrame:
    """A fetch date for every page, from its URL and id: the tables have none."""
    day = (F.col("page_id") * 37 + F.length("url") * 11) % 730
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day.cast("int")).alias("fetched_on"))


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated block list, from the hosts of all pages: each host is added and removed in turn, twice."""
    host = F.regexp_extract("url", r"^[a-z]+://(\[[^/?#\]]*\]|[^/?#:]+)", 1)
    hosts = pages.select(host.alias("domain")).where("domain <> ''").distinct()
    n = F.length("domain") * 29 + F.ascii(F.substring("domain", 5, 1)) * 13 + F.ascii(F.substring("domain", 8, 1)) * 7
    turns = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(i % 2 == 0).alias("listed")) for i in range(4)))).alias("t")
    day = (n % 97 + F.col("t.i") * (n % 113 + 40)).cast("int")
    return hosts.select("domain", n.alias("n"), turns).select(
        "domain", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("listed_on"), F.col("t.listed").alias("listed")
    )


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_lists.judge(captures(pages), list_changes(pages))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_prefix_bpe, op3_nearest_vectors, op4_license_scan, op5_language_id, op6_chat_formatting, op7_url_lists,
        op8_decontamination, op9_html_text, op10_simhash, op11_collocations, op12_minhash, op13_vector_codes, pipeline,
    )
}


def _vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds as common table expressions one after another; a row for each component."""
    steps = [
        """with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x))))""",
        f"""x as materialized (select vec_id, (i - 1) * {parts} // len(v) as part, i as pos, v[i] as x
  from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from kept))""",
        f"""starts as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {entries})""",
        "book0 as materialized (select part, entry, pos, x as e from x join starts using (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""code{r} as materialized (
  select vec_id, part, min(d * {entries} + entry) % {entries} as entry, min(d) as d
  from (select vec_id, x.part, entry, sum((x - e) * (x - e)) as d from x join book{r} b on b.part = x.part and b.pos = x.pos group by vec_id, x.part, entry)
  group by vec_id, part)"""
        )
        if r < rounds:
            steps.append(
                f"""book{r + 1} as materialized (
  select b.part, b.entry, b.pos, coalesce(m.e, b.e) as e from book{r} b left join (
    select part, entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as e
    from x join code{r} using (vec_id, part) group by part, entry, pos) m using (part, entry, pos))"""
            )
    steps.append(
        f"""coded as (select vec_id, string_agg(printf('%02x', cast(entry as integer)), '' order by part) as code, cast(sum(d) as bigint) as error
  from code{rounds} group by vec_id)"""
    )
    return ", ".join(steps) + f"""
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(e as varchar), ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256
from coded join kept using (vec_id)"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_literal(k)}, {_literal(v)})" for k, forms in licenses.EVERY.items() for v in forms)

ORACLE_SQL = {
    "op4_license_scan": f"""
with templates(license, body) as (values {_TEMPLATES}),
words as (select license, regexp_extract_all(lower(body), '[a-z0-9]+') as w from templates),
own as (select license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from words),
units as (
  select distinct doc_id, unit from (
    select doc_id, unnest(string_split(text, chr(10))) as unit from documents
    union all select doc_id, unnest(string_split(text, chr(10) || chr(10))) from documents
    union all select doc_id, text from documents)),
cut as (select doc_id, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') as w from units),
pairs as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from cut where len(w) > 1),
scored as (
  select p.doc_id, p.unit, o.license, 2.0 * len(list_intersect(p.b, o.b)) / (len(p.b) + len(o.b)) as dice
  from pairs p join own o on len(p.b) * 1.5 + 1 >= len(o.b) and len(o.b) * 1.5 + 1 >= len(p.b))
select doc_id, license, round(max(dice), 6) as dice, count(distinct unit) as n_units from scored where dice >= 0.8 - 1e-12 group by doc_id, license
""",
    "op6_chat_formatting": """
with turns as (
  select conv_id, turn, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as said from conversations),
whole as (select conv_id, count(*) as n_turns, string_agg(said, '' order by turn) as chat from turns group by conv_id),
firsts as (select min(conv_id) as conv_id, n_turns, chat from whole group by n_turns, chat)
select conv_id, n_turns, chat from firsts a
where not exists (select 1 from firsts b where b.n_turns > a.n_turns and starts_with(b.chat, a.chat))
""",
    "op7_url_lists": r"""
with hosts as (select distinct regexp_extract(url, '^[a-z]+://(\[[^/?#\]]*\]|[^/?#:]+)', 1) as domain from pages),
numbered as (
  select domain, length(domain) * 29 + ascii(substring(domain, 5, 1)) * 13 + ascii(substring(domain, 8, 1)) * 7 as n from hosts where domain <> ''),
changes as (
  select domain, date '2023-01-01' + cast(n % 97 + i * (n % 113 + 40) as integer) as listed_on, i % 2 = 0 as listed
  from numbered, (values (0), (1), (2), (3)) t(i)),
daily as (select domain, listed_on, bool_and(listed) as listed from changes group by domain, listed_on),
caps as (
  select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]+)', 1)) as host,
    date '2023-01-01' + cast((page_id * 37 + length(url) * 11) % 730 as integer) as fetched_on
  from pages),
pairs as (
  select c.page_id, c.fetched_on, d.domain, d.listed,
    row_number() over (partition by c.page_id, d.domain order by d.listed_on desc) as r
  from caps c join daily d on (c.host = d.domain or ends_with(c.host, '.' || d.domain) and not regexp_matches(c.host, '^\[|^[0-9.]+$')) and d.listed_on <= c.fetched_on),
active as (select page_id, domain from pairs where r = 1 and listed)
select c.page_id, count(a.domain) > 0 as blocked, count(a.domain) as n_entries, arg_max(a.domain, length(a.domain)) as matched
from caps c left join active a on a.page_id = c.page_id group by c.page_id
""",
    "op11_collocations": r"""
with low as (select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) as piece from low),
words as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
total as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
grams as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from words, (values (1), (2), (3), (4)) k(m) where len(w) >= m),
f as materialized (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= 30),
cands as materialized (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1),
cuts as (
  select c.lang, c.phrase, c.m, c.a, c.w, k, x.f as l, y.f as r, cast(2000000 * cast(c.a as hugeint) // (x.f + y.f) as bigint) as score
  from (select *, unnest(range(1, m)) as k from cands) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[k + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
subs as (
  select lang, a as longer, array_to_string(w[i:i + s - 1], ' ') as phrase
  from (select *, unnest(range(1, m - s + 2)) as i from (select *, unnest(range(2, m)) as s from cands where m > 2))),
gone as (select lang, phrase, max(longer) as longer from subs group by lang, phrase),
kept as (select b.* from best b left join gone g using (lang, phrase) where g.longer is null or 100 * g.longer < 80 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000
""",
    "op12_minhash": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) > 1 then list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) when len(w) = 1 then w else [] end as s
  from words),
own as materialized (select doc_id, s, len(s) as n from sets),
kinds as materialized (select s, n, min(doc_id) as rep from own where n > 0 group by s, n),
grams as materialized (select rep, n, unnest(s) as g from kinds),
rare as (select rep, n, g, row_number() over (partition by rep order by c, g) as i from grams join (select g, count(*) as c from grams group by g) using (g)),
prefix as materialized (select rep, n, g from rare where i <= n - cast(ceil(0.8 * n - 1e-9) as bigint) + 1),
cands as materialized (select distinct a.rep as a, b.rep as b from prefix a join prefix b on a.g = b.g and a.rep < b.rep and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
links as (
  select a, b from (select c.a, c.b, x.n + y.n as total, len(list_intersect(x.s, y.s)) as same from cands c join kinds x on x.rep = c.a join kinds y on y.rep = c.b)
  where 100 * same >= 80 * (total - same)),
edges as materialized (select a, b from links union all select b, a from links),
reach(node, low) as (select rep, rep from kinds union select b.b, r.low from reach r join edges b on b.a = r.node where r.low < b.b),
comps as (select node, min(low) as low from reach group by node)
select o.doc_id, cast(o.n as bigint) as n_shingles, coalesce(c.low, o.doc_id) as component_id, coalesce(c.low, o.doc_id) = o.doc_id as kept
from own o left join kinds k on o.s = k.s left join comps c on c.node = k.rep
""",
    "op13_vector_codes": _vector_codes_sql(),
    "op8_decontamination": r"""
with item_words as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark),
item_grams as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from item_words where len(w) > 0),
sizes as (select item_id, count(*) as q from item_grams group by item_id),
doc_words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
doc_grams as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) as s
  from doc_words where len(w) > 0),
shared as (select doc_id, item_id, count(*) as n from doc_grams join item_grams using (s) group by doc_id, item_id)
select doc_id, item_id, q as n_shingles, n as n_shared, round(n / q, 6) as containment
from shared join sizes using (item_id) where n >= 0.8 * q - 1e-9
""",
}
