"""Queries that apply the operators of this subpackage to whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import decontamination, html_extraction, language_id, lm_scoring, ngram_join, packing, quality, secrets, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secret_scanner())


def secret_scanner() -> secrets.Scanner:
    words = secrets.vocabulary(tokenizer_path())
    return secrets.train(secrets.labelled_findings(words=words), words)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontamination.judge(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def held_out() -> F.Column:
    """Documents that language models never learn from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_model(docs: DataFrame) -> language_id.Model | None:
    return language_id.train(language_id.gather(docs.filter(~held_out()).select("text", "lang")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_model(docs), carry=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return lm_scoring.score(table(spark, sf_dir, "documents"), good)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def warc_records(pages: DataFrame) -> DataFrame:
    """A response and two revisits for each page: validators that hold, differ or lack, times before and after, URLs written in other ways."""
    p, i = pages.select("page_id", "url", "html"), F.col("page_id")
    at = F.timestamp_seconds(F.lit(1704067200) + i * 2220)
    tag, digest = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.sha2("html", 256)
    none, text_map = F.lit(None).cast("string"), "map<string,string>"
    response = p.select(
        (i * 4).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.when(i % 17 == 5, 404).otherwise(200).alias("status"), tag.alias("etag"), digest.alias("digest"),
        (at - F.expr("interval 1 day")).alias("last_modified"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("ETag"), tag).cast(text_map).alias("headers"),
    )

    def revisit(k: int) -> DataFrame:
        when = at + F.make_dt_interval((i % 5 - 1 + k).cast("int"))
        other = F.regexp_replace(F.regexp_replace("url", "^https?://", "HTTP://WWW."), "#.*$", "")
        new_tag = F.when((i + k) % 13 < 3, none).when(i % 7 == 0, F.lit('"other"')).when(i % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
        return p.select(
            (i * 4 + k).alias("record_id"), (F.concat(other, F.lit("#visit")) if k == 1 else F.col("url")).alias("url"), when.alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), new_tag.alias("etag"),
            F.when((i + k) % 13 == 0, digest).alias("digest"), F.when((i + k) % 13 < 2, at).alias("last_modified"),
            F.create_map(F.lit("Date"), F.date_format(when, "yyyy-MM-dd"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("Set-Cookie"), F.lit("a=b")).cast(text_map).alias("headers"),
        )

    return response.unionByName(revisit(1)).unionByName(revisit(2))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(warc_records(table(spark, sf_dir, "pages")))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return done.select("record_id", "u", "answer", "outcome", pairs.alias("merged"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_secret_scan, op3_decontamination, op4_language_id, op5_lm_scoring, op6_packing, op7_html_extraction, op8_quality_rules, op9_warc_revisits, op10_ngram_jaccard_join)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"[\x20\x09-\x0D]"

ORACLE = {
    "op3_decontamination": rf"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bl as (select *, least(13, len(w)) as l from b where len(w) > 0),
bg as (select distinct item_id, l, array_to_string(w[i : i + l - 1], ' ') as g from (select *, unnest(range(1, len(w) - l + 2)) as i from bl)),
ls as (select distinct l from bl),
dg as (select doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') as g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, ls where len(w) >= l)),
h as (select dg.doc_id, dg.i, dg.l, bg.item_id from dg join bg on dg.g = bg.g and dg.l = bg.l),
p as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + l)) as k from (select distinct doc_id, i, l from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join p using (doc_id) left join t using (doc_id)""",
    "op8_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
c as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 8)) as k from r) group by doc_id),
m as (select doc_id, t, w, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '{_SPACES}', '', 'g')) as bigint) as word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words from l left join c using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not (base_failed or word_chars < 2 * n_words or word_chars > 12 * n_words or 10 * n_symbols > n_words or (n_dup_lines >= 3 and 10 * n_dup_lines > 3 * len(string_split(t, chr(10))))
  or 3 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > n_words
  or (regexp_matches(t, '[A-Z]') and not regexp_matches(t, '[a-z]')) or 2 * length(regexp_replace(t, '[^0-9]', '', 'g')) > word_chars
  or 10 * len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}]'))) > 9 * len(string_split(t, chr(10)))) as kept
from f""",
    "op10_ngram_jaccard_join": rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, g from (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end as gs from d), unnest(gs) as u(g)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
both_ways as (select x, y from e union all select y, x from e),
r(x, y) as (select doc_id, doc_id from d union select r.x, e.y from r join both_ways e on r.y = e.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.component_id from d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from r group by x) m using (doc_id)""",
    "op9_warc_revisits": r"""
with base as (select page_id as i, url, html, make_timestamp((1704067200 + page_id * 2220) * 1000000) as t0, '"' || md5(html) || '"' as tag, sha256(html) as digest from pages),
k(k) as (values (1), (2)),
rec as (select i * 4 + k as record_id, case when k = 1 then regexp_replace(regexp_replace(url, '^https?://', 'HTTP://WWW.'), '#.*$', '') || '#visit' else url end as url,
  t0 + to_days(cast(i % 5 - 1 + k as integer)) as ts,
  case when (i + k) % 13 < 3 then null when i % 7 = 0 then '"other"' when i % 2 = 0 then 'W/' || tag else tag end as etag,
  case when (i + k) % 13 = 0 then digest end as digest, case when (i + k) % 13 < 2 then t0 end as last_modified from base, k),
canon as (select record_id, ts, etag, digest, last_modified, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') as rest from rec
 union all select i * 4, t0, tag, digest, t0 - to_days(1), url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') from base where i % 17 <> 5),
u as (select *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
  || case when len(qs) > 0 then '?' || array_to_string(qs, '&') else '' end as u
  from (select *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref)='))) as qs from canon)),
q as (select * from u where record_id % 4 <> 0), f as (select * from u where record_id % 4 = 0),
a as (select q.*, (select max(struct_pack(ts := f.ts, rid := f.record_id)) from f where f.u = q.u and f.ts < q.ts).rid as rid from q),
j as (select a.*, f.etag as r_etag, f.digest as r_digest, f.last_modified as r_lm from a left join f on f.record_id = a.rid),
o as (select *, case when rid is null then 'no-response' when etag is null and digest is null and last_modified is null then 'no-validator'
  when case when etag is not null then regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', '') when digest is not null then digest = r_digest else r_lm <= last_modified end then 'resolved' else 'validator-mismatch' end as outcome from j)
select record_id, u, case when outcome = 'resolved' then rid end as answer, outcome,
 case when outcome = 'resolved' then 'cache-control=max-age=120;content-type=text/html;date=' || strftime(ts, '%Y-%m-%d') || ';etag=' || r_etag end as merged from o""",
}
