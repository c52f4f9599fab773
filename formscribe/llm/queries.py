"""The registered queries of this package, with their checking SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from formscribe.llm import chat, decontaminate, divergence, importance, licenses, mixing, near, parsing, prefix_forest, quality, spans, token_files, urls
from formscribe.plans.views import load
from formscribe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_RULE_ROWS = ", ".join(str(r) for r in RULES)

URL_SQL = rf"""
with rest as (
  select row_number() over () as k, page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
parts as (
  select k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rest),
rules(rule_host, rule_path, rule_verdict) as (values {_RULE_ROWS}),
fits as (
  select k, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by k order by length(rule_host || rule_path) desc, length(rule_host) desc,
                            rule_verdict desc) as place
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
from parts left join (select * from fits where place = 1) f on parts.k = f.k"""


@query("op8_url_filters", URL_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return urls.judge_urls(load(spark, sf_dir, "pages"), rules)


_PROBE = "</s>[INST] ok [/INST]"

CHAT_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0::bigint, 'user', '{_PROBE}'), (-7::bigint, 1::bigint, 'assistant', '{_PROBE}')),
escaped as (
  select *, regexp_replace(role, '{chat.CONTROL}', '\1\\\2\3', 'g') as e_role,
         regexp_replace(text, '{chat.CONTROL}', '\1\\\2\3', 'g') as e_text from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(e_role) + length(e_text) + {len(chat.OPEN + chat.MID + chat.CLOSE)})::bigint as formatted_chars
from escaped group by conv_id"""


@query("op3_chat_formatting", CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], "conv_id long, turn long, role string, text string")
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    records = given.unionByName(probe).select("conv_id", "turn", record.alias("record"))
    turns = (
        chat.canonical_turns(records, ["conv_id", "turn"], "record")
        .select("conv_id", "turn", F.posexplode("turns").alias("part", "t"))
        .select("conv_id", "turn", "part", "t.role", "t.text")
    )
    out = chat.format_turns(turns, "conv_id", ["turn", "part"])
    read = out.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op10_license_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


@query("op1_source_mix")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(load(spark, sf_dir, "documents"), whole=True)


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op5_document_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.edited_documents(load(spark, sf_dir, "documents"))


SPAN_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, p, array_to_string(w[p:p + 49], ' ') as body
  from words, unnest(range(1, greatest(len(w) - 48, 1))) as t(p)),
firsts as (select body, min(doc_id) as least from windows group by body),
gone as (
  select distinct doc_id, p + o as at
  from (select w.doc_id, w.p from windows w join firsts f using (body) where f.least < w.doc_id), unnest(range(50)) as t(o)),
each as (select doc_id, i, w[i] as word from words, unnest(range(1, len(w) + 1)) as t(i))
select d.doc_id, len(d.w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from words d
left join (select doc_id, count(*) as n from gone group by doc_id) g on g.doc_id = d.doc_id
left join (
  select e.doc_id, string_agg(e.word, ' ' order by e.i) as kept
  from each e left join gone x on x.doc_id = e.doc_id and x.at = e.i
  where x.at is null group by e.doc_id) k on k.doc_id = d.doc_id"""


@query("op6_substring_dedup", SPAN_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeated_spans(load(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = scratch_path(spark, "token-files")
    manifest = token_files.write_token_files(load(spark, sf_dir, "documents"), tokenizer_path(), out_dir)
    return token_files.read_token_files(manifest, out_dir)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_ngram_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(load(spark, sf_dir, "documents")).drop("text_hash", "set_digest")


DIVERGENCE_SQL = rf"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
words as (select r, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct r) >= {divergence.LEAST_DOCS}),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
found as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
named as (select distinct lang, source from docs),
cells as (
  select g.lang, g.source, k.term, coalesce(f.n, 0) as n, k.n as lang_n,
         sum(coalesce(f.n, 0)) over (partition by g.lang, g.source) as total
  from named g join kept k on k.lang = g.lang
  left join found f on f.lang = g.lang and f.source = g.source and f.term = k.term),
shares as (
  select c.lang, source, term, n, (1 + (1000000000::hugeint * (n + 2)) // (c.total + 2 * v)::hugeint)::bigint as p,
         (1 + (1000000000::hugeint * (lang_n + 2)) // (l.total + 2 * v)::hugeint)::bigint as q
  from cells c join langs l on l.lang = c.lang),
apart as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from named a join named b on a.lang = b.lang and a.source <> b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {divergence.SHOWN}"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(load(spark, sf_dir, "documents"))


RESAMPLING_SQL = r"""
with crc as (
  select list(list_reduce(list_prepend(i, range(8)),
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) t(i)),
words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
target as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
found as (select r, unnest(w) as word from words),
wanted as (select unnest(w) as word from target),
hexed as (select word, hex(encode(word)) as h from (select distinct word from found union select distinct word from wanted)),
buckets as (
  select word,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
             lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as bucket
  from hexed, crc),
have as (select bucket, count(*) as n from found join buckets using (word) group by bucket),
want as (select bucket, count(*) as n from wanted join buckets using (word) group by bucket),
gains as (
  select b.bucket,
         floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (coalesce((select sum(n) from have), 0) + 10000)
                         / ((coalesce(s.n, 0) + 1)::double * (coalesce((select sum(n) from want), 0) + 10000))))::bigint as gain
  from range(10000) b(bucket) left join have s on s.bucket = b.bucket left join want t on t.bucket = b.bucket),
sums as (select r, count(*) as n, sum(gain)::bigint as total from found join buckets using (word) join gains using (bucket) group by r),
scored as (
  select w.r, doc_id, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h
  from words w left join sums s on s.r = w.r),
final as (select r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from scored),
drawn as (
  select r, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as n
  from final where n_features >= 20)
select doc_id, n_features, weight, score, place as rank
from final left join (select * from drawn where place <= 10 * n // 100) d on d.r = final.r"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op13_prefix_forest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest_neighbours(load(spark, sf_dir, "embeddings"))
