"""Validation against stored vectors, with an encoder that the checking SQL can repeat."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formscribe.operators import neighbours as N
from formscribe.operators import validate as D
from formscribe.operators.keys import add_composite_key
from formscribe.operators.profile import KEY
from formscribe.operators.vectors import Encoder, embed_values
from formscribe.plans import duck
from formscribe.plans.catalog import query
from formscribe.plans.catalog.rules import hints_cte, normalized_ctes
from formscribe.plans.catalog.profiles import profile_cte
from formscribe.plans.catalog.validation import AS_OF, learnt
from formscribe.plans.views import sql_view, view
from formscribe.session import cut_lineage, scratch_path
from formscribe.streaming import streams as R

CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyz"


def counting_encoder() -> Callable[[], Encoder]:
    """How often each digit and each letter of the Latin alphabet stands in a text."""

    def load() -> Encoder:
        return lambda texts: np.array([[t.lower().count(c) for c in CHARACTERS] for t in texts], dtype=np.float32).reshape(len(texts), -1)

    return load


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values, new ones, new ones in a wrong form, texts like no value, unknown keys and malformed keys."""
    parts = view(spark, sf_dir, "v_parts")
    three = F.array("key_part1", "key_part2", "key_part3")
    new = parts.where("row_id % 3 = 0")

    def of(name: str, rows: DataFrame, value: Column, key_parts: Column = three) -> DataFrame:
        return rows.select(F.concat(F.lit(f"{name}-"), F.col("row_id").cast("string")).alias("request_id"), key_parts.alias("key_parts"), value.alias("value"))

    asked = [
        of("stored", parts.where("row_id % 3 = 1"), F.col("value")),
        of("new", new, F.col("value")),
        of("odd", new, F.concat(F.lit("~"), F.col("value"), F.lit("7"))),
        of("far", new, F.lit("~ zq")),
        of("customers", view(spark, sf_dir, "v_customers"), F.col("value")),
        of("pages", view(spark, sf_dir, "v_pages"), F.col("value"), F.array("key_part1", "key_part2")),
    ]
    out = asked[0]
    for rows in asked[1:]:
        out = out.unionByName(rows)
    return out


_VECTOR = "list_transform([{chars}], lambda c: cast(length(lower({text})) - length(replace(lower({text}), c, '')) as double))"


def _vector(text: str) -> str:
    return _VECTOR.format(chars=", ".join(f"'{c}'" for c in CHARACTERS), text=duck.strip(f"coalesce({text}, '')"))


_NEAR = f"""{profile_cte('parts', 2, 5.0)}, {hints_cte()},
    reqs as (
      select 'stored-' || row_id as request_id, 3 as n_parts, {duck.key()} as composite_key, value from v_parts where row_id % 3 = 1
      union all select 'new-' || row_id, 3, {duck.key()}, value from v_parts where row_id % 3 = 0
      union all select 'odd-' || row_id, 3, {duck.key()}, '~' || value || '7' from v_parts where row_id % 3 = 0
      union all select 'far-' || row_id, 3, {duck.key()}, '~ zq' from v_parts where row_id % 3 = 0
      union all select 'customers-' || row_id, 3, {duck.key()}, value from ({sql_view('v_customers')})
      union all select 'pages-' || row_id, 2, null, value from ({sql_view('v_pages')})),
    src as (select r.*, p.composite_key is not null as known, p.candidate_regex, h.* exclude (composite_key)
            from reqs r left join prof p on r.composite_key = p.composite_key left join hints h on r.composite_key = h.composite_key),
    {normalized_ctes('src')},
    prep as (select *, case when candidate_regex is null then true else {duck.matches_prefix('normalized', 'candidate_regex')} end as format_ok from normed),
    vecs as (select distinct {duck.key()} as composite_key, value, {_vector('value')} as v from v_parts where row_id % 3 > 0),
    asked as (select distinct composite_key, normalized, {_vector('normalized')} as v from prep where known and normalized is not null),
    pairs as (select a.composite_key, a.normalized, list_cosine_similarity(a.v, s.v) as sim from asked a join vecs s on a.composite_key = s.composite_key),
    dups as (select composite_key, normalized, max(sim) as similarity from pairs where sim >= 0.82 group by 1, 2)"""


def _duplicates(spark: SparkSession, sf_dir: str, prepared: DataFrame) -> DataFrame:
    stored = embed_values(add_composite_key(view(spark, sf_dir, "v_parts").where("row_id % 3 > 0")), counting_encoder())
    return N.duplicate_check(prepared, cut_lineage(stored), counting_encoder())


@query("duplicate_values", f"{_NEAR} select composite_key, normalized, round(similarity, 6) as similarity from dups")
def duplicate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested values with a stored neighbour, through encoder, search and grouping."""
    profiles, rules = learnt(spark, sf_dir)
    prepared = D.prepare_requests(_requests(spark, sf_dir), profiles, rules).where(F.col("known"))
    return _duplicates(spark, sf_dir, prepared).select(KEY, "normalized", F.round("similarity", 6).alias("similarity"))


_VERDICTS = f"""{_NEAR}, j as (select p.*, d.similarity as s, coalesce(s > 0.95, false) as same, coalesce(s > 0.85 and s <= 0.95, false) as near,
      not format_ok as bad from prep p left join dups d on p.composite_key = d.composite_key and p.normalized = d.normalized)
    select request_id, composite_key, value as original_value,
      case when n_parts <> 3 then 'rejected' when not known then 'needs_review' when same then 'duplicate' when not bad and not near then 'accepted'
           when bad and s is not null then 'reformatted' when near then 'duplicate' else 'accepted' end as verdict,
      case when n_parts <> 3 then 'invalid_key_parts' when not known then 'unknown_key'
           else concat_ws('|', case when bad and not same then 'format_mismatch' end, case when same or near then 'near_duplicate' end) end as issues,
      coalesce(n_parts = 3 and known and bad and not same and s is not null, false) as has_fix,
      round(case when n_parts <> 3 or not known then 0.0 when same then s
                 else (case when near then 0.8 else 1.0 end) * (case when bad then 0.6 else 1.0 end) end, 6)::double as confidence
    from j"""


def _flat(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "request_id", KEY, "original_value", "verdict", F.array_join("issues", "|").alias("issues"),
        F.col("suggested_fix").isNotNull().alias("has_fix"), F.round("confidence", 6).alias("confidence"),
    )


@query("every_verdict", _VERDICTS)
def every_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole validation plan with neighbours; which of equally near values is suggested is left open."""
    profiles, rules = learnt(spark, sf_dir)
    asked = _requests(spark, sf_dir)
    prepared = D.prepare_requests(asked, profiles, rules).where(F.col("known"))
    duplicates = _duplicates(spark, sf_dir, prepared)
    return _flat(D.validate_values(asked, profiles, rules, duplicates, as_of=F.lit(AS_OF).cast("timestamp")))


@query("stream_every_verdict", _VERDICTS)
def stream_every_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream of several micro-batches."""
    profiles, rules = learnt(spark, sf_dir)
    path, out = scratch_path(spark, "requests"), scratch_path(spark, "verdicts")
    asked = _requests(spark, sf_dir)
    asked.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 2).parquet(path)
    near = lambda prepared: _duplicates(spark, sf_dir, prepared)
    R.validation_stream(stream, profiles, cut_lineage(rules), f"{out}/table", f"{out}/progress", near, availableNow=True).awaitTermination()
    return _flat(spark.read.parquet(f"{out}/table"))
