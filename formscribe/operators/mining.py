"""Training examples mined from values: labels, pairs, triplets, changed forms and format variants.

Pairs inside a group are never listed whole. Triplets are stored factored, one row per anchor, and expanded
only up to the wanted number.
"""
from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formscribe.config import Settings
from formscribe.functions import text
from formscribe.operators.blocks import block_pairs, constants, map_groups, numbers, strings
from formscribe.operators.profile import KEY
from formscribe.operators.ranking import number_items, top_per_group


def changed_examples(df: DataFrame) -> DataFrame:
    """(original, normalized) of every value that trimming and lower-casing changes."""
    normalized = text.basic_form(F.col("value"))
    return (
        df.withColumn("normalized", normalized)
        .where(F.col("normalized") != F.col("value"))
        .withColumnRenamed("value", "original")
    )


def learnt_transformations(examples: DataFrame, least_share: float = 0.1) -> DataFrame:
    """Transformations used in more than 10 % of the examples: name, frequency, confidence."""
    kinds = examples.select(text.transformation_kind(F.col("original"), F.col("normalized")).alias("name"))
    counted = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("frequency"))
    total = kinds.agg(F.count(F.lit(1))).scalar()
    shares = counted.withColumn("confidence", F.col("frequency") / total)
    return shares.where(F.col("name").isNotNull() & (F.col("confidence") > least_share))


def signature_labels(values: DataFrame) -> DataFrame:
    """Values with a 0-based label per signature of their key, numbered in signature order."""
    signatures = values.select(KEY, "sig").distinct()
    numbered = number_items(signatures, [KEY], "sig", "label")
    return values.join(numbered, [KEY, "sig"])


def hash_share(identity: Column, seed: int = Settings.seed, buckets: int = 100) -> Column:
    """Bucket number of a row that depends on its content only, not on partitions or order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), identity.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(buckets))


def split_rows(df: DataFrame, identity: Column, train_percent: int = 80, seed: int = Settings.seed) -> DataFrame:
    """Adds `split`: train or test."""
    return df.withColumn("split", F.when(hash_share(identity, seed) < train_percent, F.lit("train")).otherwise(F.lit("test")))


def triplet_anchors(values: DataFrame) -> DataFrame:
    """One row per anchor: key, sig, anchor, n_positives (other values of its signature), negative.

    The negative is the smallest value of the key's smallest other signature. The positives of an anchor are
    the other rows with its (key, sig), so this table holds every triplet without listing them.
    """
    groups = values.groupBy(KEY, "sig").agg(F.count(F.lit(1)).alias("members"), F.min("value").alias("least"))
    two = top_per_group(groups.select(KEY, "sig", "least"), [KEY], [F.col("sig")], 2)
    leading = two.groupBy(KEY).agg(
        *[F.max(F.when(F.col("rank") == r, F.struct("sig", "least"))).alias(f"s{r}") for r in (1, 2)]
    )
    negative = F.when(F.col("sig") == F.col("s1.sig"), F.col("s2.least")).otherwise(F.col("s1.least"))
    usable = groups.join(leading, KEY).where((F.col("members") > 1) & F.col("s2").isNotNull())
    usable = usable.select(KEY, "sig", (F.col("members") - 1).alias("n_positives"), negative.alias("negative"))
    return values.join(usable, [KEY, "sig"]).select(KEY, "sig", F.col("value").alias("anchor"), "n_positives", "negative")


def first_triplets(values: DataFrame, limit: int = 1000) -> DataFrame:
    """The first `limit` triplets in the order key, sig, anchor, positive.

    Every anchor has a positive, so the first `limit` anchors and `limit` + 1 members per group suffice.
    """
    anchors = triplet_anchors(values).orderBy(KEY, "sig", "anchor").limit(limit)
    wanted = anchors.select(KEY, "sig").distinct()
    members = values.join(wanted, [KEY, "sig"], "left_semi").select(KEY, "sig", F.col("value").alias("positive"))
    members = top_per_group(members, [KEY, "sig"], [F.col("positive")], limit + 1).drop("rank")
    paired = anchors.join(members, [KEY, "sig"]).where(F.col("anchor") != F.col("positive"))
    return paired.orderBy(KEY, "sig", "anchor", "positive").limit(limit).select(KEY, "sig", "anchor", "positive", "negative")


def _rare_first_characters(values: DataFrame) -> DataFrame:
    """Each value with its size and the leading third of its (character, occurrence) tokens, rarest first.

    Two values whose matched characters make up more than 0.8 of their mean size share such a token: more
    than two thirds of the tokens of either one are common.
    """
    characters = values.select(KEY, "value", F.explode(F.split(F.lower("value"), "")).alias("c"))
    counted = characters.groupBy(KEY, "value", "c").agg(F.count(F.lit(1)).alias("m"))
    tokens = counted.select(
        KEY, "value", F.explode(F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.concat("c", i.cast("string")))).alias("token")
    )
    frequency = tokens.groupBy(KEY, "token").agg(F.count(F.lit(1)).alias("df"))
    ordered = tokens.join(frequency, [KEY, "token"]).groupBy(KEY, "value").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")
    )
    size = F.size("t")
    return ordered.select(
        KEY, "value", size.alias("size"), F.slice("t", F.lit(1), F.ceil(size / 3).cast("int")).alias("prefix")
    )


def similar_texts(values: DataFrame, least: float = 0.8, measure: str = "ratcliff", settings: Settings = Settings()) -> DataFrame:
    """(key, left, right, similarity) of all pairs of one key with similarity > `least` (at least 0.8).

    Exact for both measures, ratcliff and edit: candidates share a rare leading character token, and length
    and character counts are bounded before a pair is compared.
    """
    if measure not in ("ratcliff", "edit") or least < 0.8:
        raise ValueError("measure is 'ratcliff' or 'edit', least is 0.8 or more")
    rows = _rare_first_characters(values.select(KEY, "value").distinct())
    visits = rows.withColumn("_t", F.explode("prefix"))
    visits = visits.select(
        KEY,
        "value",
        "size",
        F.col("_t.df").alias("df"),
        F.col("_t.token").alias("token"),
        F.transform("prefix", lambda p: F.concat_ws("\x1f", F.lpad(p["df"].cast("string"), 19, "0"), p["token"])).alias("tokens"),
    ).where(F.col("df") > 1)
    meeting = block_pairs(visits, [KEY, "token"], "value", settings.block_rows, at_least=2)

    def ratio(a: str, b: str) -> float:
        return SequenceMatcher(None, a, b).ratio()

    def kernel(table: pa.Table) -> pa.Table | None:
        value, size, lo, hi = strings(table, "value"), numbers(table, "size"), numbers(table, "lo")[0], numbers(table, "hi")[0]
        lowered = [v.lower() for v in value]
        first = numbers(table, "b") == lo
        second = first if lo == hi else ~first
        here = f"{int(numbers(table, 'df')[0]):019d}\x1f{table.column('token')[0].as_py()}"
        earlier = [{t for t in row if t < here} for row in table.column("tokens").to_pylist()]
        alphabet = sorted(set().union(*[set(v) for v in lowered])) if lowered else []
        place = {c: i for i, c in enumerate(alphabet)}
        counts = np.zeros((len(lowered), len(alphabet)), dtype=np.int32)
        for i, v in enumerate(lowered):
            np.add.at(counts[i], [place[c] for c in v], 1)
        left, right, score = [], [], []
        rights = np.flatnonzero(second)
        for i in np.flatnonzero(first):
            others = rights[rights > i] if lo == hi else rights
            if not len(others):
                continue
            mean = (size[i] + size[others]) / 2.0
            shared = np.minimum(counts[i][None, :], counts[others]).sum(1)
            for j in others[(shared > least * mean) & (np.minimum(size[i], size[others]) > least * mean)]:
                # the pair is compared where its first common token is, once
                if earlier[i] & earlier[j]:
                    continue
                a, b = (i, j) if value[i] < value[j] else (j, i)
                likeness = ratio(lowered[a], lowered[b]) if measure == "ratcliff" else None
                if likeness is None or likeness > least:
                    left.append(value[a])
                    right.append(value[b])
                    score.append(likeness)
        if not left:
            return None
        return pa.table(
            {
                **constants(table, [KEY], len(left)),
                "left": pa.array(left, pa.string()),
                "right": pa.array(right, pa.string()),
                "similarity": pa.array(score, pa.float64()),
            }
        )

    pairs = map_groups(meeting, [KEY, "token", "lo", "hi"], kernel, f"{KEY} string, left string, right string, similarity double")
    if measure == "edit":
        pairs = pairs.withColumn("similarity", text.edit_similarity(F.col("left"), F.col("right")))
        pairs = pairs.where(F.col("similarity") > least)
    return pairs


def drawn_partners(values: DataFrame, per_value: int = 2, bucket_rows: int = 1000) -> DataFrame:
    """Sampling operator: each distinct value with its next few values in hash order, inside buckets of the
    key of about `bucket_rows` values. Linear in the number of values."""
    distinct = values.select(KEY, "value").distinct()
    sizes = distinct.groupBy(KEY).agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("_nb"))
    order = F.md5("value")
    placed = distinct.join(sizes, KEY).withColumn(
        "_b", F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.col("_nb"))
    )
    ring = W.partitionBy(KEY, "_b").orderBy(order, "value")
    partners = F.array_compact(F.array(*[F.lead("value", i).over(ring) for i in range(1, per_value + 1)]))
    drawn = placed.select(KEY, F.col("value").alias("left"), partners.alias("_p"))
    return drawn.select(KEY, "left", F.explode("_p").alias("right"))


def dissimilar_texts(values: DataFrame, most: float = 0.3, per_value: int = 2) -> DataFrame:
    """Drawn pairs with similarity < `most`: the negatives."""
    drawn = drawn_partners(values, per_value)
    scored = drawn.withColumn("similarity", text.text_similarity(F.col("left"), F.col("right")))
    return scored.where(F.col("similarity") < most)


def training_pairs(values: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(key, left, right, label): similar pairs 1.0, drawn dissimilar pairs 0.0."""
    similar = similar_texts(values, settings=settings).withColumn("label", F.lit(1.0))
    return similar.unionByName(dissimilar_texts(values).withColumn("label", F.lit(0.0))).drop("similarity")


def enough_values(values: DataFrame, least: int = 10) -> DataFrame:
    """Distinct values of the keys with at least `least` non-null values."""
    kept = values.groupBy(KEY).agg(F.sum("n").alias("_n")).where(F.col("_n") >= least).select(KEY)
    return values.join(kept, KEY, "left_semi")


def training_tables(values: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The four training sets of the keys with at least ten values, as tables."""
    kept = enough_values(values)
    return {
        "clustering": signature_labels(kept),
        "pairs": training_pairs(kept, settings),
        "triplets": triplet_anchors(kept),
        "normalization": changed_examples(kept),
        "patterns": kept.select(KEY, "value", "n", "sig"),
    }


def trainer_examples(values: DataFrame, limit: int = 1000, settings: Settings = Settings()) -> DataFrame:
    """Example table for a trainer: the first `limit` pairs and triplets, split 80/20 by content."""
    pairs = training_pairs(values, settings).orderBy(KEY, "left", "right").limit(limit)
    pairs = pairs.select(F.array("left", "right").alias("texts"), "label")
    triplets = first_triplets(values, limit).select(F.array("anchor", "positive", "negative").alias("texts"), F.lit(None).cast("double").alias("label"))
    return split_rows(pairs.unionByName(triplets), F.array_join("texts", "\x1f"))


def format_variants(df: DataFrame, percent: int = 30, seed: int = Settings.seed) -> DataFrame:
    """Rows plus, for a hashed sample, a variant: doubled spaces, or lower case for all-upper values."""
    value = F.col("value")
    identity = F.concat_ws("\x1f", F.col("row_id").cast("string"), value)
    shouting = (F.upper(value) == value) & (F.lower(value) != value)
    variant = F.when(F.contains(value, F.lit(" ")), F.replace(value, F.lit(" "), F.lit("  "))).when(shouting, F.lower(value))
    drawn = F.when(hash_share(identity, seed) < percent, variant)
    both = F.array_compact(F.array(F.struct(value.alias("value"), F.lit(False).alias("is_variant")), F.when(drawn.isNotNull(), F.struct(drawn.alias("value"), F.lit(True).alias("is_variant")))))
    others = [c for c in df.columns if c != "value"]
    return df.select(*others, F.explode(both).alias("_r")).select(*others, "_r.*")
