"""The learning run: every stage is a stored table, and a run that stopped goes on at the first missing one."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formscribe.config import Settings
from formscribe.operators import report
from formscribe.operators.ann import assign_cells, train_cells
from formscribe.operators.cluster import cluster_all, describe_clusters
from formscribe.operators.keys import add_composite_key
from formscribe.operators.normalize import rules_from_profiles
from formscribe.operators.profile import key_profiles, value_table
from formscribe.operators.vectors import embed_values
from formscribe.sources.artefacts import stage


def learn(
    spark: SparkSession, items: DataFrame, out: str, settings: Settings = Settings(), use_embeddings: bool = False, encoder=None
) -> dict[str, DataFrame]:
    """Profiles, rules, clusters, vectors, index and report of a key-value table, under the folder `out`."""
    keyed = add_composite_key(items, settings)
    tables: dict[str, DataFrame] = {}

    def keep(name: str, build) -> DataFrame:
        tables[name] = stage(spark, f"{out}/{name}", build)
        return tables[name]

    profiles = keep("profiles", lambda: key_profiles(keyed, settings))
    rules = keep("rules", lambda: rules_from_profiles(profiles))
    values = keep("values", lambda: value_table(keyed, settings))
    summary: dict[str, DataFrame] = {}

    def clustered(part: str) -> DataFrame:
        if not summary:
            result = cluster_all(values, profiles, settings, use_embeddings, encoder)
            summary.update(labels=result.labels, cluster_summary=result.summary)
        return summary[part]

    labels = keep("labels", lambda: clustered("labels"))
    keep("cluster_summary", lambda: clustered("cluster_summary"))
    clusters = keep("clusters", lambda: describe_clusters(labels))
    vectors = keep("vectors", lambda: embed_values(keyed, encoder))
    centres = keep("centres", lambda: train_cells(vectors, settings))
    keep("index", lambda: assign_cells(vectors, centres, settings))
    keep("report", lambda: report.run_report(keyed, profiles, rules, clusters, vectors))
    return tables
