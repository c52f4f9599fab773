"""Parameters of the learning and validation steps, in one frozen record."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # input columns
    key_columns: tuple[str, ...] = ("key_part1", "key_part2", "key_part3")
    value_column: str = "value"
    order_column: str | None = None
    encoding: str = "UTF-8"
    # profiling
    min_signature_frequency: int = 5
    rare_signature_pct: float = 1.0
    top_signatures: int = 10
    examples_per_signature: int = 3
    sample_values: int = 5
    free_text_ratio: float = 0.8
    numeric_unit_share: float = 0.7
    # terms
    ngram_min: int = 2
    ngram_max: int = 4
    max_features: int = 2000
    min_df: int = 1
    max_df: float = 0.95
    # clustering
    min_cluster_size: int = 5
    min_samples: int = 2
    # how density clusters are found: cut (one distance, density_eps) or hierarchy (no distance, square in a key)
    density_method: str = "cut"
    density_metric: str = "cosine"
    density_eps: float = 0.5
    kmeans_k: int = 8
    numeric_k: int = 5
    # passes over all rows at most; the loop ends before when nothing moves
    kmeans_rounds: int = 20
    # first centres that are tried; the cheapest result is taken
    kmeans_starts: int = 1
    # distance of the silhouette, for keys of every size: euclidean (exact, square in a key) or squared (linear)
    silhouette_measure: str = "euclidean"
    seed: int = 42
    # vectors
    dimension: int = 384
    metric: str = "cosine"
    nlist: int = 100
    nprobe: int = 8
    pq_m: int = 8
    pq_bits: int = 8
    top_k: int = 5
    similarity_threshold: float = 0.82
    # review
    review_batch: int = 100
    auto_accept: float = 0.95
    review_lower: float = 0.6
    review_upper: float = 0.95
    retrain_labels: int = 10
    keep_days: int = 30
    # rows that one task holds at a time in the blocked vector kernels
    block_rows: int = 2048


#: Settings for tables of a few hundred rows.
SMALL_DATA = Settings(
    min_signature_frequency=2,
    rare_signature_pct=5.0,
    ngram_min=1,
    ngram_max=3,
    max_features=500,
    min_cluster_size=2,
    min_samples=1,
    kmeans_k=4,
    metric="euclidean",
)
