"""Quality classifier by co-training: a text view and a metadata view teach each other, calibrated scores are combined."""
from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from formscribe.llm.words import n_words, words_of
from formscribe.session import cut_lineage

#: Most labelled rows that are fitted on, drawn in hash order of the id, so a rerun draws the same. Unlabelled rows have
#: no bound: all take part where they are.
LABELLED_ROWS = 20_000
#: Rounds of the exchange, and how sure a view has to be of a row to label it for the other.
ROUNDS, SURE = 5, 0.98
#: Share of the labelled rows that is kept for calibration.
HELD_OUT = 0.3
SOURCES, LANGS = 64, 16


def text_counts(text: Column) -> dict[str, Column]:
    """What is counted in the whole text; each count reads it once."""
    t = F.coalesce(text, F.lit(""))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    return {
        "n_chars": F.length(t),
        "n_words": n_words(t),
        "n_distinct": F.size(F.array_distinct(words_of(t))),
        "n_solid": left(r"\s+"),
        "n_not_upper": left(r"\p{Lu}+"),
        "n_not_digit": left(r"\p{N}+"),
        "n_not_symbol": left(r"[^\p{L}\p{N}\s]+"),
        "n_lone": F.regexp_count(t, F.lit(r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)")),
        "n_ends": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]{2,}(?!\S)")),
        "n_lines": F.regexp_count(t, F.lit(r"\n")),
    }


def text_features(n: dict[str, Column]) -> dict[str, Column]:
    """What the text itself tells, from its counts: shares of kinds of characters and words."""
    chars = F.greatest(n["n_chars"], F.lit(1)).cast("double")
    words = F.greatest(n["n_words"], F.lit(1)).cast("double")
    size, distinct = F.log1p(words), n["n_distinct"] / words
    return {
        "size": size,
        "word_length": F.log1p(n["n_solid"] / words),
        "upper": 1 - n["n_not_upper"] / chars,
        "digits": 1 - n["n_not_digit"] / chars,
        "symbols": 1 - n["n_not_symbol"] / chars,
        "lone_symbols": n["n_lone"] / words,
        "symbol_ends": n["n_ends"] / words,
        "lines": n["n_lines"] / words,
        "distinct": distinct,
        "distinct_by_size": distinct * size,
        "size_squared": size * size,
    }


def meta_features(lang: Column, source: Column, chars: Column) -> dict[str, Column]:
    """What the record tells without its text: buckets of source and language, and the stated length."""
    length = F.log1p(F.greatest(F.coalesce(chars.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return {
        "source": F.pmod(F.xxhash64(F.coalesce(source.cast("string"), F.lit("\0"))), F.lit(SOURCES)).cast("int"),
        "lang": F.pmod(F.xxhash64(F.coalesce(lang.cast("string"), F.lit("\0"))), F.lit(LANGS)).cast("int"),
        "length": length,
        "length_squared": length * length,
        "no_length": chars.isNull().cast("double"),
    }


TEXT = (
    "size",
    "word_length",
    "upper",
    "digits",
    "symbols",
    "lone_symbols",
    "symbol_ends",
    "lines",
    "distinct",
    "distinct_by_size",
    "size_squared",
)
META = ("length", "length_squared", "no_length")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge on all but the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _parts(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the rows, without a ridge, in one vector; they add up over rows."""
    p = _sigmoid(np.clip(x @ w, -30, 30))
    return np.concatenate([x.T @ (p - y), ((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x).ravel()])


def _added(pool: pd.DataFrame | DataFrame, work: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of work(rows) over all rows; of a Spark table, one vector a partition comes to the driver."""
    if isinstance(pool, pd.DataFrame):
        return work(pool) if len(pool) else np.zeros(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += work(pdf)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    return sum((np.frombuffer(r["sums"]) for r in pool.mapInPandas(run, "sums binary").collect()), np.zeros(size))


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass(frozen=True)
class QualityModel:
    """Weights of both views, their calibrations (slope, constant) and the combination (text, meta, constant)."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    text: tuple[float, ...]
    meta: tuple[float, ...]
    text_calibration: tuple[float, float]
    meta_calibration: tuple[float, float]
    combined: tuple[float, float, float]
    exchanged: int = 0

    def scores(self, text: dict[str, Column], meta: dict[str, Column]) -> tuple[Column, Column, Column]:
        """Calibrated probability of good quality by text, by metadata and by both; plain expressions."""
        n = len(TEXT)
        zt = [(text[f] - self.mean[i]) * (self.text[i] / self.scale[i]) for i, f in enumerate(TEXT)]
        zm = [(meta[f] - self.mean[n + i]) * (self.meta[i] / self.scale[n + i]) for i, f in enumerate(META)]
        hot = self.meta[len(META) :]
        weights = F.array(*[F.lit(float(w)) for w in hot[:SOURCES]]), F.array(*[F.lit(float(w)) for w in hot[SOURCES : SOURCES + LANGS]])
        zm += [F.get(weights[0], meta["source"]), F.get(weights[1], meta["lang"])]

        def calibrated(parts: list[Column], constant: float, slope: tuple[float, float]) -> Column:
            z = reduce(operator.add, parts) + constant
            z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
            return z * slope[0] + slope[1]

        a = calibrated(zt, self.text[-1], self.text_calibration)
        b = calibrated(zm, self.meta[-1], self.meta_calibration)
        both = a * self.combined[0] + b * self.combined[1] + self.combined[2]
        return tuple(F.lit(1.0) / (F.exp(-z) + 1.0) for z in (a, b, both))


def _meta_matrix(table: pd.DataFrame) -> np.ndarray:
    hot = np.zeros((len(table), SOURCES + LANGS))
    rows = np.arange(len(table))
    hot[rows, table["source"].to_numpy(int)] = 1
    hot[rows, SOURCES + table["lang"].to_numpy(int)] = 1
    return hot


def _constant(share: float) -> QualityModel:
    z = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    n = len(TEXT) + len(META)
    meta = (0.0,) * (len(META) + SOURCES + LANGS + 1)
    return QualityModel((0.0,) * n, (1.0,) * n, (0.0,) * (len(TEXT) + 1), meta, (0.0, z), (0.0, z), (0.5, 0.5, 0.0))


def _taught(views: Sequence[np.ndarray], past: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Per view the label of every row that the other view gave it: by the first round in which that one was sure, NaN if
    none was."""
    out = [np.full(len(views[0]), np.nan), np.full(len(views[0]), np.nan)]
    for ws in past:
        for v in (0, 1):
            p, to = _sigmoid(_logit(views[v], ws[v])), out[1 - v]
            sure = np.isnan(to) & ((p >= SURE) | (p <= 1 - SURE))
            to[sure] = p[sure] >= SURE
    return out


def co_train(labelled: pd.DataFrame, pool: pd.DataFrame | DataFrame, seed: int = 0) -> QualityModel:
    """Both views from labelled rows (columns TEXT, META, source, lang, y) and unlabelled ones, in pandas or Spark.

    In each round both views are fitted, label every pool row of which they are at least SURE, and hand it to the other
    view. What one view gave stays as given. The pool is never moved: its rows' labels follow from the weights of the
    rounds so far, and Newton steps need only their sums of gradient and Hessian. Then each view is calibrated on
    held-out rows, and a last regression on both calibrated scores, on the same rows, weighs them.
    """
    y = labelled["y"].to_numpy(float)
    if len(y) < 20 or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 1.0)
    dense = list(TEXT) + list(META)

    def moments(table: pd.DataFrame) -> np.ndarray:
        x = table[dense].to_numpy(float) - centre
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    centre = labelled[dense].mean().to_numpy()
    sums = moments(labelled) + _added(pool, moments, 1 + 2 * len(dense))
    off, square = sums[1 : 1 + len(dense)] / sums[0], sums[1 + len(dense) :] / sums[0]
    mean, scale = centre + off, np.sqrt(np.maximum(square - off * off, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def views(table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        z = (table[dense].to_numpy(float) - mean) / scale
        return z[:, : len(TEXT)], np.hstack([z[:, len(TEXT) :], _meta_matrix(table)])

    own = views(labelled)
    held = np.random.default_rng(seed).random(len(y)) < HELD_OUT
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    fit, check = ~held, held if held.any() else ~held
    wide = [x.shape[1] + 1 for x in own]
    ends = np.cumsum([2] + [n + n * n for n in wide])

    def ones(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.ones((len(x), 1))])

    def pooled(ws: list[np.ndarray], past: list[list[np.ndarray]]) -> np.ndarray:
        """Rows taught to each view, then the parts of each view."""

        def work(table: pd.DataFrame) -> np.ndarray:
            both = views(table)
            labels = _taught(both, past)
            has = [~np.isnan(t) for t in labels]
            return np.concatenate([[h.sum() for h in has], *[_parts(ones(both[v][has[v]]), labels[v][has[v]], ws[v]) for v in (0, 1)]])

        return _added(pool, work, ends[-1]) if past else np.zeros(ends[-1])

    def fitted(ws: list[np.ndarray], past: list[list[np.ndarray]]) -> tuple[list[np.ndarray], int]:
        """Newton steps as in _fit, for both views at once, from the weights of the round before."""
        for _ in range(30):
            sums, moved, new = pooled(ws, past), 0.0, []
            for v in (0, 1):
                parts = sums[ends[v] : ends[v + 1]] + _parts(ones(own[v][fit]), y[fit], ws[v])
                penalty = np.r_[np.ones(wide[v] - 1), 1e-6]
                step = np.linalg.solve(parts[wide[v] :].reshape(wide[v], -1) + np.diag(penalty), parts[: wide[v]] + penalty * ws[v])
                new.append(ws[v] - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12)))
                moved = max(moved, np.abs(step).max())
            ws = new
            if moved < 1e-6:
                break
        return ws, int(sums[:2].sum())

    ws, exchanged = fitted([np.zeros(n) for n in wide], [])
    past: list[list[np.ndarray]] = []
    for _ in range(ROUNDS):
        past.append(ws)
        ws, exchanged = fitted(ws, past)
    slopes = [_fit(_logit(own[v][check], ws[v])[:, None], y[check]) for v in (0, 1)]
    calibrated = np.stack([_logit(own[v][check], ws[v]) * slopes[v][0] + slopes[v][1] for v in (0, 1)], axis=1)
    combined = _fit(calibrated, y[check])

    def plain(x: np.ndarray) -> tuple[float, ...]:
        return tuple(float(v) for v in x)

    return QualityModel(plain(mean), plain(scale), plain(ws[0]), plain(ws[1]), plain(slopes[0]), plain(slopes[1]), plain(combined), exchanged)


def feature_table(documents: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chars_col: str) -> DataFrame:
    """doc_id and all features of every document, stored: texts are read once."""
    columns = text_features(text_counts(F.col(text_col))) | meta_features(F.col(lang_col), F.col(source_col), F.col(chars_col))
    return cut_lineage(documents.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in columns.items()]))


def train_quality(
    features: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
) -> QualityModel:
    """A model from the features and 0/1 labels. Null labels and ids are left out; of several labels the mean counts,
    a half as good. At most `labelled_rows` rows, first by hash of the id, come to the driver; all unlabelled ones, those
    with a null id too, take part in Spark."""
    given = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("l_id")).agg(
        (F.avg(label_col) >= 0.5).cast("double").alias("y")
    )
    drawn = F.xxhash64("doc_id", F.lit(11))
    unique = features.where("doc_id is not null")
    known = unique.join(given, F.col("doc_id") == F.col("l_id")).orderBy(drawn, "doc_id", *TEXT).limit(labelled_rows).toPandas()
    pool = unique.join(given, F.col("doc_id") == F.col("l_id"), "left_anti").unionByName(features.where("doc_id is null"))
    if known["y"].nunique() < 2:
        return co_train(known, known.iloc[:0])
    return co_train(known, cut_lineage(pool.select(*TEXT, *META, "source", "lang")))


def score_quality(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """Per document: id, text_score, meta_score, score (probabilities of good quality) and keep (score >= threshold).

    Null texts count as empty, null metadata as a value of its own; every row is scored, repeated ones and those with a
    null id too. Without labels of both classes every score is the share of good labels, 1 without any. An empty table
    gives no rows.
    """
    features = feature_table(documents, id_col, text_col, lang_col, source_col, chars_col)
    model = train_quality(features, labels, id_col, label_col)
    a, b, both = model.scores({f: F.col(f) for f in TEXT}, {f: F.col(f) for f in (*META, "source", "lang")})
    return features.select(
        F.col("doc_id").alias(id_col), a.alias("text_score"), b.alias("meta_score"), both.alias("score")
    ).withColumn("keep", F.col("score") >= threshold)


def keep_good(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", chars_col: str = "n_chars", label_col: str = "quality", threshold: float = 0.5,
) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; a filter without a shuffle of texts."""
    features = feature_table(documents, id_col, text_col, lang_col, source_col, chars_col)
    model = train_quality(features, labels, id_col, label_col)
    counts = text_counts(F.col(text_col))
    meta = meta_features(F.col(lang_col), F.col(source_col), F.col(chars_col))
    # a filter does not share common parts, so the counts are bound once and the score is taken from them
    bound = F.array(F.struct(*[c.alias(n) for n, c in (counts | meta).items()]))
    scores = F.transform(bound, lambda b: model.scores(text_features({n: b[n] for n in counts}), {n: b[n] for n in meta})[2])
    return documents.where(F.get(scores, F.lit(0)) >= threshold)
