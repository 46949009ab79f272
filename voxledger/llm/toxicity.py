"""Operator 9: toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k | x) = sigmoid(w.x - theta_k) with one weight vector for all thresholds
theta_1 < theta_2 < theta_3; the output is the expected grade, the sum of P(grade >= k).
A document's features are the distinct words it has and their stems (first STEM bytes).

Training: the labels' `toxic` is 0 or 1; toxic documents are graded 1 to 3 by how many distinct marker
features (those far more frequent in toxic documents) they have, at the 50 % and 90 % quantiles.
The fit uses at most `per_class` labelled documents of each class (least hashes of doc_id) and the
`n_features` features of largest chi-square: both are documented bounds, whatever the corpus size.
Every document is scored over its whole text.

Null and empty texts have no features. Null labels, and labels without a document, are ignored; if a
doc_id has several labels, the highest counts. With no labelled document of one class nothing is toxic.
Repeated rows are scored one by one; equal texts get equal grades. An empty table gives no rows. Columns but doc_id
and text, whatever their names, are not read; drop_toxic() returns the columns of docs. Very long texts are cut into
words some megabytes at a time, and only distinct words are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import materialize, read_table, words_in_chunks

PER_CLASS = 4000
N_FEATURES = 4096
STEM = 5
GRADES = 3
#: A feature is a marker if its log odds of toxic over clean exceed this.
MARKER_LOG_ODDS = 3.0
#: A document is rejected at this probability of grade 1 or more.
REJECT = 0.5

#: A-Z lowered; every ASCII byte but letters and digits becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def features(data: bytes | None) -> set[bytes]:
    """Distinct words and stems of a text; a stem carries a leading '^'."""
    found: set[bytes] = set()
    for part in words_in_chunks((data or b"").translate(LETTERS)):
        found.update(part)
    return found | {b"^" + w[:STEM] for w in found}


@dataclass
class OrdinalModel:
    """Weights by feature and the ordered thresholds; an empty one finds nothing toxic."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thetas: tuple[float, ...] = (40.0, 41.0, 42.0)

    def probabilities(self, data: bytes | None) -> np.ndarray:
        """P(grade >= k) for k = 1 to GRADES."""
        get = self.weights.get
        score = sum(sorted(x for w in features(data) if (x := get(w)) is not None))
        return 1 / (1 + np.exp(np.clip(np.array(self.thetas) - score, -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int, l2: float = 1.0, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised negative log likelihood, by Adam on all rows.

    (rows, cols) are the positions of ones in the feature matrix. Thresholds are kept in order by
    learning the first and the logarithms of the gaps.
    """
    n = len(grade)
    p = np.zeros(n_features + GRADES)
    p[n_features] = 2.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    tops = np.arange(GRADES + 2)
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        thetas = p[n_features] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(rows, w[cols], n)
        above = 1 / (1 + np.exp(np.clip(thetas[None] - score[:, None], -60, 60)))
        cum = np.c_[np.ones(n), above, np.zeros(n)]
        at, nxt = cum[np.arange(n), grade], cum[np.arange(n), grade + 1]
        share = np.maximum(at - nxt, 1e-12)
        d_at, d_nxt = at * (1 - at) / share, nxt * (1 - nxt) / share
        g_score = d_nxt - d_at
        g_theta = np.array([d_at[grade == k].sum() - d_nxt[grade + 1 == k].sum() for k in tops[1:-1]])
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.r_[np.bincount(cols, g_score[rows], n_features) + l2 * w, tail[0], tail[1:] * gaps]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], p[n_features] + np.r_[0, np.cumsum(np.exp(p[n_features + 1 :]))]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["toxic", "features"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_features: int = N_FEATURES) -> OrdinalModel:
    """Fit on at most `per_class` labelled documents of each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.max("toxic") > 0).cast("int").alias("__toxic"))
    known = known.withColumn("__order", F.xxhash64("__id"))
    chosen = [known.where(F.col("__toxic") == c).orderBy("__order", "__id").limit(per_class) for c in (0, 1)]
    sample = chosen[0].union(chosen[1])  # at most 2 * per_class rows
    own = docs.select("doc_id", F.col("text").cast("binary").alias("__text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    table = materialize(own.select("__toxic", "__text").mapInArrow(_feature_rows, "toxic int, features array<binary>"))
    sizes = {r["toxic"]: r["count"] for r in table.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return OrdinalModel()
    each = table.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    n, n_bad = float(sum(sizes.values())), float(sizes[1])
    a, b = F.col("bad").cast("double"), F.col("n").cast("double")
    chi = F.pow(a * n - b * n_bad, 2) / (b * (n - b) + 1e-9) / (n_bad * (n - n_bad))
    best = each.withColumn("chi", chi).orderBy(F.desc("chi"), "f").limit(n_features).collect()
    index = {bytes(r["f"]): i for i, r in enumerate(best)}
    odds = np.array([np.log((r["bad"] + 0.5) / (n_bad + 1)) - np.log((r["n"] - r["bad"] + 0.5) / (n - n_bad + 1)) for r in best])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[f] for f in fs if f in index] for fs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "cols"])

    fit = sorted((tuple(r) for r in table.mapInArrow(positions, "toxic int, cols array<int>").collect()), key=lambda r: (r[0], r[1]))
    markers = set(np.flatnonzero(odds > MARKER_LOG_ODDS).tolist())
    amount = np.array([len(markers.intersection(c)) for _, c in fit])
    toxic = np.array([t for t, _ in fit])
    cuts = np.quantile(amount[toxic == 1], [0.5, 0.9])
    grade = np.where(toxic == 1, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0).astype(int)
    rows = np.repeat(np.arange(len(fit)), [len(c) for _, c in fit])
    cols = np.array([c for _, cs in fit for c in cs], int)
    weights, thetas = fit_ordinal(rows, cols, grade, len(best))
    return OrdinalModel({f: float(weights[i]) for f, i in index.items()}, tuple(map(float, thetas)))


def score_column(model: OrdinalModel, text) -> F.Column:
    """array<double> of P(grade >= k) for a text column."""
    from pyspark.sql import types as T

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def score(data: pa.Array) -> pa.Array:
        return pa.array([model.probabilities(x).tolist() for x in data.to_pylist()], pa.list_(pa.float64()))

    return score(text.cast("binary"))


def grades(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected severity (0 to 3), probability of grade 1 or more, most probable grade, verdict."""
    p = F.col("p")
    each = F.array(1 - p[0], *[p[k] - p[k + 1] for k in range(GRADES - 1)], p[GRADES - 1])
    return docs.select("doc_id", score_column(model, F.col("text")).alias("p")).select(
        "doc_id",
        sum((p[k] for k in range(1, GRADES)), p[0]).alias("expected_severity"),
        p[0].alias("p_toxic"),
        (F.array_position(each, F.array_max(each)) - 1).alias("grade"),
        (p[0] >= REJECT).alias("toxic"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return grades(docs, train(docs, read_table(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents below the rejection probability stay, columns unchanged."""
    model = train(docs, labels)
    return docs.where(score_column(model, F.col("text"))[0] < REJECT)
