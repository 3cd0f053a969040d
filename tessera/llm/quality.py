"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics. Class means and
covariances come from one distributed aggregation over all labelled training rows;
each covariance is shrunk towards the pooled one and the pooled diagonal, and its
Cholesky factor is computed once and shipped to the scorers. A score is the
logistic of the difference of the two log densities plus the log prior ratio.

Edge cases: a null text counts as empty and is scored; labels of a doc_id that
disagree, and null ids or labels, are left out of training; with fewer than two
rows of a class every score is 0.5; repeated rows are scored alike and counted each; a
score of exactly 0.5 is predicted 1; very long texts are counted whole; an empty table
gives no rows; extra columns are ignored by ``features`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_fold, masked, materialise, table

NAMES = [
    "log_words", "symbols", "pipes", "upper", "digits", "bangs", "stops", "non_ascii", "line_rate", "short_lines",
    "distinct_words", "word_length", "repeated_lines", "spaces", "letters",
]
SHRINK = 0.1
TOWARDS_DIAGONAL = 0.2


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    nw, nl = len(words), len(lines)
    share = lambda k, of=n: float(np.log((float(k) + 0.5) / (of + 1.0)))
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    return [
        float(np.log1p(nw)),
        share(counts[[35, 42, 36, 37, 38, 60, 62]].sum()),
        share(counts[124]),
        share(upper),
        share(counts[48:58].sum()),
        share(counts[[33, 63]].sum()),
        share(counts[[44, 46]].sum()),
        share(counts[128:].sum()),
        share(nl, nw),
        share(sum(len(x) < 30 for x in lines), nl),
        (len(set(words)) + 1.0) / (nw + 1.0),
        float(np.log1p(sum(map(len, words)) / (nw + 1.0))),
        share(nl - len(set(lines)), nl),
        share(counts[32]),
        share(upper + lower),
    ]


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the array ``_x`` of statistics of each whole text."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_utf8"))
    out = source.drop("_utf8").withColumn("_x", F.array().cast("array<double>"))

    def run(batches):
        for batch in batches:
            texts = batch.column("_utf8")
            x = pa.array([statistics(texts[k].as_py()) for k in range(batch.num_rows)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], [*keep, "_x"])

    return source.mapInArrow(run, out.schema)


def fit(x: DataFrame, shrink: float = SHRINK, towards_diagonal: float = TOWARDS_DIAGONAL) -> dict | None:
    """Means and Cholesky factors from rows (_x, label); sums are aggregated, rows never leave the executors."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (
        x.groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(F.col("_x")[i]) for i in range(d)]).alias("s"),
            F.array(*[F.sum(F.col("_x")[i] * F.col("_x")[j]) for i, j in pairs]).alias("q"),
        )
        .collect()
    )
    n, mean, cov = {}, {}, {}
    for r in rows:
        k = int(r["label"])
        n[k] = r["n"]
        mean[k] = np.array(r["s"]) / r["n"]
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["q"], strict=True):
            second[i, j] = second[j, i] = v
        cov[k] = second / r["n"] - np.outer(mean[k], mean[k])
    if min(n.get(0, 0), n.get(1, 0)) < 2:
        return None
    total = n[0] + n[1]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    target = (1 - towards_diagonal) * pooled + towards_diagonal * np.diag(np.diag(pooled))
    model = {}
    for k in (0, 1):
        sigma = (1 - shrink) * cov[k] + shrink * target + 1e-4 * np.eye(d)
        chol = np.linalg.cholesky(sigma)
        model[k] = (mean[k], np.linalg.inv(chol), 2 * float(np.log(np.diag(chol)).sum()), float(np.log(n[k] / total)))
    return model


def scores(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    g = {}
    for k, (mean, inverse, logdet, prior) in model.items():
        z = (x - mean) @ inverse.T
        g[k] = prior - 0.5 * (logdet + (z * z).sum(axis=1))
    return 1.0 / (1.0 + np.exp(np.clip(g[0] - g[1], -60, 60)))


def score(x: DataFrame, model: dict | None) -> DataFrame:
    """Replaces ``_x`` by score and predicted."""
    keep = [c for c in x.columns if c != "_x"]
    out = x.drop("_x").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    d = len(NAMES)

    def run(batches):
        for batch in batches:
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            s = scores(flat.reshape(-1, d), model)
            arrays = [*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "score", "predicted"])

    return x.mapInArrow(run, out.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and label of the training folds; ids whose labels disagree are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_fold() != 1))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_max"))
    return one.where(F.col("label") == F.col("_max")).select("doc_id", "label")


def classify(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` (doc_id among them) with score and predicted for every row."""
    x = materialise(features(docs, keep))
    training = x.select("doc_id", "_x").join(training_labels(labels), "doc_id")
    return score(x, fit(training))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs.

    The texts are read twice, once for the fit and once for the scores, and never shuffled.
    """
    x = features(docs.select("doc_id", "text"), ["doc_id"])
    model = fit(x.join(training_labels(labels), "doc_id"))
    hidden, names = masked(docs)
    text = f"c{names.index('text')}"

    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            x = [statistics(texts[k].as_py() or b"") for k in range(batch.num_rows)]
            yield batch.filter(pa.array(scores(np.array(x).reshape(-1, len(NAMES)), model) >= 0.5))

    return hidden.mapInArrow(run, hidden.schema).toDF(*names)


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
