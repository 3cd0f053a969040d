"""Quality rules: base counts and a hashed n-gram logistic regression.

Word uni- and bigrams and 4-grams of characters are hashed into two fixed tables; the counts
of each, scaled to unit length, are the features of a logistic regression that is
trained on a bounded sample of labelled rows and calibrated on a part of it that
the weights never saw. Whole texts are scored in Arrow batches; documents under a
fixed threshold of the calibrated probability are rejected, as are those that break
a base rule.

Edge cases: null and wordless texts have zero counts and fail the base rule of ten
words; labels that disagree and null ids or labels are not trained on; without rows
of both classes the method rejects nothing; repeated documents are judged alike; ids
whose hashes tie are ordered by id in the sample; very long texts are hashed in blocks that
overlap; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

TABLE = 1 << 14
#: Most labelled rows that are trained and calibrated on.
SAMPLE_ROWS = 2400
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 22


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def repeated_words(h: np.ndarray, window: int = 5) -> int:
    """Words in windows of ``window`` consecutive words that occur twice or more."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    s = h[:n].copy()
    for k in range(1, window):
        s = s * MIX + h[k : k + n]
    s = _finish(s)
    order = np.sort(s)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    starts = np.nonzero(np.isin(s, again))[0]
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + window, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def counts(text: bytes) -> tuple[list[int], np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the words' hashes."""
    words = text.split()
    h = word_hashes(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist.sum() - hist[128:192].sum() - hist[32] - hist[9:14].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [len(words), chars, int(hist[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(h)], h


def hashed(text: bytes, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed word 1- and 2-grams and of the hashed 4-grams of characters."""
    mask = np.uint64(TABLE - 1)
    word = np.bincount((_finish(h) & mask).astype(np.int64), minlength=TABLE)
    if len(h) > 1:
        word += np.bincount((_finish(h[:-1] * MIX + h[1:]) & mask).astype(np.int64), minlength=TABLE)
    char = np.zeros(TABLE, np.int64)
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    for a in range(0, max(0, len(points) - 3), BLOCK):
        b = points[a : a + BLOCK + 3]
        g = b[:-3].copy()
        for k in range(1, 4):
            g = g * np.uint32(0x01000193) ^ b[k : len(b) - 3 + k]
        char += np.bincount((g * np.uint32(2654435761)) >> np.uint32(18), minlength=TABLE)
    return word, char


def _unit(c: np.ndarray) -> np.ndarray:
    return c / max(1.0, float(np.sqrt(float((c.astype(np.float64) ** 2).sum()))))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """Sparse features of at most ``rows`` labelled documents, chosen by a hash of their ids."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_max"))
    chosen = one.where(F.col("label") == F.col("_max")).select("doc_id", "label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_utf8")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            texts, out = batch.column("_utf8"), []
            for k in range(batch.num_rows):
                t = texts[k].as_py()
                word, char = hashed(t, word_hashes(t.split()))
                x = np.concatenate([_unit(word), _unit(char)])
                at = np.nonzero(x)[0].astype(np.int32)
                out.append((at.tobytes(), x[at].astype(np.float32).tobytes()))
            arrays = [batch.column("doc_id"), batch.column("label"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "label", "at", "x"])

    found = source.mapInArrow(run, "doc_id long, label int, at binary, x binary").orderBy("doc_id").limit(rows).collect()
    return [(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in found]


def train(sample, epochs: int = 80, rate: float = 0.5, decay: float = 1e-5) -> dict | None:
    """Full-batch Adam on three quarters of the sample, Platt calibration on the rest."""
    y = np.array([s[0] for s in sample], np.float64)
    if len(sample) < 8 or len(set(y.tolist())) < 2:
        return None
    apart = np.arange(len(y)) % 4 == 3
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)
    fit_on = np.nonzero(~apart)[0]
    idx = np.concatenate([sample[i][1] for i in fit_on])
    val = np.concatenate([sample[i][2] for i in fit_on]).astype(np.float64)
    row = np.repeat(np.arange(len(fit_on)), [len(sample[i][1]) for i in fit_on])
    t, n, dims = y[fit_on], len(fit_on), 2 * TABLE
    w, b = np.zeros(dims), 0.0
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(row, weights=val * w[idx], minlength=n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - t) / n
        g = np.append(np.bincount(idx, weights=val * d[row], minlength=dims) + decay * w, d.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    on = np.nonzero(apart)[0] if apart.any() else np.arange(len(y))
    z = np.array([float(sample[i][2] @ w[sample[i][1]]) + b for i in on])
    # Platt: targets kept off 0 and 1 by the class counts, Newton steps on slope and offset.
    pos, neg = float((y[on] == 1).sum()), float((y[on] == 0).sum())
    target = np.where(y[on] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x2 = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x2 @ ab, -40, 40)))
        grad = x2.T @ (p - target) + 1e-3 * np.array([ab[0] - 1, 0])
        hess = (x2 * (p * (1 - p))[:, None]).T @ x2 + 1e-3 * np.eye(2)
        ab = ab - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return {"w": w.astype(np.float32), "b": b, "slope": float(ab[0]), "offset": float(ab[1])}


def probability(model: dict | None, word: np.ndarray, char: np.ndarray) -> float:
    if model is None:
        return 1.0
    z = float(_unit(word) @ model["w"][:TABLE]) + float(_unit(char) @ model["w"][TABLE:]) + model["b"]
    return float(1 / (1 + np.exp(-np.clip(model["slope"] * z + model["offset"], -40, 40))))


def judge(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, base_failed, kept and probability of every document."""
    source = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_utf8"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts, base, prob = batch.column("_utf8"), [], []
            for k in range(batch.num_rows):
                t = texts[k].as_py()
                c, h = counts(t)
                base.append(c)
                prob.append(probability(own, *hashed(t, h)))
            base = np.array(base, np.int64).reshape(-1, 5)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            prob = np.array(prob, np.float64)
            arrays = [batch.column("doc_id"), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (prob >= threshold)), pa.array(prob)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_failed", "kept", "probability"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, probability double"
    return source.mapInArrow(run, schema)


#: The base counts and rule; the model's verdict has no SQL.
BASE_ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY doc_id),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(training_sample(docs, table(spark, sf_dir, "labels"))))
