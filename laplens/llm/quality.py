"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of each whole text are transformed towards normal shape (logarithms of sizes, logits of shares).
Each class has a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the
identity. The score is the logistic of the difference of log densities plus that of log priors; Mahalanobis
distances come from Cholesky factors that are computed once per model and kept with it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.llm.common import unused
from laplens.session import hold, ship

#: Texts whose words are looked at together; bounds memory whatever the batch size.
BLOCK = 64

_KIND = np.full(256, 7, np.uint8)  # other symbols
_KIND[128:] = 0
for _first, _last, _k in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
    _KIND[ord(_first): ord(_last) + 1] = _k
for _c in b"\x09\x0b\x0c\x0d ":
    _KIND[_c] = 3
_KIND[10] = 4
for _c in b".,;:'\"-()?":
    _KIND[_c] = 5
_KIND[ord("!")] = 6

FEATURES = ("bytes", "words", "upper", "digit", "line", "mark", "shout", "symbol", "word_bytes", "word_spread", "distinct",
            "repeat", "short")


def _logit(share: float, n: float) -> float:
    """Log odds with half a count on either side, so that shares of 0 and 1 stay finite."""
    return math.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; a null or empty text has the values of no words."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.zeros(8)
    for at in range(0, len(raw), 1 << 20):
        counts += np.bincount(_KIND[np.frombuffer(raw[at: at + (1 << 20)], np.uint8)], minlength=8)
    words = raw.split()
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    again = sum(map(bytes.__eq__, words, words[1:]))
    shares = [_logit(counts[k] / max(size, 1), size) for k in (1, 2, 4, 5, 6, 7)]
    return [math.log1p(size), math.log1p(n), *shares, math.log1p(lengths.mean()), math.log1p(lengths.std()),
            _logit(len(set(words)) / max(n, 1), n), _logit(again / max(n, 1), n), _logit(float((lengths <= 3).mean()), n)]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the id and its statistics. Texts are read whole, a block of them at a time."""
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    return source.mapInArrow(measure, f"id {kind}, x array<double>")


@dataclass
class Model:
    """Means, inverse Cholesky factors and constants of both classes; plain arrays of fixed size."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    scale: np.ndarray
    shift: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        dens = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0], -700, 700)))


def moments(rows: DataFrame, width: int) -> DataFrame:
    """(label, n, sums): count, sums and sums of products of ``x`` by label, added up in Spark."""

    def fold(batches):
        total = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, width)
            y = np.array(batch.column(0).to_pylist())
            for label in np.unique(y):
                own = x[y == label]
                part = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                total[int(label)] = total.get(int(label), 0) + part
        labels = [k for k in total for _ in total[k]]
        yield pa.RecordBatch.from_arrays([
            pa.array(labels, pa.int32()), pa.array([i for k in total for i in range(len(total[k]))], pa.int32()),
            pa.array([float(v) for k in total for v in total[k]], pa.float64())], ["label", "slot", "value"])

    return (rows.select(F.col("label").cast("int"), "x").mapInArrow(fold, "label int, slot int, value double")
            .groupBy("label", "slot").agg(F.sum("value").alias("value")))


def fit(labelled: DataFrame, shrink: float = 0.2, ridge: float = 0.01) -> Model | float:
    """``labelled``: (label 0/1, x). A class needs two rows; with fewer there is nothing to tell apart, and the model is
    the share of label 1 (0.5 without rows). All labelled rows count; what comes back to the driver are
    2 * (1 + p + p * p) numbers for p statistics."""
    p = len(FEATURES)
    sums = {0: np.zeros(1 + p + p * p), 1: np.zeros(1 + p + p * p)}
    for r in moments(labelled, p).filter(F.col("label").isin(0, 1)).collect():
        sums[r["label"]][r["slot"]] = r["value"]
    n = [sums[k][0] for k in (0, 1)]
    if min(n) < 2:
        return float(n[1] / sum(n)) if sum(n) else 0.5
    whole = sums[0] + sums[1]
    shift = whole[1: p + 1] / whole[0]
    scale = np.sqrt(np.maximum(np.diag(whole[p + 1:].reshape(p, p)) / whole[0] - shift ** 2, 1e-12))
    means, covs = [], []
    for k in (0, 1):
        mean = sums[k][1: p + 1] / n[k]
        cov = sums[k][p + 1:].reshape(p, p) / n[k] - np.outer(mean, mean)
        means.append((mean - shift) / scale)
        covs.append(cov / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    model = Model(means, [], [], scale, shift)
    for k in (0, 1):
        cov = (1 - shrink) * covs[k] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / p, 1e-6) * np.eye(p)
        factor = np.linalg.cholesky(cov)
        model.factors.append(np.linalg.inv(factor))
        model.constants.append(math.log(n[k] / sum(n)) - float(np.log(np.diag(factor)).sum()))
    return model


def score(stats: DataFrame, model: Model | float) -> DataFrame:
    """(id, score) for (id, x)."""
    kind = stats.schema["id"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            s = model.scores(x) if isinstance(model, Model) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["id", "score"])

    return stats.select("id", "x").mapInArrow(judge, f"id {kind}, score double")


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   shrink: float = 0.2, ridge: float = 0.01) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1, higher: label 1 likelier), ``predicted``.

    Learns from labelled rows that are not held out, all of them; only the text's statistics enter a score. Labels other than 0
    and 1, and null ids, teach nothing; repeated labels count as often as they occur. Null and empty texts get the score of a text without words.
    Null ids are scored and not held out. Rows that repeat an id are scored each. Further columns are not read. An empty table
    gives no rows."""
    stats = hold(with_statistics(docs, id_col, text_col), "statistics")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1))
    model = fit(known.filter(~held_out("id")).join(stats, "id"), shrink, ridge)
    scored = score(stats, model)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text scores below one half. Rows that repeat an id go only when each of them would: the
    id's best score decides. Rows with a null id stay. All columns pass through."""
    own_id = unused(docs, "__id")
    bad = (quality_scores(docs, labels, id_col, text_col, **options).groupBy(id_col).agg(F.max("predicted").alias("best"))
           .filter("best = 0").select(F.col(id_col).alias(own_id)))
    return docs.join(bad, F.col(id_col) == F.col(own_id), "left_anti")
