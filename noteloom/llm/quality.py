"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text gives a vector of statistics (null and empty texts: those of no words).  Labelled training rows give count,
sum and outer-product sums per class, added up by Spark.  Each class covariance is shrunk towards the pooled one with
weight d / (n + d) and then towards its mean variance; the Cholesky factors are made once and reused for all
documents.  The score is the logistic function of the difference in log density plus log prior, divided by the number
of statistics: this keeps order and the 0.5 threshold and holds scores apart that would all round to 0 or 1, but scores
aren't posteriors.  Conflicting labels of one id count by their mean, null labels
and ids don't train, and without both classes every score is 0.5.  Rows that repeat an id with its text train once and
get equal scores; extra columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, stage, text_or_empty

RIDGE = 0.02
CLIP = 8.0
STATISTICS = (
    "log_words", "log_bytes_per_word", "word_length_sd", "upper_share", "digit_share", "symbol_share", "end_marks_per_word",
    "other_marks_per_word", "non_ascii_share", "log_words_per_line", "distinct_word_share", "top_word_share", "byte_entropy",
    "duplicate_line_share", "repeated_window_share", "short_word_share", "log_longest_word", "title_word_share",
)
SYMBOLS = list(b"#*$%&|<>")
END_MARKS = list(b".!?")
OTHER_MARKS = list(b",;:'\"()-_/=@[]{}~^+\\`")


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    windows = len(words) - 2
    share = counts[counts > 0] / n
    root = np.sqrt
    return np.array([
        np.log1p(len(words)), np.log(n / w), lengths.std(), root(counts[65:91].sum() / letters), root(counts[48:58].sum() / n),
        root(counts[SYMBOLS].sum() / n), root(counts[END_MARKS].sum() / w), root(counts[OTHER_MARKS].sum() / w), root(counts[128:].sum() / n),
        np.log1p(w / max(1, len(lines))), len(seen) / w, root(seen.most_common(1)[0][1] / w) if seen else 0.0, -float((share * np.log(share)).sum()),
        root(1 - len(set(lines)) / max(1, len(lines))), root(1 - len(set(zip(words, words[1:], words[2:], strict=False))) / windows) if windows > 0 else 0.0,
        float((lengths <= 3).mean()), np.log1p(lengths.max()), root(sum(x[:1].isupper() for x in words) / w),
    ])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row (a key of id and text), x: the statistics of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "row": b["row"], "x": [statistics(t) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key(F.col("doc_id"), text_or_empty()).alias("row"), "text").mapInPandas(run, f"doc_id {kind}, row binary, x array<double>")


def held_out_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


@dataclass(frozen=True)
class Discriminant:
    """Standardisation, and by class: mean, Cholesky factor, its inverse (made once, as it whitens every document), log determinant and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, float, float], ...]

    @staticmethod
    def fit(moments: dict[int, np.ndarray]) -> Discriminant | None:
        """moments: for each class the sum of outer products of (1, x)."""
        if {0, 1} - {k for k, m in moments.items() if m[0, 0] >= 2}:
            return None
        total = moments[0] + moments[1]
        centre = total[0, 1:] / total[0, 0]
        scale = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - centre**2, 0))
        scale = np.where(scale < 1e-6, 1.0, scale)
        means, scatter, sizes = {}, {}, {}
        for k, m in moments.items():
            n, mean = m[0, 0], m[0, 1:] / m[0, 0]
            means[k], sizes[k] = (mean - centre) / scale, n
            scatter[k] = (m[1:, 1:] / n - np.outer(mean, mean)) * n / np.outer(scale, scale)
        pooled, d = (scatter[0] + scatter[1]) / total[0, 0], len(centre)
        classes = []
        for k in (0, 1):
            lean = d / (sizes[k] + d)
            cov = (1 - lean) * scatter[k] / sizes[k] + lean * pooled
            cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            classes.append((means[k], factor, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum()), float(np.log(sizes[k] / total[0, 0]))))
        return Discriminant(centre, scale, tuple(classes))

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        out = []
        for mean, _, whiten, log_det, log_prior in self.classes:
            distance = ((z - mean) @ whiten.T) ** 2 @ np.ones(z.shape[1])
            out.append(log_prior - 0.5 * (distance + log_det))
        return (out[1] - out[0]) / z.shape[1]


def train(features: DataFrame, labels: DataFrame) -> Discriminant | None:
    """labels: doc_id and quality of the training rows.  The driver receives one number for each pair of statistics and class."""
    votes = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in b.groupby("quality"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy())])
                total[int(k)] = total.get(int(k), 0) + x.T @ x
        for k, m in total.items():
            i, j = np.indices(m.shape).reshape(2, -1)
            yield pd.DataFrame({"quality": k, "i": i, "j": j, "v": m.ravel()})

    rows = (
        features.join(votes, "doc_id").dropDuplicates(["row"]).select("quality", "x").mapInPandas(sums, "quality int, i int, j int, v double")
        .groupBy("quality", "i", "j").agg(F.sum("v").alias("v")).collect()
    )
    d = len(STATISTICS) + 1
    moments: dict[int, np.ndarray] = {}
    for r in rows:
        moments.setdefault(r["quality"], np.zeros((d, d)))[r["i"], r["j"]] = r["v"]
    return Discriminant.fit(moments)


def score(features: DataFrame, model: Discriminant | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = model.log_ratio(np.stack(b["x"].to_numpy())) if model and len(b) else np.zeros(len(b))
            p = 1 / (1 + np.exp(-np.clip(ratio, -700, 700)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p, "predicted": (p >= 0.5).astype("int32")})

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on labelled rows outside the held-out third and scores every document."""
    features = stage(document_statistics(docs), "statistics")
    model = train(features, labels.select("doc_id", "quality").where(~held_out_column()))
    return score(features, model).select("doc_id", held_out_column().alias("held_out"), "score", "predicted")
