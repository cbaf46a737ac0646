"""Quality by ordinal regression: cumulative links over shared hashed-text weights.

P(grade >= k) = sigmoid(score - threshold_k) with one score for all grades, the sum of a weight
for each distinct hashed token and each binned count of a text, and thresholds in order. The
expected grade and the probability of the tail are what documents are selected by. The model is
fitted by accelerated proximal gradient with an L1 penalty on a bounded sample of rated
documents; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glasswing.llm.common import fresh, short_batches

#: Buckets of hashed features.
BUCKETS = 1 << 18
#: Rated documents that the model is fitted on, at most; those with the smallest hash of their id.
SAMPLE = 8_000
GRADES = 3
#: Words whose weights a worker holds before it looks them up anew.
MOST_WORDS = 150_000
_EDGE = ".,;:!?\"'()[]{}<>|*#%$&-_/\\"


def bucket(token: str) -> int:
    """The bucket of a token, without the punctuation around it and in lower case."""
    return crc32((token.strip(_EDGE) or token).lower().encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def shape(text: str, tokens: int, distinct: int) -> list[str]:
    """Names of what counts over the whole text say: bytes of each kind, length, repetition, upper case."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, int(counts.sum()))
    share = lambda n: int(min(12, np.log2(1 + 4096.0 * n / total)))
    out = [f"byte {i} {share(counts[i])}" for i in (*range(9, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))]
    out += [f"upper {share(counts[65:91].sum())}", f"digits {share(counts[48:58].sum())}", f"high {share(counts[128:].sum())}"]
    out += [f"tokens {int(np.log2(1 + tokens))}", f"distinct {int(10 * distinct / max(1, tokens))} {int(np.log2(1 + tokens)) // 2}", f"mean {int(min(30, total / max(1, tokens)))}"]
    return out


def features(text: str) -> np.ndarray:
    """Buckets of a text, one for each distinct token and each of its shape's names."""
    tokens = text.split()
    own = set(tokens)
    return np.array([bucket(t) for t in own] + [bucket(x) for x in shape(text, len(tokens), len(own))], np.int32)


@dataclass(frozen=True)
class Ordinal:
    """Weights by bucket and the ordered thresholds; none of either if there was nothing to fit."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, l1: float = 4e-4, rounds: int = 200) -> Ordinal | None:
    """Least penalised loss of the cumulative links; None where fewer than two grades occur."""
    if len(set(grades.tolist())) < 2:
        return None
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    cols, used = np.unique(np.concatenate(rows), return_inverse=True)
    n, starts = len(rows), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    own = np.repeat(np.arange(n), lengths)
    seen = np.bincount(used, minlength=len(cols)).astype(float)
    scale = 1 / np.sqrt(np.maximum(seen, 1.0))  # rare and frequent features move alike
    above = (grades[:, None] >= np.arange(1, GRADES)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    w = np.zeros(len(cols))
    z, zt, t = w.copy(), theta.copy(), 1.0
    step = n / (0.25 * (GRADES - 1) * 1.1 * _power(used, own, scale, n, len(cols)))
    for _ in range(rounds):
        score = np.add.reduceat((z * scale)[used], starts)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - zt[None, :], -60, 60)))
        g = (p - above) / n
        grad = np.bincount(used, weights=g.sum(1)[own], minlength=len(cols)) * scale
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1 * scale, 0)
        new_t = np.maximum.accumulate(zt + g.sum(0) * 2.0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zt = new + (t - 1) / after * (new - w), np.maximum.accumulate(new_t + (t - 1) / after * (new_t - theta) * 0.5)
        w, theta, t = new, new_t, after
    weights = np.zeros(BUCKETS)
    weights[cols] = w * scale
    return Ordinal(weights, theta)


def _power(used: np.ndarray, own: np.ndarray, scale: np.ndarray, n: int, m: int) -> float:
    """The largest squared singular value of the scaled design, by power iteration."""
    v = np.ones(m)
    top = 1.0
    for _ in range(12):
        v /= np.linalg.norm(v) or 1.0
        s = np.bincount(own, weights=(v * scale)[used], minlength=n)
        v = np.bincount(used, weights=s[own], minlength=m) * scale
        top = float(np.linalg.norm(v))
    return top


def grades(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic, 1 for poor, 2 for good documents; rows without both ratings are left out."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """Fits the model on at most ``sample`` rated documents; of rows that share an id the one with the smallest hash of its text counts."""
    short_batches(docs.sparkSession)
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "grade").limit(sample)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([features(x) for x in batch.to_pylist()], pa.list_(pa.int32()))

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rated = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rated = rated.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rated.select("doc_id", "grade", F.arrow_udf(of, "array<int>")("text").alias("x")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    x = rows["x"].combine_chunks()
    if not len(x):
        return None
    lists, at = x.values.to_numpy(), x.offsets.to_numpy()
    return fit([lists[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rows["grade"].to_numpy())


def score(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """Adds ``expected_grade`` and ``tail_probability``, that of the best grade; nulls without a model.

    Null texts are scored as empty ones. Columns of the two names are replaced, others stay.
    """
    if model is None:
        return docs.withColumn("expected_grade", F.lit(None).cast("double")).withColumn("tail_probability", F.lit(None).cast("double"))
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        weight = m.weights.tolist()
        known: dict[str, float] = {}
        get = known.__getitem__
        for batch in batches:
            scores = []
            for x in batch.to_pylist():
                tokens = x.split()
                own = set(tokens)
                if len(known) > MOST_WORDS:
                    known.clear()
                for new in own.difference(known):
                    known[new] = weight[bucket(new)]
                scores.append(sum(map(get, own)) + sum(weight[bucket(s)] for s in shape(x, len(tokens), len(own))))
            tails = m.tails(np.array(scores, float))
            yield pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tails[:, -1])], ["grade", "tail"])

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    (q,) = fresh([*docs.columns, "expected_grade", "tail_probability"], "_q")
    out = docs.withColumn(q, F.arrow_udf(of, "struct<grade:double,tail:double>")(F.coalesce("text", F.lit(""))))
    return out.withColumn("expected_grade", F.col(q)["grade"]).withColumn("tail_probability", F.col(q)["tail"]).drop(q)


def select(docs: DataFrame, labels: DataFrame, tail: float = 0.65, sample: int = SAMPLE) -> DataFrame:
    """All columns of ``docs`` with expected grade, tail probability and ``keep``, which is null for none.

    A document is kept where the best grade has at least probability ``tail``, or where there is no
    model, for want of ratings of two grades. Rows that repeat an id are scored one by one.
    """
    out = score(docs, train(docs, labels, sample))
    return out.withColumn("keep", F.coalesce(F.col("tail_probability") >= tail, F.lit(True)))
