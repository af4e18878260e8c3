"""Ordinal quality classifier: cumulative-link regression on hashed text.

The ratings are ordered: 0 toxic, 1 low quality, 2 good. One weight vector over hashed features of the text places a
document on a line, ordered thresholds cut the line into grades, and P(grade >= k) = sigmoid(w x - t_k).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from patronage.llm.linking import bitmap, free_names, in_bitmap, share, text_key
from patronage.llm.textops import BLANK, PUNCTUATION, U, folded_bytes, mix, mix_one, small_batches, words
from patronage.session import pin

GRADES = 3


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the labelled rows that the classifier is fitted on (by hash order); ``bits`` the weights.

    Features whose presence does not go with the grade (chi-square below ``least_chi``) get no weight.
    """

    sample: int = 16_000
    bits: int = 18
    rounds: int = 160
    rate: float = 0.05
    decay: float = 3e-4
    least_chi: float = 20.0
    seed: int = 3


def _bucket(share_: np.ndarray) -> np.ndarray:
    """Shares of 1 as steps of a factor of two, 0 for less than 1 in 512."""
    return np.clip(np.floor(np.log2(np.maximum(share_, 1e-9)) + 10), 0, 15).astype(U)


def features(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """Distinct hashed features of each text: its words without punctuation, how much of each mark it has per word, how often a
    word repeats the one before, and how many words are distinct. The whole text counts."""
    found, bounds = words(texts, PUNCTUATION)
    spaced, space_bounds = words(texts, BLANK)
    data, offsets = folded_bytes(texts)
    n = np.maximum(np.diff(space_bounds), 1)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    extra = []
    for b in marks:
        if len(at := np.flatnonzero(data == b)):
            step = _bucket(np.diff(np.searchsorted(at, offsets)) / n)
            extra.append(np.where(step > 0, mix(step + U(b << 8)), U(0)))
    again = np.append(False, spaced[1:] == spaced[:-1])
    repeats = np.diff(np.concatenate(([0], np.cumsum(again)))[space_bounds]) / n
    extra.append(mix(_bucket(repeats) + U(1 << 20)))
    out = []
    for i in range(len(texts)):
        own = np.unique(found[bounds[i]:bounds[i + 1]])
        distinct = _bucket(np.array([len(own) / n[i]])) + U(2 << 20)
        more = np.array([e[i] for e in extra if e[i]], dtype=U)
        out.append(np.unique(np.concatenate((own, more, mix(distinct))) >> U(64 - bits)).astype(np.int32))
    return out


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of each labelled document; the lowest grade if there are several. Labels with nulls don't count."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(GRADES - 1)
    return (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(columns: np.ndarray, owner: np.ndarray, grade: np.ndarray, size: int, least: float) -> np.ndarray:
    """Which features' presence goes with the grade: chi-square of at least ``least`` at one of the cuts between grades."""
    out = np.zeros(size, dtype=bool)
    n = len(grade)
    present = np.bincount(columns, minlength=size).astype(float)
    for k in range(1, GRADES):
        upper = float((grade >= k).sum())
        if 0 < upper < n:
            both = np.bincount(columns, grade[owner] >= k, minlength=size)
            spread = present * (n - present) * upper * (n - upper)
            chi = n * (n * both - present * upper) ** 2 / np.maximum(spread, 1)
            out |= (chi >= least) & (present > 4)
    return out


def fit(rows: list[np.ndarray], grade: np.ndarray, training: Training) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that make the grades likely (Adam on the whole sample, the rare grades weighted up)."""
    weights_size = 1 << training.bits
    columns, sizes = np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    kept = telling(columns, owner, grade, weights_size, training.least_chi)[columns]
    columns, owner = columns[kept], owner[kept]
    weight = (1 / np.sqrt(np.bincount(grade, minlength=GRADES) / len(grade) + 1e-9))[grade]
    weight /= weight.sum()
    theta = np.zeros(weights_size + GRADES - 1)
    steps = slice(weights_size + 1, None)  # logarithms of the steps from the first threshold to the next ones
    theta[weights_size] = -1.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, training.rounds + 1):
        cuts = np.concatenate(([-np.inf], np.cumsum(np.append(theta[weights_size], np.exp(theta[steps]))), [np.inf]))
        score = np.bincount(owner, theta[columns], len(grade))
        high, low = _sigmoid(cuts[grade + 1] - score), _sigmoid(cuts[grade] - score)
        p = np.maximum(high - low, 1e-9)
        up, down = high * (1 - high) / p * weight, low * (1 - low) / p * weight
        slope = np.zeros_like(theta)
        slope[:weights_size] = np.bincount(columns, (up - down)[owner], weights_size) + training.decay * theta[:weights_size]
        cut_slope = (np.bincount(grade, down, GRADES + 1) - np.bincount(grade + 1, up, GRADES + 1))[1:GRADES]
        slope[weights_size] = cut_slope.sum()
        slope[steps] = np.cumsum(cut_slope[::-1])[::-1][1:] * np.exp(theta[steps])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        theta -= training.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cuts = np.cumsum(np.append(theta[weights_size], np.exp(theta[steps])))
    return theta[:weights_size].astype(np.float32), cuts


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> tuple[np.ndarray, np.ndarray] | None:
    """The classifier of at most ``training.sample`` labelled documents, fitted in one task; None without any."""
    order = F.xxhash64(F.lit(training.seed), "doc_id")
    sample = pin(grades(labels).orderBy(order, "doc_id").limit(training.sample))
    slots = share(docs.sparkSession, bitmap(sample.select(F.xxhash64("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("slot"), text_key().alias("text_key"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(iter([batch.filter(pa.array(in_bitmap(slots.value, batch.column("slot").to_numpy())))])):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(features(part.column("text"), training.bits), pa.list_(pa.int32()))],
                    ["doc_id", "text_key", "features"],
                )

    # of several texts with one id the one with the smallest key is learnt
    described = rows.mapInArrow(describe, "doc_id long, text_key long, features array<int>").groupBy("doc_id").agg(F.min_by("features", "text_key").alias("features"))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        weights, cuts = fit([np.asarray(f.values) for f in group.column("features")], group.column("grade").to_numpy().astype(np.int64), training)
        return pa.table({"weights": pa.array([weights], pa.list_(pa.float32())), "cuts": pa.array([cuts], pa.list_(pa.float64()))})

    fitted = described.join(sample, "doc_id").groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weights array<float>, cuts array<double>").collect()
    return (np.array(fitted[0]["weights"], dtype=np.float32), np.array(fitted[0]["cuts"])) if fitted else None


def grade_documents(
    docs: DataFrame, labels: DataFrame, training: Training = Training(), least: float = 0.4,
    names: Sequence[str] = ("expected_grade", "tail", "selected"),
) -> DataFrame:
    """All columns of ``docs`` with expected_grade, tail (probability of the highest grade) and selected (tail >= ``least``).

    A null text is graded as an empty one, a very long one as a whole. Rows may repeat: each is graded, and of several texts
    with one id one is learnt, the one with the smallest hash. Equal grades are not ranked. An empty table gives an empty
    result. Without labels nothing is known: grade and tail are null, all are selected.
    ``names`` are the added columns; columns of the same names are replaced.
    """
    docs = docs.drop(*names)
    model = train(docs, labels, training)
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias(names[0]), F.lit(None).cast("double").alias(names[1]), F.lit(True).alias(names[2]))
    shared = share(docs.sparkSession, model)  # 2 ** bits weights

    @F.arrow_udf("expected_grade double, tail double")
    def grade(texts: pa.Array) -> pa.Array:
        weights, cuts = shared.value
        batches = [pa.RecordBatch.from_arrays([texts], ["text"])]
        scores = [weights[f].sum(dtype=np.float64) for b in small_batches(iter(batches)) for f in features(b.column("text"), training.bits)]
        tails = _sigmoid(np.array(scores).reshape(-1, 1) - cuts)
        return pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["expected_grade", "tail"])

    (found,) = free_names(docs, "_grade")
    graded = docs.withColumn(found, grade("text"))
    return graded.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(f"{found}.expected_grade").alias(names[0]), F.col(f"{found}.tail").alias(names[1]),
        (F.col(f"{found}.tail") >= least).alias(names[2]),
    )
