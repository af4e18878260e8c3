"""Topics by non-negative matrix factorisation of a long TF-IDF table.

Documents stay distributed. The topic-term matrix H has k rows and at most ``max_features`` columns
(10,000 by default), so it is small whatever the corpus size: it goes to the tasks as a broadcast and
comes back as sums. Document weights W follow from H alone, so no state is carried between rounds and
a lost executor only costs its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from patronage.session import pin

#: A row of weights is settled when a sweep moves none of them by more than this share of its largest one.
SETTLED = 1e-10
#: Tasks of the first level that sums the arrays of a round; those of no more tasks are summed at once.
FOLDS = 32
#: Exchanges of the positive weights after which a row is left to the sweeps, and the condition of a matrix up to which they are made.
MOST_EXCHANGES, CONDITION = 200, 1e10
#: Sweeps after which a row still moving is counted as unsettled; the model reports how many there were.
MOST_SWEEPS = 20_000


@dataclass(frozen=True)
class TopicModel:
    terms: list[str]
    components: np.ndarray
    errors: list[float]
    converged: bool
    unsettled: int


def document_vectors(weights: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """(key, idx, val) per document, stored, and the sorted vocabulary.

    Term numbers and weights are packed as bytes (int32 and float64), which every round reads as they are. Rows of
    ``weights`` that are partitioned by key, as those of TF-IDF, are not shuffled again.
    """
    entries = weights.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("e"))  # at most one entry per term
    stored = pin(entries.select(key, F.col("e.term").alias("terms"), F.col("e.weight").alias("val")))
    terms = [r[0] for r in stored.select(F.explode("terms").alias("term")).distinct().orderBy("term").collect()]  # at most max_features
    shared = weights.sparkSession.sparkContext.broadcast(terms)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.array(shared.value, pa.string())
        for batch in batches:
            found, val = batch.column("terms"), batch.column("val")
            ends = np.append(0, np.cumsum(pc.list_value_length(found).to_numpy().astype(np.int64)))
            packed = [pc.index_in(found.flatten(), value_set=index).to_numpy().astype(np.int32), val.flatten().to_numpy().astype(np.float64)]
            columns = [_packed(x, ends) for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "idx", "val"])

    schema = stored.select(key).schema.add("idx", T.BinaryType()).add("val", T.BinaryType())
    return pin(stored.mapInArrow(number, schema)), terms


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the values from one end to the next, as a binary array."""
    offsets = pa.py_buffer((ends * values.itemsize).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, offsets, pa.py_buffer(values)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows one after the other, and their number in each row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    bytes_ = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    values = np.frombuffer(bytes_.tobytes(), dtype=kind)
    return values, np.diff(offsets) // values.itemsize


def _swept(target: np.ndarray, gram: np.ndarray, start: np.ndarray, settled: float) -> tuple[np.ndarray, int]:
    """Cyclic updates of one column at a time; rows leave the sweeps as they settle."""
    rows = start.copy()
    moving = np.arange(len(rows))
    for _ in range(MOST_SWEEPS):
        if not len(moving):
            break
        now, wanted = rows[moving], target[moving]
        before = now.copy()
        for j in range(gram.shape[0]):
            if gram[j, j] > 0:
                step = (wanted[:, j] - now @ gram[:, j]) / gram[j, j]
                now[:, j] = np.maximum(now[:, j] + step, 0.0)
        rows[moving] = now
        moving = moving[np.abs(now - before).max(axis=1) > settled * np.maximum(now.max(axis=1), 1e-300)]
    return rows, len(moving)


def _exchanged(target: np.ndarray, gram: np.ndarray, slack: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by block principal pivoting, and which rows have their solution.

    Rows with the same set of positive weights are solved together; weights that came out negative leave the set, those with
    a falling error enter it. A row whose number of wrong weights does not fall changes its last wrong one only.
    """
    n, k = target.shape
    x, slope, positive = np.zeros((n, k)), -target, np.zeros((n, k), dtype=bool)
    fewest, tries = np.full(n, k + 1), np.full(n, 3)
    size = np.abs(target).max(axis=1, initial=0.0, keepdims=True)
    rows = np.arange(n)
    for _ in range(MOST_EXCHANGES):
        at = x[rows]
        wrong = np.where(positive[rows], at < -slack * np.abs(at).max(axis=1, keepdims=True), slope[rows] < -slack * size[rows])
        count = wrong.sum(axis=1)
        rows, wrong, count = rows[count > 0], wrong[count > 0], count[count > 0]
        if not len(rows):
            break
        fewer = count < fewest[rows]
        fewest[rows[fewer]] = count[fewer]
        tries[rows] = np.where(fewer, 3, tries[rows] - 1)
        single = tries[rows] < 0
        last = k - 1 - np.argmax(wrong[:, ::-1], axis=1)
        wrong[single] = np.arange(k) == last[single, None]
        positive[rows] ^= wrong
        sets, members = np.unique(np.packbits(positive[rows], axis=1), axis=0, return_inverse=True)
        order = np.argsort(members.ravel(), kind="stable")
        bounds = np.searchsorted(members.ravel()[order], np.arange(len(sets) + 1))
        for i in range(len(sets)):
            own = rows[order[bounds[i]:bounds[i + 1]]]
            inside = np.flatnonzero(positive[own[0]])
            x[own] = 0.0
            if len(inside):
                x[np.ix_(own, inside)] = np.linalg.solve(gram[np.ix_(inside, inside)], target[np.ix_(own, inside)].T).T
        slope[rows] = x[rows] @ gram - target[rows]
    solved = np.ones(n, dtype=bool)
    solved[rows] = False
    return np.maximum(x, 0.0), solved


def solve_rows(target: np.ndarray, gram: np.ndarray, start: np.ndarray, settled: float = SETTLED) -> tuple[np.ndarray, int]:
    """Non-negative least squares for many rows at once, and the number of rows that did not settle.

    The solution of a well-conditioned ``gram`` is one of a few linear systems, found by exchanges; rows without one, and all
    rows of another ``gram``, are swept from ``start``. Columns of zeros keep their start.
    """
    live = np.flatnonzero(np.diag(gram) > 0)
    if not len(target) or not len(live):
        return start.copy(), 0
    inner = gram[np.ix_(live, live)]
    scale = np.sqrt(np.diag(inner))
    if not np.isfinite(inner).all() or np.linalg.cond(inner / np.outer(scale, scale)) > CONDITION:
        return _swept(target, gram, start, settled)
    rows = start.copy()
    found, solved = _exchanged(target[:, live] / scale, inner / np.outer(scale, scale))
    rows[np.ix_(solved, live)] = found[solved] / scale
    rest, unsettled = _swept(target[~solved], gram, start[~solved], settled)
    rows[~solved] = rest
    return rows, unsettled


def _batch_weights(batch: pa.RecordBatch, h: np.ndarray):
    target, doc, cols, vals = _products(batch, h.T)
    w, unsettled = solve_rows(target, h @ h.T, np.zeros_like(target))
    return w, doc, cols, vals, unsettled


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow array of the arrays, which are not turned into Python numbers."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *arrays])))


def _sums(docs: DataFrame, matrix: np.ndarray, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Arrays that each task makes of its documents and the shared ``matrix``, added by their numbers in two levels."""
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def sent(made: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), _lists(list(made.values()))], ["part", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield sent(add((batch for batch in batches if len(batch)), shared.value))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, s in zip(batch.column("part").to_pylist(), batch.column("s"), strict=True):
                own = s.values.to_numpy()
                totals[part] = totals[part] + own if part in totals else own
        yield sent(totals)

    kind = "part int, s array<double>"
    sums = docs.select("idx", "val").mapInArrow(run, kind)
    if docs.rdd.getNumPartitions() > FOLDS:
        sums = sums.repartition(FOLDS).mapInArrow(fold, kind)
    rows = {r["part"][0].as_py(): r["s"][0].values.to_numpy() for r in sums.repartition(1).mapInArrow(fold, kind).toArrow().to_batches(1)}
    shared.unpersist()
    return rows


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, column and value of all entries of a batch."""
    (cols, sizes), (vals, _) = _unpacked(batch.column("idx"), np.int32), _unpacked(batch.column("val"), np.float64)
    return np.repeat(np.arange(len(batch)), sizes), cols, vals


def _products(batch: pa.RecordBatch, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's rows of A times the columns of ``matrix``, and its entries."""
    doc, cols, vals = _entries(batch)
    out = np.empty((len(batch), matrix.shape[1]))
    for j, column in enumerate(np.ascontiguousarray(matrix.T)):
        out[:, j] = np.bincount(doc, weights=vals * column[cols], minlength=len(batch))
    return out, doc, cols, vals


def _round_sums(docs: DataFrame, h: np.ndarray):
    """Sums over all documents for one round: W'A, W'W, the squared norm of A and the number of unsettled rows."""
    k, v = h.shape

    def add(batches, matrix):
        wta, wtw, squares, moving = np.zeros((k, v)), np.zeros((k, k)), 0.0, 0
        for batch in batches:
            w, doc, cols, vals, unsettled = _batch_weights(batch, matrix)
            moving += unsettled
            for j, column in enumerate(np.ascontiguousarray(w.T)):
                wta[j] += np.bincount(cols, weights=vals * column[doc], minlength=v)
            wtw += w.T @ w
            squares += float(vals @ vals)
        return dict(enumerate([*wta, np.concatenate([wtw.ravel(), [squares, moving]])]))

    rows = _sums(docs, h, add)
    wta, rest = np.stack([rows.get(j, np.zeros(v)) for j in range(k)]), rows.get(k, np.zeros(k * k + 2))
    return wta, rest[: k * k].reshape(k, k), float(rest[-2]), float(rest[-1])


def _gram_times(docs: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'A q in one pass over the documents."""
    v, width = q.shape

    def add(batches, matrix):
        total = np.zeros((width, v))
        for batch in batches:
            product, doc, cols, vals = _products(batch, matrix)
            for j, column in enumerate(np.ascontiguousarray(product.T)):
                total[j] += np.bincount(cols, weights=vals * column[doc], minlength=v)
        return dict(enumerate(total))

    rows = _sums(docs, q, add)
    return np.stack([rows.get(j, np.zeros(v)) for j in range(width)], axis=1)


def leading_vectors(docs: DataFrame, v: int, k: int, passes: int = 2, spare: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of the documents' matrix and its right singular vectors as columns.

    A random subspace of k + ``spare`` columns is multiplied by A'A and made orthonormal ``passes`` times; the small matrix
    of A in that subspace is solved on the driver. Each pass reads the documents once, and tasks return v x (k + spare) sums.
    """
    width = min(v, k + spare)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((v, width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(_gram_times(docs, q))[0]
    small = q.T @ _gram_times(docs, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(k, width)]
    return np.sqrt(np.maximum(values[order], 0.0)), q @ vectors[:, order]


def _side_sums(docs: DataFrame, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Squared norms of the positive and negative parts of A times each vector, the sum of A and the number of documents."""
    width = vectors.shape[1]

    def add(batches, matrix):
        total = np.zeros(2 * width + 2)
        for batch in batches:
            product, _, _, vals = _products(batch, matrix)
            total[:width] += (np.maximum(product, 0.0) ** 2).sum(axis=0)
            total[width:-2] += (np.maximum(-product, 0.0) ** 2).sum(axis=0)
            total[-2:] += vals.sum(), len(batch)
        return {0: total}

    total = _sums(docs, vectors, add).get(0, np.zeros(2 * width + 2))
    return total[:width], total[width:-2], float(total[-2]), int(total[-1])


def decomposed_start(docs: DataFrame, v: int, k: int, seed: int = 42, passes: int = 2) -> np.ndarray:
    """Topic-term weights from the leading singular vectors: of each, the side (all positive or all negative parts of both
    vectors) that holds more of it; zeros take the mean entry of the matrix, so that no weight starts locked."""
    values, vectors = leading_vectors(docs, v, k, passes, seed=seed)
    plus, minus, total, rows = _side_sums(docs, vectors)
    h = np.zeros((k, v))
    for j, value in enumerate(values):
        y = vectors[:, j]
        if j == 0 or value <= 0:
            h[j] = np.sqrt(value) * np.abs(y)
            continue
        sides = [(np.sqrt(n) / value, np.maximum(side * y, 0.0)) for side, n in ((1, plus[j]), (-1, minus[j]))]
        weight, part = max(((x * np.linalg.norm(z), z) for x, z in sides), key=lambda side: side[0])
        if weight > 0:
            h[j] = np.sqrt(value * weight) * part / np.linalg.norm(part)
    h[h < 1e-6] = 0.0
    return np.where(h == 0.0, total / max(rows * v, 1), h)


def fit_topics(
    weights: DataFrame, key: str, k: int = 8, max_iter: int = 400, tolerance: float = 1e-4, seed: int = 42, start: str = "decomposed"
) -> tuple[TopicModel, DataFrame]:
    """Fit k topics; returns the model and the stored document vectors.

    Starts from the matrix's leading singular vectors, or with ``start="random"`` from a seeded random matrix, and alternates
    exact document weights (in the tasks) with an update of H; the squared error never rises.
    Stops when a round improves the error by less than ``tolerance`` of the first error; ``converged`` tells whether that
    came within ``max_iter`` rounds, ``unsettled`` how many weight rows of the last round were still moving.
    """
    docs, terms = document_vectors(weights.select(key, "term", "weight"), key)
    if start == "random" or not terms:
        h = np.random.default_rng(seed).uniform(0.0, 1.0, (k, len(terms)))
    else:
        h = decomposed_start(docs, len(terms), k, seed)
    errors: list[float] = []
    converged, unsettled = False, 0
    for _ in range(max_iter):
        wta, wtw, squares, unsettled = _round_sums(docs, h)
        errors.append(squares - 2.0 * float((wta * h).sum()) + float((wtw * (h @ h.T)).sum()))
        if len(errors) > 1 and errors[-2] - errors[-1] <= tolerance * errors[0]:
            converged = True
            break
        h = solve_rows(wta.T, wtw, h.T)[0].T
    return TopicModel(terms, h, errors, converged, int(unsettled)), docs


def topic_terms(model: TopicModel, docs: DataFrame, k: int = 12) -> DataFrame:
    """The k heaviest terms per topic: (topic_id, rank, term, weight)."""
    topics, columns = np.nonzero(model.components)
    frame = pd.DataFrame(
        {
            "topic_id": topics + 1,
            "term": [model.terms[c] for c in columns],
            "weight": model.components[topics, columns],
        }
    )
    rows = docs.sparkSession.createDataFrame(frame, "topic_id int, term string, weight double")
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("topic_id", "rank", "term", "weight")


def document_topics(model: TopicModel, docs: DataFrame, key: str) -> DataFrame:
    """(key, topic_weights array) for every document vector."""
    shared = docs.sparkSession.sparkContext.broadcast(model.components)

    def run(batches):
        for batch in batches:
            if len(batch):
                w = _batch_weights(batch, shared.value)[0]
                yield pa.RecordBatch.from_arrays([batch.column(key), _lists(list(w))], [key, "topic_weights"])

    schema = docs.select(key).schema.add("topic_weights", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(run, schema)


def dominant_topic(topic_weights: DataFrame) -> DataFrame:
    """Number of the heaviest topic (the first on a tie) and its weight."""
    best = F.array_max("topic_weights")
    return topic_weights.withColumns(
        {"dominant_topic": F.array_position("topic_weights", best).cast("int"), "topic_strength": best}
    )


def assign_topics(complaints: DataFrame, key: str, topic_weights: DataFrame) -> DataFrame:
    """Complaints with topic and strength; a document without vocabulary terms weighs zero on topic 1."""
    found = dominant_topic(topic_weights).select(key, "dominant_topic", "topic_strength")
    return complaints.join(found, key, "left").fillna({"dominant_topic": 1, "topic_strength": 0.0})
