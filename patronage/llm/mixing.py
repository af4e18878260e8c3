"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are whole words. A source whose target is above its size is taken whole as often as it fits, and the rest of
the target is a budget for single documents. Documents are counted by exact size; most of the budget is taken
evenly over the sizes, and a bounded-knapsack programme over the counts that are left fills the remainder. The seeded
choice then takes so many documents of each size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.linking import free_names, text_key
from patronage.operators.ranking import global_position, running_totals
from patronage.session import pin


@dataclass(frozen=True)
class Mix:
    """Weights in the order of the sources, repeating; the most often a source may be taken; the seed of the choice.

    The driver weighs up to ``max_sources`` sources; more are weighed by Spark. ``slots`` bounds the remainder that the
    knapsack solves exactly, in words: more than that is first filled with whole documents, from the largest size down.
    """

    weights: Sequence[int] = (5, 2, 1)
    most: int = 3
    seed: int = 8
    max_sources: int = 100_000
    slots: int = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: int) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``most`` times its size; the excess is shared anew until all fit."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, rest = [i for i, s in enumerate(sizes) if s > 0], total
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, slots: int) -> np.ndarray:
    """How many documents of each distinct size to take so that their words come near to ``budget``; exact for the last ``slots`` words.

    Takes the same share of each size and fills the rest. If that misses the budget, half that share and none are tried too.
    """
    share = min(1.0, budget / max(1, int((sizes * counts).sum())))
    best = None
    for part in (share, share / 2, 0.0):
        taken = _fill(sizes, counts, budget, slots, part)
        gap = abs(int((sizes * taken).sum()) - budget)
        if best is None or gap < best[0]:
            best = gap, taken
        if not gap:
            break
    return best[1]


def _fill(sizes: np.ndarray, counts: np.ndarray, budget: int, slots: int, share: float) -> np.ndarray:
    """Takes ``share`` of each size, then whole documents from the largest size down while more than ``slots`` words are left,
    then solves the remainder exactly: bit b of ``reach`` says that b words can be made of the sizes so far.
    """
    taken = np.floor(counts * share).astype(np.int64)
    left = max(0, budget - int((sizes * taken).sum()))
    for i in np.argsort(-sizes, kind="stable"):
        if left <= slots:
            break
        more = min(int(counts[i] - taken[i]), max(0, left - slots + int(sizes[i]) - 1) // int(sizes[i]), left // int(sizes[i]))
        taken[i] += more
        left -= more * int(sizes[i])
    window = left + min(left, int(sizes.max()))  # the nearest sum may lie above
    mask, reach, steps = (1 << (window + 1)) - 1, 1, []
    for i in np.argsort(sizes, kind="stable"):
        size, free = int(sizes[i]), int(counts[i] - taken[i])
        if size > window or reach >> left & 1:
            break
        free, part = min(free, window // size), 1
        while free:  # a count as powers of two
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= reach << (part * size) & mask
            free, part = free - part, part * 2
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    best = below
    if above and (gap := (above & -above).bit_length()) < left - below:
        best = left + gap
    for i, part, before in reversed(steps):
        if not before >> best & 1:
            taken[i] += part
            best -= part * int(sizes[i])
    return taken


def _weighed(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target) of the few sources, weighed by the driver."""
    rows = sorted(sources.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(rows))]
    goal = targets([r["source_size"] for r in rows], weights, mix.most)
    return sources.sparkSession.createDataFrame(
        [(r["source"], r["source_size"], t) for r, t in zip(rows, goal, strict=True)], "source string, source_size long, target double"
    )


def _weighed_by_spark(sources: DataFrame, mix: Mix) -> DataFrame:
    """The same for any number of sources.

    A source is full if the words per weight, shared among those not full, exceed its own bound per weight. In the order of
    these bounds the full ones come first, so running sums of bounds and weights tell each source by itself.
    """
    # null last: no string comes before an empty one
    named = sources.select(
        "source", "source_size", F.col("source").isNull().cast("int").alias("null_last"), F.coalesce("source", F.lit("")).alias("name"),
    )
    placed = global_position(named, ["null_last", "name"], "place")
    at = F.pmod(F.col("place") - 1, F.lit(len(mix.weights))).cast("int")
    weighed = placed.withColumn("weight", F.element_at(F.lit([float(w) for w in mix.weights]), at + 1)).withColumn("most", (F.col("source_size") * mix.most).cast("double"))
    live = weighed.where("source_size > 0").withColumn("bound", F.col("most") / F.col("weight")).withColumn("all", F.lit(0))
    summed = running_totals(live, ["all"], [F.col("bound"), F.col("place")], ["source_size", "most", "weight"], ["bound", "place"])
    unit = (F.col("all_source_size") - (F.col("cum_most") - F.col("most"))) / (F.col("all_weight") - (F.col("cum_weight") - F.col("weight")))
    judged = pin(summed.withColumn("full", unit > F.col("bound")))
    rest = judged.where(~F.col("full")).agg(F.sum("weight")).scalar()
    left = judged.agg(F.max("all_source_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0.0))).scalar()
    goal = F.when(F.col("full"), F.col("most")).otherwise(left / rest * F.col("weight"))
    return judged.select("source", "source_size", goal.alias("target")).unionByName(
        weighed.where("source_size = 0").select("source", "source_size", F.lit(0.0).alias("target"))
    )


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, taken) for every row of (doc_id, text, source, ...).

    Size is the number of words; a null or blank text has none and is never taken. Sources stand in code-point order,
    null last and a source like any other. ``taken`` is the words taken of a row: its size times its repeats. The choice
    follows hashes of (doc_id, text), so reruns agree; among repeated rows any may be taken. A source without words has
    the target 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = pin(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    ))
    by_size = pin(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = pin(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = _weighed(sources, mix) if sources.limit(mix.max_sources + 1).count() <= mix.max_sources else _weighed_by_spark(sources, mix)

    def choose(group: pa.Table) -> pa.Table:
        sizes, counts = group.column("size").to_numpy(), group.column("n").to_numpy()
        whole, goal = group.column("source_size")[0].as_py(), group.column("target")[0].as_py()
        repeats = int(goal // whole) if whole else 0
        some = sizes > 0
        taken = np.zeros(len(sizes), dtype=np.int64)
        if some.any() and repeats < mix.most:
            taken[some] = fit(sizes[some], counts[some], round(goal - repeats * whole), mix.slots)
        return pa.table([group.column("source"), group.column("size"), pa.array(np.full(len(sizes), repeats, dtype=np.int64)), pa.array(taken)], ["source", "size", "repeats", "take"])

    # one row per exact size of a source: as many as the longest document has words, whatever the corpus
    sized = by_size.join(plan.alias("p"), by_size["source"].eqNullSafe(F.col("p.source"))).select(by_size["source"], "size", "n", "source_size", "target")
    chosen = pin(
        sized.where("source_size > 0").groupBy("source").applyInArrow(choose, "source string, size long, repeats long, take long")
    )
    counted = pin(
        sized.alias("a").join(chosen.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")) & (F.col("a.size") == F.col("c.size")), "left")
        .select("a.source", "a.size", "a.source_size", "a.target", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("take", F.lit(0)).alias("take"), "n")
    )
    return _select(rows, counted, mix.seed)


def _select(rows: DataFrame, counted: DataFrame, seed: int) -> DataFrame:
    """Marks the ``take`` rows of each (source, size) with the smallest seeded hashes.

    Hashes fall into cells; cells below the deciding one are taken whole, and only its rows are ranked. So a size that a
    third of all rows share is ranked in one cell of 4,096.
    """
    order = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    placed = rows.withColumn("cell", F.shiftrightunsigned(order, 52)).withColumn("order", order)
    cells = placed.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    running = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(running), F.lit(0)))
    c = counted.withColumnsRenamed({"source": "c_source", "size": "c_size"})
    quota = before.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))).select(
        F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("cell").alias("q_cell"), "source_size", "target", "repeats",
        F.greatest(F.lit(0), F.least("in_cell", F.col("take") - F.col("before"))).alias("quota"), "in_cell",
    )
    joined = placed.join(quota, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("cell") == F.col("q_cell")))
    ranked = Window.partitionBy("q_source", "q_size", "q_cell").orderBy("order", "doc_id")
    extra = F.when(F.row_number().over(ranked) <= F.col("quota"), 1).otherwise(0)
    return joined.select(
        "doc_id", "text_key", "source", "size", "source_size", "target", (F.col("size") * (F.col("repeats") + extra)).cast("long").alias("taken")
    )


def repeat_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept; rows without words are left out.

    Rows equal in id, text and source are one document, whose repeats are added.
    """
    ident, key, source, times, copies, number = free_names(docs, "_id", "_key", "_source", "_times", "_copies", "_n")
    names = [F.col("doc_id").alias(ident), F.col("text_key").alias(key), F.col("source").alias(source)]
    taken = mix_documents(docs, mix).where("taken > 0").select(*names, F.expr("taken DIV size").alias(times))
    counted = pin(taken.groupBy(ident, key, source).agg(F.sum(times).alias(times), F.count(F.lit(1)).alias(copies)))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col(ident))
        & (text_key() == F.col(key))
        & F.col("source").cast("string").eqNullSafe(F.col(source))
    )

    def spread(rows: DataFrame) -> DataFrame:
        return rows.select(*[rows[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(number)).drop(number)

    once = spread(docs.join(counted.where(F.col(copies) == 1), same))
    repeated = counted.where(F.col(copies) > 1)
    if repeated.isEmpty():
        return once
    return once.unionByName(spread(docs.join(repeated, same).dropDuplicates([ident, key, source])))
