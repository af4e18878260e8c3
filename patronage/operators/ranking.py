"""Order statistics over a whole table without a single-task window.

A window ordered over ``()`` sends every row to one task. Here the rows are range-partitioned, each
partition is summed, and the few per-partition sums become offsets. Ranks and quantiles of a column
are taken from its histogram (one row per distinct value), so a value shared by a third of the rows
is one row before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.numeric import finite
from patronage.session import pin

QUINTILES = (0.2, 0.4, 0.6, 0.8)

#: Hexadecimal digits of a hash that name a cell: 65,536 cells.
CELL_DIGITS = 4

# A value held by at least 1/HOT_SHARE of the rows is "hot"; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
SPREAD = 4096


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], measures: Sequence[str], order_cols: Sequence[str],
    few_groups: bool = True,
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive running sum within group) and ``all_<m>`` (group total) per measure.

    ``order_cols`` names the columns behind ``order``; rows must be unique on group + order columns. With ``few_groups``
    the groups are a fixed list (columns of a table, labels), so the offsets are broadcast; else Spark joins them by size.
    """
    placed = pin(
        df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    )
    per_part = placed.groupBy(*group, "_part").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per partition and group boundary: bounded by the number of shuffle partitions
    offsets = per_part.select(
        *group,
        "_part",
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )
    local = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(m).over(local).alias(f"_local_{m}") for m in measures])
    offsets = offsets.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate([*group, "_part"])})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate([*group, "_part"])]  # null is a group, too
    joined = summed.join(F.broadcast(offsets) if few_groups else offsets, same)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{m}") + F.col(f"_local_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"all_{m}") for m in measures],
    )


def global_position(
    df: DataFrame, order: Sequence[str], out: str = "position", group: Sequence[str] = (), few_groups: bool = True
) -> DataFrame:
    """1-based position of each row in the order (within ``group``) plus the row count ``all_rows``.

    The order must end in a unique key: it both fixes ties and lets a hot value span partitions.
    """
    keyed = df.withColumn("_rows", F.lit(1).cast("long"))
    if not group:
        keyed = keyed.withColumn("_all", F.lit(1))
        group = ["_all"]
    ranked = running_totals(keyed, group, [F.col(c) for c in order], ["_rows"], order, few_groups)
    return ranked.select(*df.columns, F.col("cum__rows").alias(out), F.col("all__rows").alias("all_rows"))


@dataclass(frozen=True)
class Histogram:
    """Distinct values of several columns with running counts: (metric, value, cnt, cum_cnt, all_cnt)."""

    rows: DataFrame
    metrics: tuple[str, ...]
    known: dict[tuple[float, ...], dict[str, dict]] = field(default_factory=dict, compare=False)


def value_counts(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """(metric, value, cnt) of the finite values of each column, all columns in one pass."""
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    entries = [F.struct(F.lit(m).alias("metric"), finite(c).alias("value")) for m, c in columns.items()]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.metric", (F.col("e.value") + F.lit(0.0)).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def histogram(df: DataFrame, columns: Mapping[str, Column] | Sequence[str]) -> Histogram:
    """Running counts of the finite values of each column."""
    counts = value_counts(df, columns)
    return Histogram(running_totals(counts, ["metric"], [F.col("value")], ["cnt"], ["value"]), tuple(columns))


def quantiles(hist: Histogram, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row (metric, n, min, max, q array) per metric."""
    before, upto, n = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt"), F.col("all_cnt")

    def value_at(index: Column) -> Column:
        return F.max(F.when((before <= index) & (index < upto), F.col("value")))

    parts = []
    for i, p in enumerate(probs):
        place = (n - 1).cast("double") * F.lit(p)
        parts += [
            value_at(F.floor(place)).alias(f"_lo{i}"),
            value_at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_w{i}"),
        ]
    picked = hist.rows.groupBy("metric").agg(
        F.max("all_cnt").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), *parts
    )
    return picked.select(
        "metric", "n", "min", "max",
        F.array(
            *[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}") for i in range(len(probs))]
        ).alias("q"),
    )


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], probs: Sequence[float], accuracy: int = 2000) -> DataFrame:
    """``quantiles`` of continuous columns without sorting them: (metric, n, min, max, q array).

    A mergeable sketch brackets each quantile; one pass counts the values below the bracket and keeps those inside, some
    4 / ``accuracy`` of the rows, of which the exact value is picked. A bracket that the sketch missed is widened until it
    holds its quantile. The driver sees brackets and results only, a few numbers for each column and quantile.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    names, spark = list(columns), df.sparkSession
    values = df.select(*[(finite(c) + F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(columns.values())])
    sizes = values.agg(*[x for i in range(len(names)) for x in (F.count(f"v{i}"), F.min(f"v{i}"), F.max(f"v{i}"))]).first()
    n, low, high = ([sizes[3 * i + k] for i in range(len(names))] for k in range(3))
    places = {(i, j): (n[i] - 1) * p for i in range(len(names)) if n[i] for j, p in enumerate(probs)}
    found: dict[tuple[int, int], float] = {}
    width = 2.0 / accuracy
    while open_ := [k for k in places if k not in found]:
        shares = {i: sorted({min(max(probs[j] + side * width, 0.0), 1.0) for k, j in open_ if k == i for side in (-1, 1)}) for i in {k for k, _ in open_}}
        sketch = values.agg(*[F.percentile_approx(f"v{i}", shares[i], accuracy).alias(f"s{i}") for i in shares]).first()
        brackets = {}
        for i, j in open_:
            at = dict(zip(shares[i], sketch[f"s{i}"], strict=True))
            ends = [min(max(probs[j] + side * width, 0.0), 1.0) for side in (-1, 1)]
            brackets[i, j] = (low[i] if ends[0] == 0.0 else at[ends[0]], high[i] if ends[1] == 1.0 else at[ends[1]])
        below = values.agg(*[F.count(F.when(F.col(f"v{i}") < F.lit(brackets[i, j][0]), 1)) for i, j in open_]).first()
        entries = F.array(*[
            F.when(F.col(f"v{i}").between(*brackets[i, j]), F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("value"))) for i, j in open_
        ])
        inside = values.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy("e.i", "e.j", "e.value").agg(F.count(F.lit(1)).alias("cnt"))
        upto = F.sum("cnt").over(Window.partitionBy("i", "j").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        wanted = spark.createDataFrame(
            [(i, j, float(places[i, j] // 1) - below[x], float(-(-places[i, j] // 1)) - below[x]) for x, (i, j) in enumerate(open_)], "i int, j int, lo double, hi double"
        )
        kept = inside.withColumn("upto", upto).join(F.broadcast(wanted), ["i", "j"])  # one row per column and quantile

        def value_at(place: str) -> Column:
            return F.max(F.when((F.col("upto") - F.col("cnt") <= F.col(place)) & (F.col(place) < F.col("upto")), F.col("value")))

        for r in kept.groupBy("i", "j").agg(value_at("lo").alias("a"), value_at("hi").alias("b")).collect():
            if r["a"] is not None and r["b"] is not None:
                place = places[r["i"], r["j"]]
                found[r["i"], r["j"]] = r["a"] + (r["b"] - r["a"]) * (place - place // 1)
        width *= 8
    rows = [(m, n[i], low[i], high[i], [found[i, j] for j in range(len(probs))]) for i, m in enumerate(names) if n[i]]
    return spark.createDataFrame(rows, "metric string, n long, min double, max double, q array<double>")


def quantile_values(hist: Histogram, probs: Sequence[float]) -> dict[str, dict]:
    """The quantiles as driver values: one small row per metric, whatever the data size."""
    probs = tuple(probs)
    if probs not in hist.known:
        hist.known[probs] = {r["metric"]: r.asDict() for r in quantiles(hist, probs).collect()}
    return hist.known[probs]


def average_ranks(hist: Histogram) -> DataFrame:
    """Histogram rows with ``avg_rank`` (ties share the mean of their positions)."""
    return hist.rows.withColumn(
        "avg_rank", ((F.col("cum_cnt") - F.col("cnt")) * 2 + F.col("cnt") + 1).cast("double") / F.lit(2.0)
    )


def attach_average_ranks(
    df: DataFrame, key: str, hist: Histogram, columns: Mapping[str, Column] | None = None, percent: bool = True
) -> DataFrame:
    """Add ``<metric>_rank`` for each metric: the average rank, divided by the count if ``percent``.

    Rows meet the histogram on (metric, value). Hot values come from a broadcast of at most
    HOT_SHARE rows per metric; their rows are spread over the shuffle under keys that match nothing.
    """
    columns = columns or {m: F.col(m) for m in hist.metrics}
    ranks = average_ranks(hist)
    rank = F.col("avg_rank") / F.col("all_cnt") if percent else F.col("avg_rank")
    is_hot = F.col("cnt") * HOT_SHARE >= F.col("all_cnt")
    hot = ranks.where(is_hot).select("metric", "value", rank.alias("_hot"))
    cold = ranks.where(~is_hot).select("metric", "value", F.lit(0).alias("_spread"), rank.alias("_cold"))
    entries = [
        F.struct(F.lit(m).alias("metric"), (finite(c) + F.lit(0.0)).alias("value")) for m, c in columns.items()
    ]
    long = df.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.metric", "e.value")
    found = (
        long.where(F.col("value").isNotNull())
        .join(F.broadcast(hot), ["metric", "value"], "left")
        .withColumn(
            "_spread",
            F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int") + 1),
        )
        .join(cold, ["metric", "value", "_spread"], "left")
        .withColumn("_rank", F.coalesce("_hot", "_cold"))
    )
    wide = found.groupBy(key).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("_rank"))).alias(f"{m}_rank") for m in columns]
    )
    return df.join(wide, key, "left")


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of every group, for any k.

    ``order`` must end in a unique key. Up to Spark's threshold for it, each task keeps its own first k rows of a group and
    only those meet; larger k are ranked by range partitions. Either way only group and order columns move, and the other
    columns (texts) join the at most k keys per group afterwards.
    """
    keys = [*group, *order]
    few = df.select(*keys)
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        placed = few.withColumn("_rank", rank)
    else:
        placed = global_position(few, order, "_rank", group, few_groups=False)
    same = [F.col(f"_all.{c}").eqNullSafe(F.col(f"_few.{c}")) for c in keys]
    return df.alias("_all").join(placed.where(F.col("_rank") <= k).select(*keys).alias("_few"), same, "left_semi")


def smallest_by_hash(df: DataFrame, order: Sequence[str], wanted: Column, group: Sequence[str] = (), out: str = "chosen") -> DataFrame:
    """Add ``out``: whether a row is among the first ``wanted`` of its group in the order, without ordering the rows.

    ``order`` starts with a hash in hexadecimal digits and ends in a unique key; ``wanted`` is an expression of ``all_rows``,
    the size of the group. Rows are counted by the first digits of the hash; cells before the one that decides are taken
    whole, and only the rows of that cell are ranked. Rows with a null in a group column are a group like any other.
    """
    if not group:
        return smallest_by_hash(df.withColumn("_all", F.lit(1)), order, wanted, ["_all"], out).drop("_all")
    named = {c: f"_g{i}" for i, c in enumerate(group)}
    digits = F.substring(order[0], 1, CELL_DIGITS)
    counted = df.groupBy(*[F.col(c).alias(g) for c, g in named.items()], digits.alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*named.values())
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = counted.withColumns({"all_rows": F.sum("_rows").over(whole), "_before": before}).withColumn("_wanted", wanted)
    deciding = sized.where((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_rows") > F.col("_wanted")))
    # of each group the cell in which the last wanted row lies, and the cells before it
    last = sized.groupBy(*named.values()).agg(F.max(F.when(F.col("_before") + F.col("_rows") <= F.col("_wanted"), F.col("_cell"))).alias("_whole"))
    part = deciding.select(*[F.col(g).alias(f"_d{g}") for g in named.values()], F.col("_cell").alias("_part"), (F.col("_wanted") - F.col("_before")).alias("_rest"))
    both = last.join(part, [F.col(g).eqNullSafe(F.col(f"_d{g}")) for g in named.values()], "left")
    same = [F.col(c).eqNullSafe(F.col(g)) for c, g in named.items()]
    # one row a group, stored, so that its size decides how it is joined
    placed = df.join(pin(both.drop(*[f"_d{g}" for g in named.values()])), same).withColumn("_cell", digits)
    open_cell = F.col("_cell").eqNullSafe(F.col("_part"))
    settled = placed.where(~open_cell).withColumn(out, F.coalesce(F.col("_cell") <= F.col("_whole"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*named.values()).orderBy(*order))
    ranked = placed.where(open_cell).withColumn(out, rank <= F.col("_rest"))
    return settled.unionByName(ranked).select(*df.columns, out)


def equal_width_score(position: Column, n: Column, bins: int = 5, higher_is_better: bool = True) -> Column:
    """Score of a rank percentile cut into equal-width bins over [1/n, 1]."""
    n = n.cast("double")
    low, high = F.lit(1.0) / n, F.lit(1.0)
    pad = F.when(low == high, F.lit(0.001)).otherwise(F.lit(0.0))  # a single row: widen as a cut would
    low, high = low - pad, high + pad
    share = position.cast("double") / n
    score = F.lit(1)
    for k in range(1, bins):
        score = score + (share > F.lit(float(k)) * ((high - low) / F.lit(float(bins))) + low).cast("int")
    return (score if higher_is_better else F.lit(bins + 1) - score).cast("int")


def rank_quintile(
    df: DataFrame, key: str, column: str, out: str, bins: int = 5, higher_is_better: bool = True
) -> DataFrame:
    """Score 1..bins by rank (ties in key order), the rank percentile cut at equal widths."""
    ranked = global_position(df.select(key, column), [column, key], "_pos")
    scores = ranked.select(
        key, equal_width_score(F.col("_pos"), F.col("all_rows"), bins, higher_is_better).alias(out)
    )
    return df.join(scores, key, "left")


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """1 + number of inner edges below the value (bins are closed on the right)."""
    bin_no = F.lit(1)
    for edge in edges:
        bin_no = bin_no + (c > F.lit(float(edge))).cast("int")
    return F.when(c.isNotNull(), bin_no.cast("int"))


def quantile_cut_is_usable(hist: Histogram, edges: Mapping[str, dict]) -> dict[str, bool]:
    """Per metric: are all edges distinct and every bin non-empty? One aggregate over the histogram."""
    usable = {}
    checks = []
    for m in hist.metrics:
        cuts = [edges[m]["min"], *edges[m]["q"], edges[m]["max"]]
        usable[m] = len(set(cuts)) == len(cuts)
        bin_no = quantile_bin(F.col("value"), edges[m]["q"])
        checks.append(F.count_distinct(F.when(F.col("metric") == m, bin_no)).alias(m))
    filled = hist.rows.agg(*checks).first()
    return {m: usable[m] and filled[m] == len(edges[m]["q"]) + 1 for m in hist.metrics}


def quantile_scores(
    df: DataFrame, key: str, columns: Mapping[str, tuple[str, bool]], hist: Histogram | None = None, bins: int = 5
) -> DataFrame:
    """Score columns 1..bins at their quantiles; a column with too few distinct edges is scored by rank.

    ``columns`` maps output name to (column, higher_is_better). The few edges are driver literals.
    """
    hist = hist or histogram(df, sorted({c for c, _ in columns.values()}))
    edges = quantile_values(hist, QUINTILES if bins == 5 else [k / bins for k in range(1, bins)])
    usable = quantile_cut_is_usable(hist, edges)
    for out, (column, higher) in columns.items():
        if usable[column]:
            score = quantile_bin(F.col(column).cast("double"), edges[column]["q"])
            df = df.withColumn(out, score if higher else F.lit(bins + 1) - score)
        else:
            df = rank_quintile(df, key, column, out, bins, higher)
    return df


def min_max(c: str | Column) -> Column:
    """Min-max scaling over the frame, 0.5 for a constant column. For small aggregated frames only."""
    c = F.col(c) if isinstance(c, str) else c
    everything = Window.partitionBy()
    low, high = F.min(c).over(everything), F.max(c).over(everything)
    return F.when(high == low, F.lit(0.5)).otherwise((c - low) / (high - low))


def capped_histogram(
    df: DataFrame, column: str, bins: int, cap_prob: float = 0.95, whole_cap: bool = False, by: str | None = None
) -> DataFrame:
    """Counts in equal-width bins of the values up to the ``cap_prob`` quantile, optionally per group.

    Without ``by`` everything comes from the stored histogram, so ``df`` is read once. With ``by`` the
    bins are still those of all kept values.
    """
    hist = histogram(df, [column])
    q = quantile_values(hist, [cap_prob])[column]
    low, cap = float(q["min"]), float(q["q"][0])
    if whole_cap:
        cap = float(int(cap))
    value = F.col("value")
    kept = hist.rows.where(value <= F.lit(cap)).select("value", "cnt")
    width = (kept.agg(F.max(value)).scalar() - F.lit(low)) / F.lit(float(bins))
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((value - F.lit(low)) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(bins - 1))
    )
    keys = [slot.cast("int").alias("bin")]
    if by is not None:
        values = df.select(F.col(by), finite(column).alias("value")).where(value <= F.lit(cap))
        kept, keys = values.withColumn("cnt", F.lit(1).cast("long")), [F.col(by), *keys]
    return kept.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
