"""Links between rows that share bucket keys: star candidates, exact cross pairs, distributed union-find."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronage.session import pin

#: Slots of the fixed-size bitmap; it fills 2 MB whatever the input.
SLOT_BITS = 24
MARK_BITS = 1024


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (id, root), root the smallest id; a root has no row of its own.

    Large-star and small-star steps alternate until nothing changes. Each step is a grouped minimum (combined
    before the shuffle) and a join that adaptive execution may split, and is stored in the shared folder.
    """
    pairs = pin(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = pin(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
        before, state = state, _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


@dataclass(frozen=True)
class Fronts:
    """The first elements of a set in a global order, of which sets with a Jaccard similarity of num / den share one.

    Of two linked sets of n and m at least o = (n + m) num / (den + num) elements are shared, so the first shared one has
    at most n - o elements before it in one set and m - o in the other. A place is kept as a 256th part of the front,
    rounded down, in the last byte of the element's key.
    """

    num: int
    den: int

    def size(self, n: int) -> int:
        return n * (self.den - self.num) // self.den + 1

    def place(self, x: str) -> Column:
        size = F.floor(F.col(f"{x}.n") * (self.den - self.num) / self.den) + 1
        return F.floor(F.col(f"{x}.place") * size / 256)

    def low(self, x: str) -> Column:
        """The place is within the part of the bound of the smaller set of a pair."""
        return self.place(x) * (self.den + self.num) <= F.col(f"{x}.n") * (self.den - self.num)

    def possible(self, x: str, y: str) -> Column:
        shared = (F.col(f"{x}.n") + F.col(f"{y}.n")) * self.num
        return ((F.col(f"{x}.n") - self.place(x)) * (self.den + self.num) >= shared) & (
            (F.col(f"{y}.n") - self.place(y)) * (self.den + self.num) >= shared
        )

    def members(self, keys: DataFrame) -> DataFrame:
        """(key, id) -> (key, id, place, centre, centre_place, leads): all members of an element but the foremost, the centre.

        Rows of an element are read in order as a stream, so a frequent one is never held in memory; elements with
        one id vanish here. The first member of each element ``leads``: it stands for the centre's own row.
        """

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last_key = last_id = kept_key = centre = centre_place = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                packed, ident = (batch.column(i).to_numpy() for i in (0, 1))
                key, place = packed >> 8, packed & 255
                first = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
                again = np.append(not first[0] and ident[0] == last_id, ident[1:] == ident[:-1]) & ~first
                begun = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
                centres = np.where(begun < 0, 0 if centre is None else centre, ident[begun])
                centre_places = np.where(begun < 0, 0 if centre_place is None else centre_place, place[begun])
                keep = (ident != centres) & ~again
                last_key, last_id, centre, centre_place = key[-1], ident[-1], centres[-1], centre_places[-1]
                if keep.any():
                    kept = key[keep]
                    leads = np.append(kept_key is None or kept[0] != kept_key, kept[1:] != kept[:-1])
                    kept_key = kept[-1]
                    columns = [kept, ident[keep], place[keep], centres[keep], centre_places[keep], leads]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "id", "place", "centre", "centre_place", "leads"])

        sorted_keys = keys.select("key", "id").repartition(F.shiftright("key", 8)).sortWithinPartitions("key", "id")
        return sorted_keys.mapInArrow(stream, "key long, id long, place long, centre long, centre_place long, leads boolean")


def front_components(members: DataFrame, sets: DataFrame, verify: Callable[[DataFrame], DataFrame], fronts: Fronts) -> DataFrame:
    """Components (id, root) of the sets (id, n, marks) that ``verify`` links, from the stored members of their fronts.

    First each set is compared with the centre with which it shares most of its front. Then all candidate pairs still in
    different components are compared; pairs inside a component cannot change the result and are not made.
    """
    num, den = fronts.num, fronts.den
    counted = members.groupBy("id", "centre").agg(F.count(F.lit(1)).alias("keys"))
    nearest = counted.groupBy("id").agg(F.max(F.struct("keys", "centre")).alias("best")).select("id", "best.centre")
    x, y = sets.alias("x"), sets.alias("y")
    sizes = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    swap = F.col("x.id") < F.col("y.id")

    def pair() -> list[Column]:
        return [
            F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"),
            F.when(swap, F.col("y.n")).otherwise(F.col("x.n")).alias("n_a"), F.when(swap, F.col("x.n")).otherwise(F.col("y.n")).alias("n_b"),
        ]

    stars = nearest.join(x, F.col("x.id") == nearest["id"]).join(y, F.col("y.id") == nearest["centre"]).where(sizes & few_odd("x", "y", num, den))
    links = pin(verify(pin(stars.select(*pair()).distinct())))
    roots = components(links)
    rows = members.select("key", "id", "place").unionByName(
        members.where("leads").select("key", F.col("centre").alias("id"), F.col("centre_place").alias("place"))
    )
    named = rows.join(roots, "id", "left").select("key", "id", "place", F.coalesce("root", "id").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rest = pin(named.join(mixed.select("key"), "key", "left_semi").join(sets, "id"))
    # of a pair, the smaller set has the first shared element within its own part of the bound; as one condition on both
    # sides, it leaves them alike, so that the rows are dealt out once
    low = F.when(F.col("x.n") <= F.col("y.n"), fronts.low("x")).otherwise(fronts.low("y"))
    crossing = (
        rest.alias("x")
        .join(
            rest.alias("y"),
            (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root"))
            & low & fronts.possible("x", "y") & few_odd("x", "y", num, den),
        )
        .select(*pair()).distinct()
    )
    crossing = pin(crossing)
    if crossing.isEmpty():
        return roots
    new = pin(verify(crossing))
    return roots if new.isEmpty() else components(links.unionByName(new))


def parity_marks(elements: np.ndarray, bits: int = MARK_BITS) -> np.ndarray:
    """1,024 bits or another power of two, each the parity of the elements that fall on it, as longs.

    Two sets differ in at least as many elements as their marks differ in bits, so marks rule out pairs and never a link.
    """
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def wide_marks(elements: np.ndarray) -> bytes | None:
    """Parity marks of at least as many bits as elements, for sets that would fill the marks of fixed size."""
    return parity_marks(elements, 1 << (len(elements) - 1).bit_length()).tobytes() if len(elements) > MARK_BITS else None


def odd_bits(a: bytes, b: bytes) -> int:
    """In how many bits two wide marks differ, the longer ones folded to the length of the others."""
    x, y = sorted((np.frombuffer(m, dtype=np.uint64) for m in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def few_odd(x: str, y: str, num: int, den: int) -> Column:
    """The marks of x and y differ in no more bits than linked sets of their sizes differ in elements."""
    bits = F.zip_with(f"{x}.marks", f"{y}.marks", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    odd = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    return odd * (den + num) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (den - num)


def half_marks(marks: str) -> Column:
    """Parity marks of half the bits: each the parity of two."""
    half = MARK_BITS // 128
    return F.zip_with(F.slice(marks, 1, half), F.slice(marks, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def linked_components(members: DataFrame, sets: DataFrame, verify: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Components (id, root) of the verified links among the members of each key, of sets (id, name, n, marks).

    Members go by their names, which sets may share. First each member is compared with the centre with which it shares most
    keys. Then all pairs of a key that are still in different components, and that their sizes and marks do not rule out, are
    compared; pairs inside a component cannot change the result and are not made. Rows of keys have half of the marks, which
    rule out most pairs before they are made.
    """
    counted = members.groupBy("id", "centre").agg(F.count(F.lit(1)).alias("keys"))
    nearest = counted.groupBy("id").agg(F.max(F.struct("keys", "centre")).alias("best")).select(F.col("id").alias("own"), "best.centre")
    x, y = sets.alias("x"), sets.alias("y")
    sizes = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    pair = [F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")]
    alike = sizes & few_odd("x", "y", num, den)
    stars = nearest.join(x, F.col("x.name") == F.col("own")).join(y, F.col("y.name") == F.col("centre")).where(alike).select(*pair).distinct()
    links = pin(verify(stars))
    roots = components(links)
    all_rows = members.select("key", F.col("id").alias("name")).unionByName(members.select("key", F.col("centre").alias("name")).distinct())
    named = pin(_with_root(all_rows.join(sets.select("name", "id", "n", half_marks("marks").alias("marks")), "name"), roots))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rest = pin(named.join(mixed.select("key"), "key", "left_semi"))
    meeting = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & alike
    pairs = pin(rest.alias("x").join(rest.alias("y"), meeting).select(*pair).distinct())
    crossing = pairs.join(x, F.col("x.id") == F.col("a")).join(y, F.col("y.id") == F.col("b")).where(alike).select("a", "b")
    new = pin(verify(crossing))
    return roots if new.isEmpty() else components(links.unionByName(new))


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "id", "left").select("key", "id", "n", "marks", F.coalesce("root", "id").alias("root"))


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the slots of all ids in the only column.

    It only spares rows a shuffle: a slot may be shared, so an exact join follows; when full it spares nothing.
    """
    slots = ids.select(F.col(ids.columns[0]).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot"))
    words = (
        slots.select(F.expr("slot >> 6").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    )
    found = np.zeros(1 << (SLOT_BITS - 6), dtype=np.int64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return found.view(np.uint64)


def in_bitmap(found: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = ids.astype(np.int64) & np.int64((1 << SLOT_BITS) - 1)
    return (found[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def share(spark: SparkSession, value: object):
    """A broadcast variable; callers state the bound of what they share."""
    return spark.sparkContext.broadcast(value)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used, before a next large shuffle is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until the table has no such column (in upper or lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(column: str = "text") -> Column:
    """A hash that, with the id, names a row where ids repeat or are null."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))
