"""Alignment of two tokenizers over the same bytes, by galloping intersection of their token ends.

Of each text, the shorter list of ends drives: each of its ends is searched in the longer list by doubling steps from the
place of an end before it, then by halving. Ends found in both lists cut the text into groups, and the differences of
neighbouring ranks are the ranges of tokens of the other list that a token overlaps. Python does this for all texts of a
block at once, in numpy.

How often a pair of ids is linked is counted over the corpus. Blocks send the counts of their distinct pairs, the sums
come back for these pairs only, and each block then reads its own links' counts. No task holds the table of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from patronage.llm.linking import share
from patronage.llm.textops import small_batches
from patronage.llm.tokens import Encoder, Vocabulary, Words, cut_words, ragged, spaced
from patronage.session import pin

#: Every this many ends one is searched from the text's start; the others start from the one before them.
STRIDE = 64
#: Bytes of text that are aligned at a time, and that a block holds at most unless one text is longer.
ALIGNED_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
#: A pair of ids is one long: the id of B in its upper half, that of A in the lower.
HALF = 32

DOCUMENT = ["n_a", "n_b", "n_groups", "n_links"]
#: Of each document: its columns, then its distinct pairs (``n_pairs`` of them) as steps from one place in the block's pairs to the next,
#: and how often each is linked.
BLOCK = (
    "block long, doc_id array<long>, groups_sha256 array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, n_pairs array<long>, step array<int>, times array<int>, pair array<long>, seen array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def gallop(needles: np.ndarray, hay: np.ndarray, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each needle the first place in ``hay`` from ``low`` and below ``stop`` whose value is not smaller, else ``stop``.

    The step doubles until it passes the needle; the last step's range is then halved.
    """
    low, high, step = low.copy(), np.minimum(low, stop), np.ones(len(needles), dtype=np.int64)
    active = np.flatnonzero(high < stop)
    while len(active):
        active = active[hay[high[active]] < needles[active]]
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step[active], stop[active])
        step[active] *= 2
        active = active[high[active] < stop[active]]
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) // 2
        smaller = hay[middle] < needles[active]
        low[active[smaller]] = middle[smaller] + 1
        high[active[~smaller]] = middle[~smaller]
        active = active[low[active] < high[active]]
    return low


def ranks(needles: np.ndarray, bounds: np.ndarray, hay: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places of sorted needles, list by list (``bounds``), in the parts ``start`` to ``stop`` of ``hay``."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(needles)) - bounds[:-1][owner]
    first = np.flatnonzero(within % STRIDE == 0)
    posts = gallop(needles[first], hay, start[owner[first]], stop[owner[first]])
    # each needle starts from the place of the post before it, which is no further than its own
    post = np.cumsum(within % STRIDE == 0) - 1
    return gallop(needles, hay, posts[post], stop[owner])


@dataclass(frozen=True)
class Side:
    """Tokens of all texts of a batch by one tokenizer: ids, ends in bytes over the whole batch, and where each text begins."""

    ids: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)


def _spelled(encoder: Encoder, words: Words, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each distinct word, whether the bytes of its tokens are its own."""
    entries, at, listed = encoder.entries, bounds.tolist(), ids.tolist()
    sizes = np.diff(np.concatenate(([0], np.cumsum(encoder.lengths[ids])))[bounds])
    right = sizes == np.array([len(w) for w in words.distinct], dtype=np.int64)
    if right.all() and b"".join([entries[t] for t in listed]) == b"".join(words.distinct):
        return right
    for i in np.flatnonzero(right).tolist():
        right[i] = b"".join([entries[t] for t in listed[at[i]:at[i + 1]]]) == words.distinct[i]
    return right


def sides(texts: pa.LargeStringArray, a: Vocabulary, b: Vocabulary) -> tuple[Side, Side]:
    """Both tokenizations of space + text; no tokens for an empty text or one that either tokenizer does not give back."""
    words = cut_words(spaced(texts), a.cuts and b.cuts)
    coded = [(v.encoder(), *v.encoder().ids(words.distinct)) for v in (a, b)]
    right = np.logical_and(*(_spelled(e, words, ids, bounds) for e, ids, bounds in coded))
    wrong = np.concatenate(([0], np.cumsum(~right[words.place])))[words.bounds]
    empty = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset:]) == 0
    kept = (np.diff(wrong) == 0) & ~empty
    place = words.place[np.repeat(kept, np.diff(words.bounds))]
    first = np.concatenate(([0], np.cumsum(np.diff(words.bounds) * kept)))
    out = []
    for encoder, ids, bounds in coded:
        where, begin = ragged(bounds, place)
        out.append(Side(ids[where], np.cumsum(encoder.lengths[ids[where]]), begin[first]))
    return out[0], out[1]


@dataclass(frozen=True)
class Aligned:
    """Common ends (last token of each group by side), and links as the token numbers of both sides and the text's number."""

    last_a: np.ndarray
    last_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_text: np.ndarray
    n_groups: np.ndarray


def _driven(short: Side, long: Side, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts whose shorter list is ``short``: common ends and links as (token of short, token of long), in order."""
    sizes = short.sizes * chosen
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    token = np.flatnonzero(np.repeat(chosen, short.sizes))
    start, stop = long.bounds[:-1], long.bounds[1:]
    rank = ranks(short.ends[token], bounds, long.ends, start, stop)
    same = long.ends[rank] == short.ends[token]  # the last ends of a text are always the same
    # a token overlaps from the rank of the end before it, or one on if that end is common, to its own rank
    low = np.empty(len(rank), dtype=np.int64)
    low[1:] = rank[:-1] + same[:-1]
    heads = bounds[:-1][sizes > 0]
    low[heads] = start[sizes > 0]
    width = rank - low + 1
    begin = np.cumsum(width) - width
    other = np.arange(int(width.sum())) - np.repeat(begin - low, width)
    return token[same], rank[same], np.repeat(token, width), other


def align(a: Side, b: Side) -> Aligned:
    by_a = a.sizes <= b.sizes
    last_a, last_b, link_a, link_b = _driven(a, b, by_a)
    more_b, more_a, other_b, other_a = _driven(b, a, ~by_a)
    last_a, last_b = np.concatenate((last_a, more_a)), np.concatenate((last_b, more_b))
    order = np.argsort(last_a, kind="stable")
    link_a, link_b = np.concatenate((link_a, other_a)), np.concatenate((link_b, other_b))
    text = np.repeat(np.arange(len(by_a)), a.sizes)
    return Aligned(last_a[order], last_b[order], link_a, link_b, text[link_a], np.bincount(text[last_a], minlength=len(by_a)))


def linked_pairs(a: Side, b: Side, found: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ids of each text in order, how often each is linked, and how many distinct ones each text has."""
    known, place = np.unique((b.ids[found.link_b] << HALF) + a.ids[found.link_a], return_inverse=True)
    key, times = np.unique(found.link_text * max(1, len(known)) + place, return_counts=True)
    return known[key % max(1, len(known))], times, np.bincount(key // max(1, len(known)), minlength=len(a.sizes))


class Printer:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.text = [f"{mark}{i}".encode() for mark in ";,|" for i in range(size)]

    def digests(self, a: Side, b: Side, found: Aligned) -> list[str]:
        """The SHA-256 of each text's groups; nothing for a text without tokens."""
        starts_a, starts_b = (np.concatenate(([0], last + 1)) for last in (found.last_a, found.last_b))
        out = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        group_a, group_b = (np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in (starts_a, starts_b))
        opens_a, opens_b = np.zeros(len(a.ids), dtype=bool), np.zeros(len(b.ids), dtype=bool)
        opens_a[starts_a[:-1]] = opens_b[starts_b[:-1]] = True
        # within the whole, a group's ids of A come after all ids of the groups before, and its ids of B after those
        out[np.arange(len(a.ids)) + starts_b[:-1][group_a]] = a.ids + np.where(opens_a, 0, self.size)
        out[np.arange(len(b.ids)) + starts_a[1:][group_b]] = b.ids + np.where(opens_b, 2 * self.size, self.size)
        text, codes, at = self.text, out.tolist(), (a.bounds + b.bounds).tolist()
        return [hashlib.sha256(b"".join([text[c] for c in codes[i:j]])[1:]).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]


def align_blocks(docs: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """Blocks of aligned texts: the documents' columns, their distinct pairs with counts, and each link's place among these."""
    shared = share(docs.sparkSession, (a, b))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        va, vb = shared.value
        printer = Printer(max(len(va.encoder().entries), len(vb.encoder().entries)))
        number, gathered, held = 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number
            ids, digests, numbers, found, times = zip(*gathered, strict=True)
            pairs, place = np.unique(np.concatenate(found), return_inverse=True)
            numbers, times = np.concatenate(numbers, axis=1), np.concatenate(times)
            step = np.diff(place, prepend=0)
            heads = (np.cumsum(numbers[-1]) - numbers[-1])[numbers[-1] > 0]
            step[heads] = place[heads]
            columns = [
                pa.concat_arrays(ids), pa.array([d for part in digests for d in part], pa.string()), *map(pa.array, numbers),
                pa.array(step.astype(np.int32)), pa.array(times.astype(np.int32)),
                pa.array(pairs), pa.array(np.bincount(place, times, len(pairs)).astype(np.int64)),
            ]
            number += 1
            ident = (TaskContext.get().partitionId() << 32) + number
            rows = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            names = ["block", "doc_id", "groups_sha256", *DOCUMENT, "n_pairs", "step", "times", "pair", "seen"]
            return pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), *rows], names)

        for batch in small_batches(batches, limit=ALIGNED_BYTES):
            texts = batch.column("text")
            size = int(pc.sum(pc.binary_length(texts)).as_py())
            if gathered and held + size > BLOCK_BYTES:
                yield block()
                gathered, held = [], 0
            side_a, side_b = sides(texts, va, vb)
            found = align(side_a, side_b)
            pairs, times, n_pairs = linked_pairs(side_a, side_b, found)
            n_links = np.bincount(found.link_text, minlength=len(texts))
            numbers = np.array([side_a.sizes, side_b.sizes, found.n_groups, n_links, n_pairs], dtype=np.int64)
            gathered.append((batch.column("doc_id"), printer.digests(side_a, side_b, found), numbers, pairs, times))
            held += size
        if gathered:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(blocks, BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair of ids over all blocks, and whether no pair with the same id of B has more."""
    counted = blocks.select(F.explode(F.arrays_zip("pair", "seen")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.seen").alias("count"))
    counted = pin(counted)
    most = counted.groupBy(F.shiftright("pair", HALF).alias("b")).agg(F.max("count").alias("most"))
    return counted.join(most, F.shiftright("pair", HALF) == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(key: tuple, block: pa.Table, counts: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links."""
    columns = {c: block.column(c).combine_chunks().flatten() for c in ("doc_id", "groups_sha256", *DOCUMENT)}
    n_pairs, step, times = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("n_pairs", "step", "times"))
    bounds = np.concatenate(([0], np.cumsum(n_pairs)))
    total = np.concatenate(([0], np.cumsum(step, dtype=np.int64)))
    at = total[1:] - np.repeat(total[bounds[:-1]], n_pairs)  # steps begin anew in each text
    place, sums = counts.column("place").to_numpy(), []
    for c in ("best", "count"):
        of_pair = np.zeros(len(place), dtype=np.int64)
        of_pair[place] = counts.column(c).to_numpy()
        sums.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(of_pair[at] * times)))[bounds])))
    return pa.table([columns["doc_id"], *(columns[c] for c in DOCUMENT), *sums, columns["groups_sha256"]], ["doc_id", *DOCUMENT, "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of (doc_id, text, ...).

    Texts are aligned as space + text. A text that is null or empty, or that either tokenizer does not give back byte by
    byte, has no tokens: zeros and an empty groups_sha256. A link is a pair of token occurrences with overlapping bytes; a
    pair of ids counts as often as it is linked in all rows, repeated rows included. Pairs that tie for the highest count
    of an id of B are all best. Ids may be null or repeated; other columns are not read; a very long text is a block of its
    own. An empty table gives an empty result.
    """
    blocks = pin(align_blocks(docs, a, b))
    asked = blocks.select(F.col("block").alias("asked"), F.posexplode("pair").alias("place", "pair"))
    told = asked.join(pair_counts(blocks.select("pair", "seen")), "pair").select("asked", "place", "count", F.col("best").cast("long").alias("best"))
    return blocks.drop("pair", "seen").groupBy("block").cogroup(told.groupBy("asked")).applyInArrow(_sums, RESULT)
