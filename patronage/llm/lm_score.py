"""Language-model scores by a weighted backoff automaton over words.

Each word is a state, reached by that word from anywhere; the text's start is the state of the end token. Its arcs are
the words seen after it in training, and a failure arc leads to the empty state, whose arcs are all words. With
c the training counts, P(v) = (c(v) + 1) / (N + V + 1) is the weight of the empty state's arc, (c(uv) + m P(v)) / (c(u) + m)
that of an arc of state u, and m / (c(u) + m) that of its failure arc, so the arcs of each state sum to one.

Texts are read in blocks of neighbouring rows. A block asks for the counts of its own words and word pairs only: the
owner of a range of keys adds up what all blocks have counted, and sends back where the sum differs. Each block then holds
the part of the automaton that its texts visit, and walks it. So no task holds the model and no text is read by two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patronage.llm.textops import U, mix, mix_one, small_batches, words

#: Key of the end token, which ends each text and whose state begins the next.
END = U(mix_one(0x0E4D) | 1)
#: Tokens that a task gathers before it counts them.
GATHERED = 1 << 21
#: Tokens of the corpus per key range.
RANGE_TOKENS = 1 << 20
BYTES_PER_TOKEN = 6


@dataclass(frozen=True)
class Backoff:
    """``weight`` is m above: as many imagined words follow each word by the empty state's law."""

    weight: float = 100.0


def file_blocks(rows: int = 4096) -> Column:
    """Blocks of neighbouring rows of a stored table: the same in every scan of it."""
    return F.xxhash64(F.col("_metadata.file_path"), F.expr(f"_metadata.row_index DIV {rows}"))


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, which the shuffle's own compression shrinks."""
    return values.astype(U).view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view(U).ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=U(0)))


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(_values(packed), dtype=U)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, each text closed by the end token, and where each text begins. Word keys are odd."""
    found, bounds = words(texts)
    n = len(bounds) - 1
    out = np.empty(len(found) + n, dtype=U)
    ends = bounds[1:] + np.arange(n)
    rest = np.ones(len(out), dtype=bool)
    rest[ends] = False
    out[rest], out[ends] = found | U(1), END
    return out, bounds + np.arange(n + 1)


def _pairs(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of (state, token), the state being the token before or, at a text's start, the end token. Pair keys are even."""
    state = np.append(END, tokens[:-1])
    state[bounds[:-1]] = END
    return mix(state * U(mix_one(7) | 1) + tokens) & ~U(1)


def _counted(seen: list[np.ndarray], asked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys in order, and how often each is in ``seen``."""
    known, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, U), np.zeros(0, np.int64))
    if not asked:
        return known, counts
    keys = np.union1d(known, np.concatenate(asked))
    out = np.zeros(len(keys), dtype=np.int64)
    out[np.searchsorted(keys, known)] = counts
    return keys, out


def _requests(docs: DataFrame, bits: int) -> DataFrame:
    """(range, block, keys, counts): what each block has counted, cut by key range; held-out texts ask only."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen, asked, held_tokens = None, [], [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _counted(seen, asked)
            rows = [(place, current, _pack(keys[part]), _planes(counts[part])) for place, part in _ranges(keys, bits)]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["range", "block", "keys", "counts"])

        for batch in small_batches(batches):
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
            for start, stop in zip(edges, np.append(edges[1:], len(blocks)), strict=True):
                if current is not None and (blocks[start] != current or held_tokens > GATHERED):
                    yield flush()
                    seen, asked, held_tokens = [], [], 0
                current = int(blocks[start])
                part = batch.slice(start, stop - start)
                tokens, bounds = _tokens(part.column("text"))
                held = _held(part, bounds)
                for keys in (tokens, _pairs(tokens, bounds)):
                    seen.append(keys[~held])
                    asked.append(keys[held])
                held_tokens += len(tokens)
        if current is not None:
            yield flush()

    rows = docs.select("block", "held_out", "text")
    return rows.mapInArrow(gather, "range long, block long, keys binary, counts binary")


def _held(batch: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
    """Which tokens are in held-out texts."""
    return np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted keys fall into, by their leading bits, and where."""
    places = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    for start, stop in zip(starts, np.append(starts[1:], len(keys)), strict=True):
        yield int(places[start]), slice(start, stop)


def _summed(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all requests of a key range: keys and own counts, sorted by key; where each key begins; the sums; each entry's row."""
    parts = [_unpack(k.as_py()) for k in group.column("keys")]
    keys = np.concatenate(parts)
    own = np.concatenate([_values(c.as_py()) for c in group.column("counts")])
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, own, row = keys[order], own[order].astype(np.int64), row[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys, own, starts, np.add.reduceat(own, starts), row


def vocabulary(docs: DataFrame, bits: int) -> tuple[int, int]:
    """N and V: all and distinct tokens of the training texts. Tasks count their tokens and send their distinct words."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kept, n = [], 0, 0

        def flush() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(seen))
            rows = [(place, _pack(keys[part])) for place, part in _ranges(keys, bits)]
            ranges, packed = zip(*rows, strict=True) if rows else ((), ())
            first = [n] + [0] * (len(ranges) - 1) if ranges else []
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(packed, pa.binary()), pa.array(first, pa.int64())], ["range", "keys", "n"])

        for batch in small_batches(batches):
            tokens, _ = _tokens(batch.column("text"))
            n += len(tokens)
            seen.append(np.unique(tokens))
            kept += len(seen[-1])
            if kept > GATHERED:
                yield flush()
                seen, kept, n = [], 0, 0
        if seen:
            yield flush()

    def size(group: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([_unpack(k.as_py()) for k in group.column("keys")]))
        return pa.table({"n": pa.array([sum(group.column("n").to_pylist())]), "v": pa.array([len(keys)])})

    found = docs.where("NOT held_out").select("text").mapInArrow(gather, "range long, keys binary, n long")
    n, v = found.groupBy("range").applyInArrow(size, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0


def _answers(docs: DataFrame, bits: int) -> DataFrame:
    """(block, keys, totals): the sums over all blocks of the keys a block has, where they differ from its own counts."""

    def answer(group: pa.Table) -> pa.Table:
        keys, own, starts, sums, row = _summed(group)
        totals = np.repeat(sums, np.diff(np.append(starts, len(keys))))
        changed = totals != own
        keys, totals, row = keys[changed], totals[changed], row[changed]
        order = np.argsort(row, kind="stable")  # in a row the keys stay in order
        keys, totals, row = keys[order], totals[order], row[order]
        blocks, out = group.column("block").to_pylist(), []
        edges = np.searchsorted(row, np.arange(len(blocks) + 1))
        for i, block in enumerate(blocks):
            if edges[i] < edges[i + 1]:
                part = slice(edges[i], edges[i + 1])
                out.append((block, _pack(keys[part]), _planes(totals[part])))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "keys", "totals"])

    return _requests(docs, bits).groupBy("range").applyInArrow(answer, "block long, keys binary, totals binary")


def walk(tokens: np.ndarray, bounds: np.ndarray, keys: np.ndarray, totals: np.ndarray, n: int, v: int, weight: float) -> dict[str, np.ndarray]:
    """Sums over each text of the arcs taken from left to right; the state of a token is the token before it."""
    pairs = _pairs(tokens, bounds)
    word = totals[np.searchsorted(keys, tokens)]
    seen = totals[np.searchsorted(keys, pairs)]
    begins = totals[np.searchsorted(keys, END)]  # each training text begins once, as it ends once
    context = np.append(0, word[:-1])
    context[bounds[:-1]] = begins
    empty = (word + 1) / (n + v + 1)
    fails = np.log10(weight / (context + weight)) + np.log10(empty)
    arcs = np.where(seen > 0, np.log10((seen + weight * empty) / (context + weight)), fails)
    at = bounds[:-1]
    return {
        "n_tokens": np.diff(bounds), "n_known": np.add.reduceat((word > 0).astype(np.int64), at),
        "base_score": np.add.reduceat(np.log10(empty), at), "score": np.add.reduceat(arcs, at),
    }


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, block: Column | None = None, model: Backoff = Backoff()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text, ...).

    Texts with crc32(doc_id as text) mod 7 = 2 are held out, all others train (a null id counts as empty text and trains).
    Tokens are the words, A-Z lower-cased, and one end, so a null, empty or blank text has one token. Without training
    texts all counts are 0. Repeated rows count as often as they occur. ``block`` must be the same in every scan of
    ``docs`` and should gather a few thousand neighbouring rows.
    """
    ident = F.col("doc_id").cast("long")
    held_out = F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    blocks = F.pmod(F.xxhash64("doc_id"), F.lit(64)) if block is None else block
    rows = docs.select(blocks.alias("block"), ident.alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // BYTES_PER_TOKEN // RANGE_TOKENS).bit_length())
    n, v = vocabulary(rows, bits)
    answers = _answers(rows, bits)

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        parts = [(b, *_tokens(b.column("text"))) for b in small_batches(iter(texts.combine_chunks().to_batches()))]
        if not parts:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        seen, asked = [], []
        for batch, tokens, bounds in parts:
            held = _held(batch, bounds)
            for keys in (tokens, _pairs(tokens, bounds)):
                seen.append(keys[~held])
                asked.append(keys[held])
        keys, totals = _counted(seen, [*asked, np.array([END])])
        del seen, asked
        for packed, sums in zip(found.column("keys"), found.column("totals"), strict=True):
            totals[np.searchsorted(keys, _unpack(packed.as_py()))] = _values(sums.as_py())
        for batch, tokens, bounds in parts:
            scores = walk(tokens, bounds, keys, totals, n, v, model.weight)
            out.append(pa.table({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(scores["n_tokens"]), "n_known": pa.array(scores["n_known"]),
                "train_tokens": pa.array(np.full(batch.num_rows, n, dtype=np.int64)),
                "base_score": pa.array(scores["base_score"]), "score": pa.array(scores["score"]),
            }))
        return pa.concat_tables(out)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
