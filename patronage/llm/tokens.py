"""Public tokenizers on executors: the file's bytes travel, words that a tokenizer treats apart are encoded once.

A text may be cut at a space between two other characters where its tokenizer provably never joins or looks across one:
byte-level BPE under its own pattern, where a space begins a token with what follows it, and BPE pieces whose space
marks stand first. ``Vocabulary`` reads that from the file; for all other tokenizers a text is one word.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose tokens a Python worker keeps; it forgets all of them when it has more.
KEPT_WORDS = 200_000
#: Longer words are encoded each time.
KEPT_BYTES = 64
#: New words that are encoded in one call.
JOINED = 1024
#: The mark that stands for a space in pieces.
MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file and how to read it. ``plain`` takes special strings inside texts for ordinary text.

    ``version`` is a digest of the file, its library's release and ``plain``: what may change a text's tokens.
    """

    content: bytes
    library: str
    plain: bool
    version: str
    cuts: bool

    @staticmethod
    def read(path: str, plain: bool = False) -> Vocabulary:
        content, library = Path(path).read_bytes(), "tokenizers" if path.endswith(".json") else "sentencepiece"
        release = importlib.import_module(library).__version__
        version = hashlib.sha256(f"{library} {release} {plain} ".encode() + content).hexdigest()
        cuts = _json_cuts(content) if library == "tokenizers" else _piece_cuts(content)
        return Vocabulary(content, library, plain, version, cuts)

    def encoder(self) -> Encoder:
        """The tokenizer, loaded once for each Python worker."""
        if self.version not in _LOADED:
            _LOADED[self.version] = Encoder(self)
        return _LOADED[self.version]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level entries: itself if it is printable and no space, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    code = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(code[b]) for b in range(256)]


def _json_cuts(content: bytes) -> bool:
    """Whether byte-level BPE with its own pattern and nothing before it, and no added token with a space or an eye on one."""
    spec = json.loads(content)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel" and bool(split.get("use_regex", True)) and not split.get("add_prefix_space", True)
        and model.get("type") == "BPE" and not model.get("dropout")
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protobuf message, but for its repeated pieces (field 1 at the top)."""
    at, found = 0, {}

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            found[key >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            found[key >> 3] = message[at:at + size]
            at += size
    return found


def _piece_cuts(content: bytes) -> bool:
    """Whether BPE over unchanged text with a space put first, and no piece has a space mark after another character."""
    from sentencepiece import SentencePieceProcessor

    model = _fields(content)
    trainer, normalizer = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    pieces = SentencePieceProcessor(model_proto=content)
    return (
        trainer.get(3, 1) == 2  # BPE
        and not trainer.get(24, 0)  # space marks stand first
        and not normalizer.get(2)  # no table of replaced characters
        and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        and not any(MARK in pieces.id_to_piece(i).lstrip(MARK) for i in range(pieces.get_piece_size()))
    )


class Encoder:
    """Token ids of words; see ``Vocabulary.encoder``.

    New words that may stand side by side are encoded as one text and told apart by the bytes of their tokens, which
    saves a call for each. The tokens of frequent words are kept: of two generations, the older is forgotten when the
    newer has ``KEPT_WORDS`` words.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.cuts, self.pieces = vocabulary.cuts, vocabulary.library == "sentencepiece"
        if self.pieces:
            from sentencepiece import SentencePieceProcessor

            self.model = SentencePieceProcessor(model_proto=vocabulary.content)
            self.entries = [self._piece_bytes(i) for i in range(self.model.get_piece_size())]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_buffer(vocabulary.content)
            self.model.encode_special_tokens = vocabulary.plain
            self.model.no_truncation()
            self.model.no_padding()
            byte = {char: bytes([b]) for b, char in enumerate(byte_characters())}
            added = {i: t.content.encode() for i, t in self.model.get_added_tokens_decoder().items()}
            size = max([*self.model.get_vocab(True).values(), -1]) + 1
            entries = [self.model.id_to_token(i) or "" for i in range(size)]
            self.entries = [added[i] if i in added else b"".join(byte.get(c, c.encode()) for c in e) for i, e in enumerate(entries)]
        #: Bytes of each token of a vocabulary whose texts can be cut.
        self.lengths = np.array([len(e) for e in self.entries], dtype=np.int64)
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode()

    def tokens(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of whole texts, as the library gives them; for pieces each text comes with the space that they put first."""
        strings = [t.decode("utf-8", "replace") for t in texts]
        if self.pieces:
            return self.model.encode([t[1:] for t in strings], num_threads=1)
        return [e.ids for e in self.model.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed. Pieces put a space first themselves, so their words come with it and lose it here."""
        joined, alone, out = [], [], {}
        for w in words:
            (joined if self.cuts and len(w) > 1 and w[0] == 32 and not _SPACE_LAST[w[-1]] and not _SPACE_FIRST[w[1]] else alone).append(w)
        for start in range(0, len(joined), JOINED):
            part = joined[start:start + JOINED]
            ids = np.array(self.tokens([b"".join(part)])[0], dtype=np.uint32)
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(w) for w in part])
            places = np.searchsorted(ends, wanted, side="right")
            if len(ends) and ends[-1] == wanted[-1] and (ends[places - 1] == wanted).all():
                at, packed = [0, *(places * 4).tolist()], ids.tobytes()
                out.update((w, packed[i:j]) for w, i, j in zip(part, at, at[1:], strict=False))
            else:  # a character that the vocabulary cannot give back
                alone += part
        for start in range(0, len(alone), JOINED):
            part = alone[start:start + JOINED]
            out.update((w, np.array(ids, dtype=np.uint32).tobytes()) for w, ids in zip(part, self.tokens(part), strict=True))
        return [out[w] for w in words]

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and where those of each word begin (one more entry than words)."""
        kept, older = self.kept, self.older
        packed = [kept.get(w) for w in words]
        new = []
        for i, p in enumerate(packed):
            if p is None:
                if (p := older.get(words[i])) is None:
                    new.append(i)
                else:
                    packed[i] = kept[words[i]] = p
        for i, p in zip(new, self._encode([words[i] for i in new]), strict=True):
            packed[i] = p
            if len(words[i]) <= KEPT_BYTES:
                kept[words[i]] = p
        if len(kept) > KEPT_WORDS:
            self.kept, self.older = {}, kept
        bounds = np.cumsum([0, *map(len, packed)]) // 4
        return np.frombuffer(b"".join(packed), dtype=np.uint32).astype(np.int64), bounds


_LOADED: dict[str, Encoder] = {}

#: First and last bytes of all white space beyond ASCII. A cut beside any of them is left out, whatever the character.
_SPACE_FIRST, _SPACE_LAST = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
for _code in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _SPACE_FIRST[chr(_code).encode()[0]] = _SPACE_LAST[chr(_code).encode()[-1]] = True
_SPACE_FIRST[:33] = _SPACE_LAST[:33] = True


@dataclass(frozen=True)
class Words:
    """The distinct words of some texts: ``place`` holds the word of each occurrence in order, ``bounds`` where each text begins."""

    distinct: list[bytes]
    place: np.ndarray
    bounds: np.ndarray


def cut_words(texts: pa.LargeStringArray, cuts: bool) -> Words:
    """Words of texts; each but a text's first begins with the space at which it was cut. An empty text has none."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset:]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    edges = offsets - offsets[0]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[edges] = True
    if cuts:
        space = np.flatnonzero(data == 32)
        # a space at the edge of a text has no neighbour in it
        space = space[~cut[space] & ~cut[space + 1]]
        cut[space[~_SPACE_LAST[data[space - 1]] & ~_SPACE_FIRST[data[space + 1]]]] = True
    starts = np.flatnonzero(cut[:-1])
    if not len(starts):
        return Words([], np.zeros(0, dtype=np.int64), np.zeros(len(edges), dtype=np.int64))
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(data)])
    coded = (words.cast(pa.binary()) if len(data) < 1 << 31 else words).dictionary_encode()
    entries = coded.dictionary.cast(pa.large_binary())
    at, raw = np.frombuffer(entries.buffers()[1], dtype=np.int64, count=len(entries) + 1).tolist(), entries.buffers()[2].to_pybytes()
    distinct = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
    return Words(distinct, coded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, edges))


def ragged(bounds: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of the lists ``place`` lie, list after list, and where each list begins among them."""
    sizes = np.diff(bounds)[place]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(begin[-1]) + np.repeat(bounds[:-1][place] - begin[:-1], sizes), begin


def spaced(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """Each text with a space put first."""
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))


def count_tokens(texts: pa.LargeStringArray, vocabulary: Vocabulary) -> np.ndarray:
    """The number of tokens of each text."""
    encoder = vocabulary.encoder()
    words = cut_words(spaced(texts) if encoder.pieces else texts, vocabulary.cuts)
    _, bounds = encoder.ids(words.distinct)
    return np.diff(np.concatenate(([0], np.cumsum(np.diff(bounds)[words.place])))[words.bounds])
