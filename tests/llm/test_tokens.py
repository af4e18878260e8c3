"""Token counts and cross-tokenizer alignment against the tokenizers' own libraries and brute force."""

import collections

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from patronage.llm import token_counts
from patronage.llm.token_counts import append_missing, count_documents, encode_texts, stored_counts
from patronage.llm.tokens import Encoder, Vocabulary, count_tokens

SCHEMA = "doc_id long, text string, digest string, n_tokens string, version int, n_bytes int"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
TEXTS = [
    None, "", " ", "  ", "one", " one", "one ", "a b", "a  b", "a \n b", "tab\tand more", "it's  don't 's", "<|endoftext|>", "x <|endoftext|> y",
    "a<|endoftext|>b c", "<s> </s> <unk> <0x41>", "café über naïve", "日本語 の 文", "\U0001f600 \U0001f600", "a b a　 b", "▁x y▁ z",
    "nul \x00 in", "\x1c x \x1f", "é à", "long " * 3000, "w" * 70000, "è re" * 500, "same", "same", "Same", "1 22 333  4444", "\r\n a \r\n", "​ ﻿x   y",
]
ROWS = [(i, t, "clash", "clash", 1, 2) for i, t in enumerate(TEXTS)] + [(3, "other text of id 3", None, None, None, None)] + [(None, "no id", None, None, None, None)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def vocabulary(name, plain=False):
    return Vocabulary.read(public_tokenizers.path(name), plain)


def library(name, plain=False):
    """Ids of whole texts, by the library itself."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(public_tokenizers.path(name))
        model.encode_special_tokens = plain
        return lambda text: model.encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("plain", [False, True])
def test_counts_equal_the_library(name, plain):
    ids = library(name, plain)
    texts = [t or "" for t in TEXTS]
    assert count_tokens(pa.array(texts, pa.large_string()), vocabulary(name, plain)).tolist() == [len(ids(t)) for t in texts]


ALPHABET = st.sampled_from(list(" \t\n  ab'.1é日<|>▁\x00") + ["the", "'s", "<|endoftext|>", "<s>", "  "])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=6))
def test_cut_words_equal_whole_texts(texts):
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        ids = library(name)
        assert vocabulary_of(name).cuts
        assert count_tokens(pa.array(texts, pa.large_string()), vocabulary_of(name)).tolist() == [len(ids(t)) for t in texts]


_READ = {}


def vocabulary_of(name):
    return _READ.setdefault(name, vocabulary(name))


def test_only_provable_tokenizers_are_cut():
    assert [vocabulary(n).cuts for n in FILES] == [True, False, True]
    assert len({vocabulary("byte_bpe_50k.json", p).version for p in (True, False)}) == 2


def test_kept_words_are_bounded(monkeypatch):
    from patronage.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    encoder, ids = Encoder(vocabulary_of("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    for start in range(0, 400, 40):
        words = [f" w{i}".encode() for i in range(start, start + 60)] + [b" again", b" " + b"z" * 500]
        found, bounds = encoder.ids(words)
        assert [found[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ids(w.decode()) for w in words]
    assert len(encoder.kept) + len(encoder.older) <= 2 * (50 + 62)


def expected(name):
    ids = library(name)
    return collections.Counter((r[0], len((r[1] or "").encode()), len(ids(r[1] or ""))) for r in ROWS)


@pytest.mark.parametrize("name", FILES)
def test_count_documents(docs, tmp_path, name):
    found = count_documents(docs, vocabulary_of(name), str(tmp_path))
    assert collections.Counter(map(tuple, found.select("doc_id", "n_bytes", "n_tokens").collect())) == expected(name)


@pytest.mark.parametrize("few", [0, 50_000])
def test_only_distinct_misses_are_encoded(spark, docs, tmp_path, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    voc, cache, encoded = vocabulary_of("byte_bpe_50k.json"), str(tmp_path), []

    def counted(texts, v):
        texts = texts.persist()
        encoded.append(sorted(r[0] for r in texts.select("text").collect()))
        return encode_texts(texts, v)

    monkeypatch.setattr(token_counts, "encode_texts", counted)
    half = docs.where("doc_id % 2 = 0")
    count_documents(half, voc, cache).collect()
    count_documents(docs, voc, cache).collect()
    assert collections.Counter(map(tuple, count_documents(docs, voc, cache).collect())) == expected("byte_bpe_50k.json")
    first = {r[1] or "" for r in ROWS if r[0] is not None and r[0] % 2 == 0}
    assert encoded == [sorted(first), sorted({r[1] or "" for r in ROWS} - first)]  # and nothing the third time


def test_stored_counts_are_used_and_told_apart_by_version(spark, docs, tmp_path):
    voc, other = vocabulary_of("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.json", True)
    count_documents(docs, voc, str(tmp_path)).collect()
    # a second writer that stored the same entries again
    stored = spark.read.schema(token_counts.ENTRY).parquet(f"{tmp_path}/version={voc.version}")
    rows = stored.collect()
    spark.createDataFrame(rows, token_counts.ENTRY).write.mode("append").parquet(f"{tmp_path}/version={voc.version}")
    assert stored_counts(spark, str(tmp_path), voc).count() == len(rows)
    assert collections.Counter(map(tuple, count_documents(docs, voc, str(tmp_path)).collect())) == expected("byte_bpe_50k.json")
    # a stored count is believed: it is what the cache is for
    spark.createDataFrame([(r["digest"], 777) for r in rows], token_counts.ENTRY).write.mode("overwrite").parquet(f"{tmp_path}/version={voc.version}")
    assert {r["n_tokens"] for r in count_documents(docs, voc, str(tmp_path)).collect()} == {777}
    assert 777 not in {r["n_tokens"] for r in count_documents(docs, other, str(tmp_path)).collect()}


def test_hot_digest_and_empty_table(spark, tmp_path):
    voc = vocabulary_of("byte_bpe_50k.json")
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a hot text' ELSE concat('text ', id) END AS text")
    found = count_documents(rows, voc, str(tmp_path / "a")).collect()
    ids = library("byte_bpe_50k.json")
    assert len(found) == 6000
    assert all(r["n_tokens"] == len(ids("a hot text" if r["doc_id"] % 3 == 0 else f"text {r['doc_id']}")) for r in found)
    nothing = spark.createDataFrame([], SCHEMA)
    assert count_documents(nothing, voc, str(tmp_path / "b")).count() == 0
    append_missing(nothing, stored_counts(spark, str(tmp_path / "b"), voc), voc, str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def token_bytes(name):
    encoder = Encoder(vocabulary(name, True))
    if name.endswith(".json"):
        # byte-level entries: what the library's own decoder makes of the characters is not bytes, so the map is spelled out
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        return lambda i: bytes(byte[c] for c in encoder.model.id_to_token(i))
    return lambda i: bytes([int(encoder.model.id_to_piece(i)[3:5], 16)]) if encoder.model.is_byte(i) else encoder.model.id_to_piece(i).replace("▁", " ").encode()


def brute_alignment(rows):
    """Contract columns by comparing every token of A with every token of B."""
    import hashlib

    ids, spelled, found = {n: library(n, True) for n in (A, B)}, {n: token_bytes(n) for n in (A, B)}, []
    for ident, text in rows:
        a, b = ids[A](" " + (text or "")), ids[B](text or "")
        parts = [[spelled[n](i) for i in x] for n, x in ((A, a), (B, b))]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            found.append((ident, [], [], [], []))
            continue
        spans = []
        for p in parts:
            ends = [sum(map(len, p[:k + 1])) for k in range(len(p))]
            spans.append([(e - len(t), e) for e, t in zip(ends, p, strict=True)])
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[i for i, (_, e) in zip(x, s, strict=True) if lo < e <= hi] for x, s in ((a, spans[0]), (b, spans[1]))] for lo, hi in zip([0, *common], common, strict=False)]
        links = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        found.append((ident, a, b, groups, links))
    counts = collections.Counter(link for f in found for link in f[4])
    best = collections.defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    for ident, a, b, groups, links in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            ident, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(written.encode()).hexdigest() if a else "",
        )


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("size", [1, 300, 16 << 20])
def test_alignment_against_brute_force(spark, monkeypatch, size):
    from patronage.llm import token_align

    monkeypatch.setattr(token_align, "BLOCK_BYTES", size)
    monkeypatch.setattr(token_align, "ALIGNED_BYTES", max(1, size // 4))
    rows = [(r[0], r[1][:600] if r[1] else r[1]) for r in ROWS] + [(100 + i, "antidisestablishmentarianism " * i + "größenwahn, naïveté \n\n\tx") for i in range(9)]
    docs = spark.createDataFrame([(i, t, "clash", 7, "clash") for i, t in rows], "doc_id long, text string, n_a string, block int, step string")
    found = token_align.align_documents(docs.repartition(3), vocabulary(A, True), vocabulary(B, True))
    assert found.columns == ALIGNED
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute_alignment(rows))


def test_alignment_of_nothing(spark):
    from patronage.llm.token_align import align_documents

    voc = vocabulary(A, True), vocabulary(B, True)
    assert align_documents(spark.createDataFrame([], "doc_id long, text string"), *voc).count() == 0
    empty = align_documents(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), *voc).collect()
    assert sorted(map(tuple, empty)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 400), max_size=300), st.sets(st.integers(1, 400), max_size=300)), min_size=1, max_size=4))
def test_galloping_ranks(lists):
    import numpy as np

    from patronage.llm.token_align import ranks

    needles = np.array([x for s, _ in lists for x in sorted(s)], dtype=np.int64)
    hay = np.array([x for _, s in lists for x in sorted(s)], dtype=np.int64)
    bounds, places = (np.cumsum([0, *[len(p[k]) for p in lists]]) for k in (0, 1))
    expected = [places[k] + sum(y < x for y in s[1]) for k, s in enumerate(lists) for x in sorted(s[0])]
    assert ranks(needles, bounds, hay, places[:-1], places[1:]).tolist() == expected
