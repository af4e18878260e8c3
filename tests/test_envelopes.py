"""Envelope files cut into byte ranges against the whole-file reader."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from patronage.sources import envelopes
from patronage.sources.envelopes import read_large_hits, summary
from patronage.sources.readers import read_hits

TRICKY = ['"', "\\", '\\"', "}{", "][", '"hits": [', "{", "é日", "\n", '\\\\"', "", "x" * 300]


def reply(n=60, indent=None, before=True):
    hits = []
    for i in range(n):
        record = {"complaint_id": str(i), "product": TRICKY[i % len(TRICKY)], "complaint_what_happened": TRICKY[(i * 5) % len(TRICKY)] * (i % 4), "more": {"deep": [{"hits": [1, {"a": "]"}]}]}}
        hits.append({"_source": record, "_id": TRICKY[i % 7]} if i % 2 else record)
    other = {"took": 3, "parts": [{"hits": [{"complaint_id": "no"}]}], "text": '"hits": [{'}
    return json.dumps({**(other if before else {}), "hits": hits, "last": [{"complaint_id": "no"}]}, indent=indent, ensure_ascii=False)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_equal_the_whole_file(spark, tmp_path, monkeypatch, size, indent):
    monkeypatch.setattr(envelopes, "MORE_BYTES", 16)
    path = tmp_path / "reply.json"
    n = 6 if size == 7 else 60
    path.write_text(reply(n, indent), encoding="utf-8")
    found = read_large_hits(spark, str(path), range_bytes=size if size > 7 else 97)
    assert rows(found) == rows(read_hits(spark, str(path))) and found.count() == n


def test_many_tasks_read_one_file(spark, tmp_path):
    path = tmp_path / "reply.json"
    path.write_text(reply(400, None), encoding="utf-8")
    found = read_large_hits(spark, str(path), range_bytes=path.stat().st_size // 8 + 1)
    assert found.rdd.getNumPartitions() >= 8
    assert found.count() == 400


def test_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(reply(20 + i, before=bool(i)), encoding="utf-8")
    paths = [str(tmp_path / f"{i}.json") for i in range(3)]
    assert rows(read_large_hits(spark, paths, range_bytes=700)) == rows(read_hits(spark, paths))


def test_other_envelopes(spark, tmp_path):
    for text in ('{"hits": []}', '{"took": 1}', "", '{"hits": [ ] , "x": [1]}'):
        path = tmp_path / "reply.json"
        path.write_text(text)
        assert read_large_hits(spark, str(path)).count() == 0
    path.write_text('{"hits": [{"complaint_id": "1"}, {"complaint_id": "2"')
    with pytest.raises(Exception):
        read_large_hits(spark, str(path)).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(['"', "\\\\", '\\"', "{", "}", "[", "]", "a", ":"]), max_size=40), st.integers(0, 60))
def test_summaries_add_up(parts, cut):
    text = "".join(parts).encode()
    cut = min(cut, len(text))
    while 0 < cut < len(text) and text[cut - 1:cut] == b"\\":
        cut += 1
    whole, left, right = summary(text), summary(text[:cut]), summary(text[cut:])
    inside = left[0] % 2
    assert whole[0] == left[0] + right[0] and whole[1] == left[1] + right[1 + inside] and whole[2] == left[2] + right[2 - inside]
