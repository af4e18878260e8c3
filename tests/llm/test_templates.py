"""Template tokens by chunk of a host: only those that may reach the support are sent, and no count is an estimate."""

import pytest
from pyspark.sql import functions as F

from patronage.llm import html_extract
from patronage.llm.html_extract import page_tokens, templates, token


def page(i):
    rare = " ".join(f"own{i}x{k}" for k in range(200))
    often = "<div class=z>now and then</div>" if i % 10 < 6 else ""
    return f"<body><div class=x>Our site is best</div><p>{rare}</p>{often}<div class=y>all rights reserved</div></body>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("a.org", page(i)) for i in range(40)] + [("a.org", page(0))] * 3 + [("b.org", page(i)) for i in range(2)] + [("", "")]
    return spark.createDataFrame(rows, "host string, html string").withColumn("page", F.xxhash64("html"))


def test_only_tokens_near_the_support_are_sent(pages):
    sent = page_tokens(pages.withColumns({"chunk": F.lit(0), "chunks": F.lit(1)}), 0.25, 0.5, 3).collect()
    assert len(sent) < 30 and {r["host"] for r in sent} == {"a.org"}
    own = {r["token"] & (1 << 64) - 1: r for r in sent}
    site = own[token(">body>div.x", "site")]
    assert (site["n"], site["least"], site["most"], site["seen"]) == (40, 1, 1, 40)


@pytest.mark.parametrize("chars", [100, 4000, 20000])
def test_chunks_do_not_change_the_template(pages, monkeypatch, chars):
    def found(**size):
        return {r["host"]: (sorted(r["slots"]), sorted(r["words"])) for r in templates(pages, **size).collect()}

    whole = found()
    words = {w & (1 << 64) - 1 for w in whole["a.org"][1]}
    assert {token(">body>div.z", w) for w in ("now", "and", "then")} <= words and len(words) == 10
    monkeypatch.setattr(html_extract, "PENDING_TOKENS", 50)
    assert found(chunk_chars=chars) == whole
