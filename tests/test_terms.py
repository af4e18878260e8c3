import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from patronage.functions.text import clean_redacted
from patronage.operators import tfidf
from patronage.plans import complaint_text


def test_tfidf_counts_terms_without_a_row_an_occurrence(spark, rows):
    texts = [(1, "aa bb aa cc q the bb"), (1, "aa bb"), (2, ""), (2, None), (None, "bb the cc  dd"), (3, "the q"), (4, "dd aa")]
    docs = spark.createDataFrame(texts, "id long, clean_text string")
    found = tfidf.tfidf(docs, "id", stop_words=["the"], min_df=1, max_df=1.0, max_features=100)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()

    def terms(text):
        kept = [w for w in (text or "").split(" ") if len(w) >= 2 and w != "the"]
        return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]

    df, tf = Counter(t for _, text in texts for t in set(terms(text))), Counter((k, t) for k, text in texts for t in terms(text))
    raw = {(k, t): n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for (k, t), n in tf.items()}
    norm = Counter()
    for (k, _), w in raw.items():
        norm[k] += w * w
    assert {(r["id"], r["term"]): r["weight"] for r in rows(found)} == pytest.approx({kt: w / math.sqrt(norm[kt[0]]) for kt, w in raw.items()})
    few = tfidf.tfidf(docs, "id", stop_words=["the"], min_df=2, max_df=0.5, max_features=2)
    assert {r["term"] for r in rows(few)} == {"aa", "bb"}
    assert rows(tfidf.tfidf(docs, "id", min_df=50)) == []


def test_topics_of_one_row_group_are_read_by_several_tasks(spark, tmp_path):
    """A file with one row group is scanned by one task; the texts are dealt out before they are cleaned."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwyzabcde'[i // 100]}" for i in range(1000)])
    texts = [" ".join(words[rng.integers(0, 1000, 2000)]) for _ in range(2000)]
    table = pa.table({"doc_id": range(2000), "lang": ["en"] * 2000, "source": ["a"] * 2000, "text": texts, "n_chars": [len(t) for t in texts]})
    pq.write_table(table, tmp_path / "documents.parquet", row_group_size=10_000)
    stored = complaint_text.build_redacted(spark, str(tmp_path))
    assert stored.count() == 2000
    assert sum(n > 0 for n in stored.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()) > 1


def test_patterns_are_tried_where_their_signs_are(spark, rows):
    texts = ["see HTTPS://x.y/z now", "wwwhat is this", "mail A@b.c, ok", "XXXX paid xx/xx", "plain", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", clean_redacted("t").alias("c"))
    assert [r["c"] for r in rows(df, "i")] == ["see now", "is this", "mail ok", "paid", "plain", "", ""]
