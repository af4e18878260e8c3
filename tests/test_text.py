import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patronage.functions import text
from patronage.functions.fixed_values import NEGATIVE_WORDS, POSITIVE_WORDS
from patronage.operators import complaints as cx, tfidf


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "raw, plain, redacted",
    [
        ("Fraud! See http://x.y/z?a=1 or www.bank.com now", "fraud see or now", "fraud see or now"),
        ("mail me.you@bank.co.uk   TODAY\n\tplease", "mail today please", "mail today please"),
        ("On XX/XX/XXXX I paid XXXX xylophone", "on xx xx xxxx i paid xxxx xylophone", "on i paid xylophone"),
        ("Größe 42 café", "gr e caf", "gr e caf"),
        (None, "", ""),
        ("  12 34 ", "", ""),
    ],
)
def test_cleaning(spark, raw, plain, redacted):
    assert one(spark, raw, text.clean_text) == plain
    assert one(spark, raw, text.clean_redacted) == redacted


def test_tokens_and_words(spark):
    assert one(spark, "I am not at the bank, XXXX", text.tokens) == ["not", "the", "bank"]
    assert one(spark, "", text.words) == []
    assert one(spark, " Bad,  FRAUD. fraud\n", text.raw_words) == ["bad,", "fraud.", "fraud"]
    assert one(spark, "a b c", lambda c: text.ngrams_1_2(text.words(c))) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", lambda c: text.ngrams_1_2(text.words(c))) == ["a"]
    assert one(spark, "", lambda c: text.ngrams_1_2(text.words(c))) == []


def complaints(spark, *texts):
    rows = [(i, "card", None if i == 0 else "web", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "complaint_id long, product string, submitted_via string, complaint_what_happened string")


def test_two_sentiments_differ_on_punctuation(spark, rows):
    df = complaints(spark, "Fraud. Fraud! thanks", "great good wrong", "nothing here", "   ")
    scored = cx.with_sentiment(cx.with_clean_text(df))
    assert [(r["sentiment_score"], r["sentiment"]) for r in rows(scored, "complaint_id")] == [
        (-1, "Negative"), (1, "Positive"), (0, "Neutral"),
    ]
    raw = [r["sentiment"] for r in rows(cx.with_raw_sentiment(df), "complaint_id")]
    assert raw == ["Positive", "Positive", "Neutral", "Neutral"]
    assert len(POSITIVE_WORDS) == 14 and len(NEGATIVE_WORDS) == 30
    by_channel = rows(cx.sentiment_by(scored, "submitted_via"), "submitted_via")
    assert [(r["submitted_via"], r["complaints"], r["negative_rate"]) for r in by_channel] == [(None, 1, 100.0), ("web", 2, 0.0)]


def test_text_statistics(spark, rows):
    df = cx.with_clean_text(complaints(spark, "one two three", "one", "a b"))
    got = {r["metric"]: r for r in rows(cx.text_statistics(df))}
    assert got["word_count"]["mean"] == 2.0 and got["word_count"]["median"] == 2.0 and got["text_length"]["max"] == 13.0


def brute_tfidf(docs, stop, min_df, max_df, max_features, sublinear):
    terms = []
    for d in docs:
        ws = [w for w in d.split() if len(w) >= 2 and w not in stop]
        terms.append(Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]))
    n = len(docs)
    df = Counter(t for c in terms for t in c)
    total = Counter()
    for c in terms:
        total.update(c)
    vocab = sorted((t for t in df if min_df <= df[t] <= max_df * n), key=lambda t: (-total[t], t))[:max_features]
    out = {}
    for i, c in enumerate(terms):
        w = {t: ((1 + math.log(c[t])) if sublinear else c[t]) * (math.log((1 + n) / (1 + df[t])) + 1) for t in vocab if t in c}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return out


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_against_brute_force(spark, sublinear):
    import random

    rng = random.Random(7)
    vocabulary = ["account", "bank", "card", "debt", "fee", "the", "late", "x", "loan", "paid"]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, clean_text string")
    options = {"min_df": 3, "max_df": 0.8, "max_features": 25}
    got = tfidf.tfidf(df, "id", stop_words=["the"], sublinear=sublinear, **options).collect()
    want = brute_tfidf(docs, {"the"}, options["min_df"], options["max_df"], options["max_features"], sublinear)
    assert {(r["id"], r["term"]) for r in got} == set(want)
    assert all(r["weight"] == pytest.approx(want[(r["id"], r["term"])], rel=1e-12) for r in got)
    top = tfidf.corpus_terms(df, "id", 5, stop_words=["the"], sublinear=sublinear, **options).collect()
    sums = Counter()
    for (_, t), v in want.items():
        sums[t] += v / len(docs)
    assert [r["term"] for r in top] == [t for t, _ in sorted(sums.items(), key=lambda p: (-round(p[1], 9), p[0]))[:5]]


def test_negative_terms_need_ten_documents(spark):
    df = complaints(spark, *["fraud account closed"] * 9)
    scored = cx.with_sentiment(cx.with_clean_text(df))
    assert tfidf.negative_terms(scored, "complaint_id", min_df=1, max_df=1.0).count() == 0
    ten = cx.with_sentiment(cx.with_clean_text(complaints(spark, *["fraud account closed"] * 10)))
    assert tfidf.negative_terms(ten, "complaint_id", min_df=1, max_df=1.0).count() == 5


def test_default_stop_words():
    assert "the" in tfidf.english_stop_words()


def test_prepare_complaints(spark, rows):
    df = spark.createDataFrame(
        [("2", "b", " "), ("1", "x", "first"), ("1", "y", "second"), ("3", "c", None), ("4", "d", "fourth")],
        "`Complaint ID` string, Product string, `Consumer complaint narrative` string",
    )
    got = rows(cx.prepare_complaints(df, ["Product"]), "complaint_id")
    assert [(r["complaint_id"], r["product"], r["complaint_what_happened"]) for r in got] == [("1", "x", "first"), ("4", "d", "fourth")]
    assert cx.prepare_complaints(df, ["Product"], limit=1).collect()[0]["complaint_id"] == "4"
    with pytest.raises(ValueError, match="narrative"):
        cx.prepare_complaints(df.drop("Consumer complaint narrative"), ["Product"])


def test_channel_sample_is_exact_per_channel(spark, rows):
    data = [(i, "hot" if i % 3 else ("cold" if i % 2 else None), "text") for i in range(300)]
    df = spark.createDataFrame(data, "complaint_id long, submitted_via string, complaint_what_happened string")
    got = rows(cx.channel_sample(df, "submitted_via", ["complaint_id"], 60), "complaint_id")
    for channel in ("hot", "cold"):
        want = [i for i, c, _ in data if c == channel][:60]
        assert sorted(r["complaint_id"] for r in got if r["submitted_via"] == channel) == want
    counts = {r["submitted_via"]: r["complaints"] for r in rows(cx.channel_counts(df, "submitted_via"))}
    assert counts == {"hot": 200, "cold": 50, "Unknown": 50}


def test_classifier_runs_on_whole_texts_and_keeps_every_row(spark, rows):
    seen_sizes = spark.sparkContext.accumulator(0)

    def load():
        def predict(batch):
            assert len(batch) <= 3
            seen_sizes.add(len(batch))
            return [("POSITIVE" if "good" in t else "NEGATIVE" if "bad" in t else "MIXED", 0.5 + len(t) / 10_000) for t in batch]

        return predict

    df = complaints(spark, "x" * 2000 + " good", "bad", "so so", "  ")
    found = cx.classify_texts(df, cx.Predictor("words 1", load), ["complaint_id", "product", "absent"], batch_size=3)
    got = rows(found, "complaint_id")
    assert [(r["sentiment"], r["predicted_label"]) for r in got] == [("Positive", "POSITIVE"), ("Negative", "NEGATIVE"), ("Neutral", "MIXED")]
    assert seen_sizes.value == 3
    limited = cx.classify_texts(df, cx.Predictor("words 2", load), ["complaint_id"], 3, limit=2, order=["complaint_id"], max_chars=800)
    assert sorted(r["sentiment"] for r in limited.collect()) == ["Negative", "Neutral"]
    assert cx.classify_texts(df.limit(0), cx.Predictor("words 1", load), ["complaint_id"]).count() == 0


def test_classifier_is_loaded_once_for_each_worker(spark, tmp_path):
    import os
    import uuid

    from pyspark import cloudpickle

    weights = tmp_path / "weights.bin"
    weights.write_bytes(os.urandom(5_000_000))
    loads, uses, model = str(tmp_path / "loads"), str(tmp_path / "uses"), str(weights)
    for folder in (loads, uses):
        os.mkdir(folder)

    def load():
        content = open(model, "rb").read()
        open(f"{loads}/{uuid.uuid4().hex}-{os.getpid()}", "w").close()

        def predict(batch):
            open(f"{uses}/{os.getpid()}", "w").close()
            return [("POSITIVE", content[0] / 255.0)] * len(batch)

        return predict

    predictor = cx.Predictor("weights", load)
    assert len(cloudpickle.dumps(predictor)) < 5_000  # the model stays out of the tasks
    df = spark.range(400).selectExpr("id AS complaint_id", "'some text' AS complaint_what_happened").repartition(40)
    for _ in range(2):
        assert cx.classify_texts(df, predictor, ["complaint_id"]).where("sentiment = 'Positive'").count() == 400
    loaded = [f.split("-")[1] for f in os.listdir(loads)]
    assert len(loaded) == len(set(loaded)) and set(loaded) == set(os.listdir(uses)) and len(loaded) <= 8
