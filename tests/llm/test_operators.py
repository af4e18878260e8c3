"""Each text operator against brute force, on small tables with nulls, empty texts, ties, repeats and foreign columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from patronage.llm.decontaminate import contained_items, without_items
from patronage.llm.exact_dedup import Layout, exact_groups
from patronage.llm.html_extract import blocks, main_text, own_slot, read_page
from patronage.llm.line_dedup import Fuzzy, dedup_lines
from patronage.llm.linking import parity_marks
from patronage.llm.lm_score import score_documents
from patronage.llm.mixing import fit, mix_documents, repeat_documents, targets
from patronage.llm.ngram_join import Similarity, keep_one_per_component, ngram_components
from patronage.llm.quality import grade_documents
from patronage.llm.sharding import Feistel, shard_rows
from patronage.llm.url_filter import Rule, judge_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, selected string, part int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [vocabulary[i] for i in rng.integers(0, 400, rng.integers(1, 120))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 3))):
            copy = list(base)
            copy[int(rng.integers(0, len(copy)))] = "changed"
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper())
    texts += [None, None, "", "   ", "one", "One", "two words", "x" * 5000, "line\nline\n\nother line here\nother line her"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, "clash", "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[0], None, None, None, None, None, None), (None, None, "en", "s1", 0, "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode().lower())


def as_bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("layout", [Layout(), Layout(capacity=300, step=2, max_depth=6), Layout(capacity=1, step=1, max_depth=3)])
def test_exact_groups(docs, layout):
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[(r[1] or "").encode().lower()].append(r[0])
    expected = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()] += 1
    assert as_bag(exact_groups(docs, layout), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected


def components_of(size, num):
    sets = []
    for r in corpus():
        w = words(r[1])
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (1, 60)])
def test_ngram_components(docs, size, num):
    sets, roots = components_of(size, num)
    rows = corpus()
    low = {}
    for r, root in zip(rows, roots, strict=True):
        low[root] = min((x for x in (low.get(root), r[0]) if x is not None), default=None)
    expected = collections.Counter((r[0], len(s), low[root] if s else r[0]) for r, s, root in zip(rows, sets, roots, strict=True))
    assert as_bag(ngram_components(docs, Similarity(size, num, 100)), "doc_id", "n_shingles", "component_id") == expected


def test_one_row_of_each_component_stays(docs):
    sets, roots = components_of(5, 80)
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    expected = len({root for root, s in zip(roots, sets, strict=True) if s}) + sum(not s for s in sets)
    assert kept.count() == expected


def test_near_copies_without_links_make_few_pairs(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        copy = list(base)
        for place in rng.choice(200, 6 if i % 2 else 1, replace=False):
            copy[place] = f"n{rng.integers(1 << 40)}"
        rows.append((i, " ".join(copy)))
    found = {r["doc_id"]: r["component_id"] for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), Similarity(3, 90, 100)).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(3)))) for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 90 * len(a | b):
                assert found[i] == found[j]


def test_parity_marks_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 500).astype(np.uint64)
    b = np.concatenate((a[:450], rng.integers(0, 1 << 62, 30).astype(np.uint64)))
    odd = sum(int(x).bit_count() for x in (parity_marks(a) ^ parity_marks(b)).view(np.uint64))
    assert 0 < odd <= 80


def test_scores(docs):
    rows = corpus()
    tokens = [[*words(r[1]), None] for r in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    pairs = collections.Counter(p for t, h in zip(tokens, held, strict=True) if not h for p in zip([None, *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    expected = []
    for r, t, h in zip(rows, tokens, held, strict=True):
        empty = [(c[w] + 1) / (n + v + 1) for w in t]
        arcs = [(pairs[u, w] + 100 * p) / (c[u] + 100) for u, w, p in zip([None, *t], t, empty, strict=False)]
        expected.append((str(r[0]), h, len(t), sum(w in c for w in t), n, float(np.log10(empty).sum()), float(np.log10(arcs).sum())))
    got = [(str(r["doc_id"]), *tuple(r)[1:]) for r in score_documents(docs).collect()]
    for a, b in zip(sorted(expected), sorted(got), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:])


def test_feistel_is_a_permutation_and_turns_back():
    for n in (1, 2, 3, 7, 40, 257, 1000):
        f = Feistel(n, seed=5)
        places = f.place(np.arange(n))
        assert sorted(places.tolist()) == list(range(n))
        assert (f.row(places) == np.arange(n)).all()


def test_shards(docs):
    rows = shard_rows(docs, 7).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    expected = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    assert as_bag(shard_rows(docs.repartition(9), 7), "doc_id", "text_crc32", "shard", "slot") == as_bag(shard_rows(docs, 7), "doc_id", "text_crc32", "shard", "slot")


def test_targets_share_the_excess():
    assert targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    assert targets([10, 100, 100], [100, 2, 1], 3) == pytest.approx([30, 120, 60])
    assert targets([0, 10], [5, 1], 3) == [0.0, 10.0]


def test_fit_reaches_the_nearest_sum():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, rng.integers(1, 5)))
        counts = rng.integers(1, 4, len(sizes))
        sums = {0}
        for s, k in zip(sizes, counts, strict=True):
            sums = {x + s * j for x in sums for j in range(k + 1)}
        budget = int(rng.integers(0, (sizes * counts).sum() + 1))
        taken = fit(sizes, counts, budget, 1 << 16)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert abs(int((sizes * taken).sum()) - budget) == min(abs(x - budget) for x in sums)


def test_mix(docs):
    rows = mix_documents(docs).collect()
    sizes = collections.Counter((r[0], len(words(r[1]))) for r in corpus())
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == sizes
    by_source = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        total = by_source[r["source"]]
        total[0], total[1], total[2] = total[0] + r["size"], total[1] + r["taken"], r["target"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
    assert sum(t[2] for t in by_source.values()) == pytest.approx(sum(t[0] for t in by_source.values()))
    for source, (size, taken, target) in by_source.items():
        sums = {size * int(target // size) if size else 0}
        for r in rows:
            if r["source"] == source and target < 3 * size:
                sums |= {x + r["size"] for x in sums}
        assert abs(taken - target) <= min(abs(x - target) for x in sums) + 1
    again = as_bag(mix_documents(docs.repartition(5)), "doc_id", "source", "size", "taken")
    assert again == as_bag(mix_documents(docs), "doc_id", "source", "size", "taken")
    repeated = repeat_documents(docs)
    assert repeated.columns == docs.columns
    assert sum(len(words(r["text"])) for r in repeated.collect()) == sum(r["taken"] for r in rows)


def test_contained_items(spark, docs):
    long_text = next(r[1] for r in corpus() if r[1] and len(r[1].split()) > 60)
    inside = " ".join(long_text.split()[10:40])
    items = [(1, inside.upper() + "!"), (2, "One"), (3, None), (4, "..."), (5, "nowhere to be found in it"), (None, "two, words"), (1, inside.upper() + "!")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contained_items(docs, benchmark)
    word = re.compile(rb"[a-z0-9\x80-\xff]+")
    expected = set()
    for r in corpus():
        own = word.findall((r[1] or "").encode().lower())
        for ident, text in items:
            wanted = word.findall((text or "").encode().lower())
            size = min(5, len(wanted))
            if size:
                wanted = {tuple(wanted[i:i + size]) for i in range(len(wanted) - size + 1)}
                shared = wanted & {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
                if 100 * len(shared) >= 80 * len(wanted):
                    expected.add((r[0], ident, len(shared), len(wanted)))
    assert expected
    assert {tuple(r) for r in found.select("doc_id", "item_id", "n_shared", "n_item").collect()} == expected
    leaking = {e[0] for e in expected}
    assert {r["doc_id"] for r in without_items(docs, benchmark).select("doc_id").collect()} == {r[0] for r in corpus()} - (leaking - {None})


def test_urls(spark):
    rules = (Rule("allow", "org", "/"), Rule("block", "example.org", "/en/1"), Rule("block", "com", "/de/"), Rule("allow", "com", "/de/"))
    urls = ["http://a.EXAMPLE.org/en/17?x", "http://example.org/en/2", "https://x.com/de/", "https://com/de/a#b", "no url", None, "http://org", "http://notexample.com/fr", "x://borg/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages, rules).collect()}
    assert got[0] == got[9] == ("a.example.org", "/en/17", "example.org/en/1", "block")
    assert got[1] == ("example.org", "/en/2", "org/", "allow")
    assert got[2] == ("x.com", "/de/", "com/de/", "block")
    assert got[3][2:] == ("com/de/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("org", "", None, "allow")
    assert got[7][2:] == got[8][2:] == (None, "allow")


PAGE = """<html><head><title>T</title><script>var t="<p>no</p>";</script></head><body><div class="{c}"><nav><ul><li><a href=/>Menu</a></ul></nav>
<div class="body"><h1>Head &amp; line</h1><p>First  para\ngraph <b>bold<p>Second<br>third &lt;x&gt;</div><div id=comments><p>Reader</p></div><aside>Side</aside>
<form>Form</form><footer>&copy; Foot</footer></div></body>"""


def test_page_text_without_article_element():
    page = read_page(PAGE.format(c="wrap"))
    assert blocks(page, own_slot(page)) == "Head & line\nFirst para graph bold\nSecond\nthird <x>"


@pytest.mark.parametrize("quote", ["'", '"', ""])
@pytest.mark.parametrize("opening", ["<body class='no-sidebar'>", "<body class='sidebar comments'>", "<body><div class='layout has-sidebar'>", "<body><div class='widget'>"])
def test_words_on_enclosing_elements_drop_no_article(opening, quote):
    text = "\u0130" * 12 + " text of the article that goes on for a while"
    source = f"""{opening}<div class="sidebar">Side</div><div><h2 class='section-header'>Heading</h2><p>{text}<script>if (a > b) c</SCRIPT >
<p>Sum <math><mi>x</mi></math> and <object>fallback</object> and <canvas>drawn</canvas></div>"""
    if not quote:  # a bare value has no blanks
        source = source.replace("sidebar comments", "sidebar").replace("layout has-sidebar", "has-sidebar")
    page = read_page(re.sub("['\"]", quote, source))
    assert blocks(page, "") == f"Heading\n{text}\nSum x and fallback and drawn"


@pytest.mark.parametrize("attribute", ["class='notice'", 'class="notice"', "class=notice", "id='sidebar'", "class='big menu'", "role='dialog'", "aria-hidden='true'", "class = 'ads'"])
def test_words_drop_clutter_in_any_quotes(attribute):
    page = read_page(f"<body><div><p>The article has some words to keep.</p></div><div {attribute}><p>Not this</p></div>")
    assert blocks(page, "") == "The article has some words to keep."


@pytest.mark.parametrize("head", ["<header><h1>Title</h1></header>", "<div class='header'><h1>Title</h1></div>", '<div class="header top"><h1>Title</h1></div>'])
def test_headline_of_an_article_stays(head):
    page = read_page(f"<body><header>Site</header><div class='header'>Site</div><article>{head}<p>Text of the article.</p><footer>End</footer></article>")
    assert blocks(page, own_slot(page)) == "Title\nText of the article."


CLASHING = ["_id", "_key", "_source", "_times", "_copies", "_lost", "_n", "_grade", "selected", "tail", "expected_grade", "size", "taken", "part", "root", "text_key", "item_id"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with nulls, repeats and columns that have the operators' own names, each with a text of its own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r[:5], *[f"{c} of {r[0]}" for c in CLASHING]) for r in corpus()], schema).repartition(3)


def kept_as_they_were(found, docs, times=False):
    """Every row found is a row of the table, column by column, and as often at most."""
    assert found.columns == docs.columns
    have, got = (collections.Counter(tuple(r) for r in x.collect()) for x in (docs, found))
    assert got and got.keys() <= have.keys() and (times or all(n <= have[r] for r, n in got.items()))
    return got


def test_clashing_columns(spark, clashing):
    items = spark.createDataFrame([(1, corpus()[0][1])], "item_id long, text string")
    kept_as_they_were(without_items(clashing, items), clashing)
    kept_as_they_were(keep_one_per_component(clashing, Similarity(size=5, num=80, den=100)), clashing)
    kept_as_they_were(repeat_documents(clashing), clashing, times=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    graded = grade_documents(clashing, labels)
    assert set(graded.columns) == set(clashing.columns) and dict(graded.dtypes)["selected"] == "boolean" and dict(graded.dtypes)["_grade"] == "string"


def test_repeated_ids_are_graded_alike_each_time(spark):
    rows = [(i % 30, f"text {i} " + "word " * (i % 7), None, None, None) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(30)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) AS toxic")
    runs = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if parts == 1 else rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
        runs.append(as_bag(grade_documents(docs, labels), "doc_id", "text", "expected_grade", "tail"))
    assert runs[0] == runs[1]


@pytest.mark.parametrize("seed", range(4))
def test_sources_weighed_by_spark_or_the_driver(spark, seed):
    from patronage.llm.mixing import Mix, _weighed, _weighed_by_spark

    rng = np.random.default_rng(seed)
    names = [None, "", "é", "Z", "a", *[f"s{i}" for i in range(int(rng.integers(0, 40)))]]
    rows = [(n, int(rng.integers(0, 4) and rng.lognormal(5, 2))) for n in names]
    sources = spark.createDataFrame(rows, "source string, source_size long").repartition(3)
    a, b = ({r["source"]: (r["source_size"], r["target"]) for r in f(sources, Mix()).collect()} for f in (_weighed, _weighed_by_spark))
    assert a.keys() == b.keys() and all(a[s] == pytest.approx(b[s], rel=1e-12) for s in a)


def test_more_sources_than_the_driver_weighs(docs):
    from patronage.llm.mixing import Mix

    few, many = (as_bag(mix_documents(docs, Mix(max_sources=n)), "doc_id", "size", "source_size", "taken") for n in (100, 1))
    assert few == many


def test_pipeline_keeps_foreign_columns_and_survives_odd_rows(spark, clashing, tmp_path):
    nothing = clashing.limit(0)
    for name, docs in (("full", clashing), ("empty", nothing)):
        folder = tmp_path / name
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, corpus()[9][1]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        current = spark.read.parquet(f"{folder}/documents.parquet")
        for place, (stage, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, current, str(folder)).write.parquet(f"{folder}/{place}")
            following = spark.read.parquet(f"{folder}/{place}")
            if place < len(corpus_pipeline.STAGES) - 1:
                if name == "full":
                    kept_as_they_were(following, current, times=stage.startswith("mixing"))
                assert following.columns == current.columns
            current = following
        assert (current.count() > 0) == (name == "full")


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(c="wrap")) for i in range(8)]
    rows += [(8, None, None), (9, "http://h0.org/", ""), (10, "x", "plain <b>text"), (10, "x", "plain <b>text"), (11, "http://h0.org/", "<p>other page</p>")]
    got = collections.defaultdict(list)
    for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == ["Head & line\nFirst para graph bold\nSecond\nthird <x>"] for i in range(8))
    assert got[8] == got[9] == [""] and got[10] == ["plain text"] * 2 and got[11] == ["other page"]


def test_template_words_leave_and_all_slots_stay(spark):
    def page(i):
        paragraphs = "".join(f"<p>the story {i} has part {k} <i>and</i> the end{i * k}" for k in range(1 + i % 3))
        return f"""<body><div class=x1>Our site is the best of the <b>whole</b> web</div><div class=x2>{paragraphs}</div>
<div class=x3>Written by author{i} for the site</div><div class=x4><p>All rights reserved by the owner<p>Call us any day</div></body>"""

    rows = [(i, "http://a.org/", page(i)) for i in range(8)] + [(8 + i, "http://b.org/", page(i // 9)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        story = [f"the story {i} has part {k} and the end{i * k}" for k in range(1 + i % 3)]
        assert got[i] == "\n".join([*story, f"Written by author{i} for the site"])
    # two different pages, one of them nine times, are no template
    assert "the story 0 has part 0 and the end0" in got[8] and "Written by author0 for the site" in got[8]


def test_lines(spark):
    long_line = "the quick brown fox jumps over the lazy dog and runs away from the farm before dawn"
    rows = [(2, f"{long_line}\nown line of two\nLes."), (1, f"A\n\n{long_line}!\nles. "), (3, None), (4, ""), (5, f"{long_line} x\nother"), (None, "other")]
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (4, 0, f"A\n\n{long_line}!\nles. ")
    assert got[2] == (3, 2, "own line of two")
    assert got[3] == (0, 0, None) and got[4] == (1, 0, "") and got[5] == (2, 1, "other") and got[None] == (1, 1, "")


def test_line_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    lines = []
    for _ in range(60):
        base = "".join(rng.choice(list("abcdefgh "), 120))
        lines += [base, base[:60] + "XY" + base[60:], base[:-3]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    removed = {r["doc_id"] for r in dedup_lines(docs, Fuzzy()).where("n_removed > 0").collect()}
    assert len(removed & {i for i in range(180) if i % 3}) >= 0.95 * 120
    assert not removed & {i for i in range(180) if i % 3 == 0}


def test_long_line_recall_near_the_bound(spark):
    rng = np.random.default_rng(11)
    lines = []
    for _ in range(400):
        base = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1200)
        copy = base.copy()
        copy[rng.choice(1200, int(rng.integers(19, 28)), replace=False)] = "0"
        lines += ["".join(base), "".join(copy)]
    sets = [{t[i:i + 5] for i in range(len(t) - 4)} for t in lines]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = collections.Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    linked = {b: n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    assert sum(j < 0.85 for j in linked.values()) > 250
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    removed = {r["doc_id"] for r in dedup_lines(docs).where("n_removed > 0").collect()}
    assert removed == set(linked)


def test_quality_ranks_the_grades(spark):
    rng = np.random.default_rng(4)
    good, rude = [f"g{i}" for i in range(300)], ["idiot", "trash", "moron"]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(good, 40))
        if i % 9 == 0:
            w[5:5] = list(rng.choice(rude, 3))
        if i % 9 == 1:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w), "clash"))
        if i < 600:
            labels.append((i, int(i % 9 != 1), int(i % 9 == 0)))
    rows += [(900, None, ""), (901, "", "")]
    labels += [(None, 1, 0), (3, None, 0), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, selected string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in grade_documents(docs, known).collect()}
    test = [got[i]["selected"] == (i % 9 > 1) for i in range(600, 900)]
    assert np.mean(test) > 0.97 and got[900]["tail"] == got[901]["tail"]
    alone = grade_documents(docs, known.limit(0)).collect()
    assert len(alone) == 902 and all(r["selected"] and r["tail"] is None for r in alone)


def test_empty_tables(spark, nothing):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        exact_groups(nothing), ngram_components(nothing), keep_one_per_component(nothing), score_documents(nothing), shard_rows(nothing),
        mix_documents(nothing), repeat_documents(nothing), contained_items(nothing, benchmark), dedup_lines(nothing),
        judge_urls(pages, ()), main_text(pages), grade_documents(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")),
    ):
        assert df.count() == 0


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
