import collections
import html
import math
import random
import re
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import html_tree, mixing, quality
from test_jaccard import expected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality ---------------------------------------------------------------------------


def slow_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen, covered = collections.Counter(windows), set()
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c a b c", "a a a a a", "x\nx\n\nx \n x", "é ü\x0bñ o # & <b>|%",
    "to be or not to be or not", "l1 a\nl1 a\nl2 b\nl1 a\n", "word " * 5000, "\n".join(["same line here"] * 300),
]


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcd\n") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", quality.measures(F.col("t")).alias("m")).select("i", "m.*").collect():
        assert tuple(row[m] for m in quality.MEASURES) == slow_measures(texts[row.i])


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 200), (9, 200), (10, 200), (50, 5000), (0, 0), (240, 5000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for row in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("t")).collect():
        exact = float(sum(math.comb(row.n, i) * Fraction(1, 20) ** i * Fraction(19, 20) ** (row.n - i) for i in range(row.k + 1)))
        assert row.t == pytest.approx(exact if row.k < row.n * 0.05 else 1.0, rel=1e-9)


def labelled(spark, n=1200, seed=3):
    """Good prose with now and then one symbol, and bad text with many."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(50, 90))]
        bad = i % 5 == 0
        if bad:
            words = [w + rng.choice(["***", "&&&"]) for w in words]
        elif rng.random() < 0.1:
            words[0] += "&"
        docs.append((i, " ".join(words), None if i % 3 == 0 else "en", bad))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    labels += [(None, 1), (3, None), (5, 7)]
    schema = "doc_id long, text string, lang string, n_words boolean"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_reject_the_bad_and_keep_the_good(spark):
    docs, labels = labelled(spark)
    got = quality.judged(docs, labels, carry=("n_words",)).select("id", "row.n_words", "kept").collect()
    assert len(got) == 1200
    assert [r.id for r in got if r.n_words == r.kept] == []
    kept = quality.kept_rows(docs, labels)
    assert kept.columns == docs.columns and kept.filter("n_words").count() == 0


def test_too_few_labels_prove_nothing(spark):
    docs, labels = labelled(spark, 60)
    assert quality.kept_rows(docs, labels).count() == 60
    assert quality.kept_rows(docs, labels.limit(0)).count() == 60
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_useless_rule_gets_no_cutoff(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", 1 - F.col("quality"))  # bad is now what has few symbols
    assert quality.kept_rows(docs, flipped).count() == 1200


# --- mixing ----------------------------------------------------------------------------


def slow_targets(sizes, share, repeats, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(repeats * sizes[s] for s in full)
        rest = sum(weight[s] for s in sizes if s not in full)
        out = {s: repeats * sizes[s] if s in full else left * weight[s] / rest for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > repeats * sizes[s]}
        if not over:
            return out
        full |= over


def mix_rows(seed=5):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "tiny", "empty"]
    rows = []
    for i in range(700):
        source = rng.choice(sources[:5] + ["b"] * 4)
        rows.append((i, "w " * rng.choice([1, 5, 20, 60]), source, 0.5))
    rows += [(1000, "one two", "tiny", 0.0), (1001, None, "empty", 0.0), (1002, "", "empty", 0.0), (None, "no id here", "a", 0.0), rows[0], rows[0]]
    return rows


def test_schedule(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.schedule(df, mixing.cycle(3, 1, 2)).collect()
    sizes = collections.Counter()
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    expect = slow_targets(sizes, 1.5, 2)
    assert len(got) == len(rows)
    taken, largest = collections.Counter(), max(r.size for r in got)
    for r in got:
        assert r.target == pytest.approx(expect[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for source, target in expect.items():
        assert abs(taken[source] - target) <= 2 * largest
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=largest)
    again = mixing.schedule(df.repartition(3), mixing.cycle(3, 1, 2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_is_the_queue_in_order(spark):
    """Brute force: order all turns of all documents by finish time, take while the budget lasts."""
    rows = [r for r in mix_rows(9) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.schedule(df, mixing.cycle(3, 1, 2)).collect()
    queues = collections.defaultdict(list)
    for r in sorted((r for r in got if r.size), key=lambda r: (r.draw, r.id)):
        queues[r.source].append(r)
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    served = []
    for k, source in enumerate(order):
        end = 0
        for _ in range(2):
            for r in queues[source]:
                end += r.size
                served.append((end / r.target, k, r.id, r.size))
    budget, copies = sum(slow_targets({s: q[0].source_size for s, q in queues.items()}, 1.5, 2).values()), collections.Counter()
    for _, _, doc, size in sorted(served):
        budget -= size
        if budget < -1e-6:
            break
        copies[doc] += 1
    assert {r.id: r.copies for r in got if r.copies} == dict(copies)


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string, target double")
    plan = mixing.schedule(df, mixing.cycle(3, 1, 2))
    mixed = mixing.mix(df, mixing.cycle(3, 1, 2))
    assert mixed.columns == df.columns
    expect = plan.groupBy("id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
    assert sorted(map(str, mixed.groupBy("doc_id").count().collect())) == sorted(str(r).replace("id=", "doc_id=").replace("n=", "count=") for r in expect)
    assert mixing.mix(df.limit(0), mixing.cycle(1)).count() == 0


# --- pages -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def page_model(spark):
    return html_tree.fit(html_tree.training_pages(spark, pages=500))


def test_held_out_pages(page_model):
    rng = random.Random(77)
    wrong = total = 0
    for _ in range(120):
        tree = html_tree.parse(html_tree._author(rng))
        label, score = html_tree.labels_of(tree), page_model.marginals(tree)
        for i, tag in enumerate(tree.tag):
            if tag is None and tree.text[i].strip():
                total += 1
                wrong += (score[i] > 0) != bool(label[i])
    assert wrong / total < 0.02


def test_marginals_are_exact(page_model):
    """Against the sum over all labellings of a small tree."""
    tree = html_tree.parse("<nav><a>x</a></nav><article><p>Some words here.</p></article>")
    n, link = len(tree.tag), [False] * 20
    own = []
    for i in range(n):
        link[i] = i > 0 and (link[tree.parent[i]] or tree.tag[i] == "a")
        own.append(sum(page_model.odds.get(f, 0.0) for f in html_tree.features(tree, i, link[i])))
    weight = [0.0] * n
    total = 0.0
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = math.exp(y[0] * (page_model.root + own[0]))
        for i in range(1, n):
            w *= page_model.step[y[tree.parent[i]]][y[i]] * math.exp(y[i] * own[i])
        total += w
        for i in range(n):
            weight[i] += w * y[i]
    for got, w in zip(page_model.marginals(tree), weight):
        assert 1 / (1 + math.exp(-got)) == pytest.approx(w / total, abs=1e-9)


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
    '<div class="ad">Buy this now.</div><article><h1>A  title &amp; more</h1><p>First\n para <b>bold</b> &eacute;nd.'
    '<p>Second &lt;one&gt; here, with many more words to read.<br>Same block.</p><script>var x="</p>";</script></article>'
    "<footer>&copy; someone</footer></body></html>"
)


def test_extract(spark, page_model):
    rows = [
        (1, "u", PAGE, "x"),
        (2, None, None, "x"),
        (None, "u", "", "x"),
        (3, "u", "<<<>><p <a href='", "x"),
        (4, "u", "<div>" * 20_000 + "</p>" * 5, "x"),
        (1, "u", PAGE, "x"),
        (5, "u", "<article><p>" + "long text here. " * 20_000 + "</p></article>", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_tree.extract(df, page_model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = collections.Counter(r.text for r in got if r.page_id == 1)
    assert texts == {"A title & more\n\nFirst para bold énd.\n\nSecond <one> here, with many more words to read. Same block.": 2}
    assert [r.text for r in got if r.page_id == 2] == [""]
    assert [r.n_chars for r in got if r.page_id == 5] == [len("long text here. " * 20_000) - 1]
    assert html_tree.extract(df.limit(0), page_model).count() == 0


def test_pages_of_the_table(spark, page_model):
    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = re.sub(r"</?(p|h1)[^>]*>", "\0", inner).replace("<br>", " ")
        return "\n\n".join(t for b in re.sub("<[^>]+>", "", parts).split("\0") if (t := " ".join(html.unescape(b).split())))

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_tree.extract(pages, page_model).collect()} == truth


PROSE = "The harbour was quiet that morning, and the boats lay still on the grey water."


def article(inner):
    return f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>{PROSE}</p>{inner}</article></body></html>"


@pytest.mark.parametrize(
    "inner, expect",
    [
        ("<p>Energy is <math><mi>E</mi>=<mi>mc</mi></math> in the end, as he wrote.</p>", "Energy is E=mc in the end, as he wrote."),
        ("<p>Seen here: <object data='x'>the old map of the town</object> as drawn.</p>", "Seen here: the old map of the town as drawn."),
        ("<p>Before the drawing. <svg><path d='M0'><p>After the drawing, all is kept.</p>", "Before the drawing.\n\nAfter the drawing, all is kept."),
        ("<p>Before it. <svg><text>axis</text></svg>After it, on one line.</p>", "Before it. After it, on one line."),
        ("<noscript><p>Text behind a tag that never ends.</p>", "Text behind a tag that never ends."),
        ("<p>Five &lt; six, &#9999999999; and &amp;amp; stay.</p>", "Five < six, \ufffd and &amp; stay."),
        ("<p title='a > b'>A quoted bracket in a tag.</p>", "A quoted bracket in a tag."),
    ],
)
def test_nothing_inside_the_article_is_dropped(page_model, inner, expect):
    assert html_tree.main_text(article(inner), page_model) == f"A title\n\n{PROSE}\n\n{expect}"


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 10**6, '<a b="' + '>"<a b="' * 100_000, "<svg>" * 100_000, "<svg><p>" * 50_000 + "</svg>", "<!--" * 200_000,
        "<p><button>" + "<span>" * 50_000 + "<div></div>" * 50_000, "<noscript>" * 100_000, "&#" + "9" * 100_000 + ";",
    ],
)
def test_hostile_pages_take_linear_time(page_model, page):
    start = time.process_time()
    html_tree.main_text(page, page_model)
    assert time.process_time() - start < 30


def test_tag_ends_by_table_equal_those_by_scan():
    rng = random.Random(4)
    for _ in range(3000):
        page = "".join(rng.choices(["<a ", ">", '"', "'", " x=", "y", "</b", "\n"], k=rng.randrange(1, 14)))
        table = html_tree.TagEnds(page)
        table._list(0)
        for at in range(len(page)):
            assert table.after(at) == html_tree.TagEnds(page).after(at)


# --- pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).checkpoint()
        ids = [r.doc_id for r in out.collect()]
        if name == "quality_rules":
            expect = [i for i, t in texts.items() if (m := slow_measures(t))[0] >= 50 and 100 * m[5] <= 50 * m[0]]
            assert set(ids) <= set(expect)
        if name == "simhash_near_dedup":
            assert sorted(ids) == expected([(r.doc_id, r.text) for r in docs.collect()])
        if name == "mixing_sources":
            assert max(collections.Counter(ids).values()) <= 2
        if name != "sentencepiece":
            assert out.columns == names
        sizes.append(len(ids))
        docs = out
    assert sizes[0] >= sizes[1] and sizes[2] == sizes[3]


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names
