"""Learned operators: toxicity, boosted trees and page texts, on data they have not seen."""

import html
import random
import re

import numpy as np
from pyspark.sql import functions as F

from framekit.llm import boosting, html_text, toxicity
from framekit.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def corpus(rng, n):
    clean = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    bad = ["nastyword", "vileness", "rottenfolk"]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ish"]))
        junk = rng.random() < 0.2
        if junk:
            words += ["click"] * 8
        rows.append((i, " ".join(words), int(not junk), int(toxic)))
    return rows


def test_chain_on_held_out_documents(spark):
    rows = corpus(random.Random(6), 900)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _, _ in rows], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i < 600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert sum(got[i].is_toxic == bool(t) for i, _, _, t in held) >= 0.97 * len(held)
    assert sum((got[i].p_junk > 0.5) == (q == 0) for i, _, q, _ in held) >= 0.95 * len(held)


def test_later_models_use_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    n = 600
    hidden = rng.random(n) < 0.5
    # the first category is seen through noisy features, the second is the first one's complement and has no features of its own
    rows = [np.flatnonzero(np.r_[rng.random(3) < (0.8 if h else 0.2)]) for h in hidden]
    none = [np.empty(0, np.int64)] * n
    weights = toxicity.fit_chain([rows, none], [3, 0], np.column_stack([hidden, ~hidden]).astype(float), np.arange(n) % toxicity.FOLDS)
    assert weights[1][0] < -1 and weights[1][1] > 0


def test_missing_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.is_toxic for r in toxicity.judge(docs, none).collect()] == [False] * 4
    one = spark.createDataFrame([(2, 1, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.is_toxic for r in toxicity.judge(docs, one).collect()] == [False] * 4
    assert toxicity.judge(docs.limit(0), one).count() == 0


def test_sample_loses_only_near_copies(spark):
    rng = random.Random(11)
    texts = [" ".join(["aa", "bb", *(f"w{rng.randrange(5000)}" for _ in range(60))]) for _ in range(80)]
    rows = [(i, t, 1, int(i % 4 == 0)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] + " more", 1, int(i % 4 == 0)) for i in range(20)]  # near copies
    rows += [(200 + i, texts[i], 1, int(i % 4 != 0)) for i in range(10)]  # copies with the other label
    rows += [(300, "", 1, 0), (301, None, 1, 0), (302, "aa bb", 1, 0), (303, "aa bb cc", 1, 0), (304, "AA bb", 1, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, quality int, toxic int")
    got = sorted(r.id for r in toxicity.labelled_sample(docs, labels, ("quality", "toxic"), "doc_id", "text", 1000).collect())
    assert got == [*range(80), *range(200, 210), 300, 302, 303]


def test_toxicity_query_keeps_all_documents(spark):
    assert QUERIES["op3_toxicity"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_boosting_learns_what_one_feature_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x[:3000], y[:3000])
    assert ((model.logits(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.97
    assert boosting.fit(x[:5], np.ones(5)).logits(x[:2]).min() > 0


def trained():
    words = "plain words of a made text, with marks. They go on and on.".split()
    rng = random.Random(0)
    rows = []
    for k in range(250):
        paragraphs = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 60))) for _ in range(rng.randint(1, 9))]
        rows.append(html_text.labelled(*html_text.layout(paragraphs, random.Random(k))))
    return boosting.fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))


def test_pages_of_other_layouts():
    model = trained()
    body = "<p>First block, with &amp; and&nbsp;more.</p><p>Second <b>bold</b> block<br>goes on.</p><p>Third block of some words. It has two parts.</p>"
    want = "A title here First block, with & and more. Second bold block goes on. Third block of some words. It has two parts."
    links = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul>"
    pages = [
        f"<body><nav>{links}</nav><article><h1>A title here</h1>{body}</article><footer>&copy; somebody</footer></body>",
        f'<div class="menu">{links}</div><div class="content"><h1>A title here</h1>{body}<div class="ad">Buy now</div></div><div id="comments"><p>I agree with this.</p></div>',
        f"<header><h2>Site</h2></header><main><h1>A title here</h1>{body}</main><aside><h3>Related</h3>{links}</aside><script>var x='<p>';</script>",
        f'<div id="cookie-banner"><p>We use cookies.</p></div><section class="post-body"><h1>A title here</h1>{body}<form><input><button>go</button></form></section>',
    ]
    for page in pages:
        assert html_text.article_text(page, model) == want, page[:60]
    assert html_text.article_text("", model) == "" and html_text.article_text("<<<>&", model) in ("", "<<<>&", "<<<", "<<<>&".strip())


def test_only_attributes_that_hide_make_silent():
    def seen(source):
        page = html_text.read_page(source)
        return "".join(t for node, t in page.events if t and not page.silent[node])

    for shown in ('a title="A hidden gem"', 'div class="post hidden md:block"', "div data-x='display:none'", 'div title=" aria-hidden=true "', 'p aria-hidden="false"'):
        assert seen(f"<{shown}>text</{shown.split()[0]}>") == "text", shown
    for hides in ("div hidden", 'div hidden=""', "div HIDDEN class=x", "div hidden/", 'div style="color:red; display : none"', "p aria-hidden=true", 'p class="a" aria-hidden="true"'):
        assert seen(f"<{hides}>text</{hides.split()[0]}>") == "", hides
    assert seen("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>") == "so x=1 holds"


def test_heads_end_without_their_tag_and_svg_closes_itself():
    for source, wanted in (
        ("<html><head><title>t</title><body><article><p>one</p></article>", {"one"}),
        ("<head><title>t</title><meta charset=x><article><p>one</p></article>", {"one"}),
        ("<head><title>t</title>one", {"one"}),
        ("<head><title>t</title><script>x</script></head><p>one</p>", {"one"}),
        ("<article><svg/>in<p>later</p></article>", {"in", "later"}),
        ('<article><svg viewBox="0 0 1 1" />in<p>later</p></article>', {"in", "later"}),
        ("<article><svg><path d='x'/><g/></svg>in</article>", {"in"}),
        ("<article><svg><text>no</text></svg>in<math><mspace/><mi>x</mi></math></article>", {"in", "x"}),
        ("<article><div/>in</article>", {"in"}),
    ):
        page = html_text.read_page(source)
        assert {t.strip() for node, t in page.events if t and t.strip() and not page.silent[node]} == wanted, source


def test_states_never_reenter():
    page = html_text.read_page("<div><section><div><p>a</p></div></section></div>")
    scored, _, own = html_text.node_features(page)
    logits = np.array([-5.0, -5, 5, -5, 5])
    inside = html_text.decode(page, scored, logits, own)
    assert not (inside[2] and inside[4] and not inside[3])


def test_html_query_equals_the_marked_articles(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op8_html_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = " ".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))


def test_html_rows_and_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (None, "<article><p>x y z, a.</p></article>", "old")], "page_id long, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.filter("html is null").collect()) == ["", ""]
    assert html_text.extract(df.limit(0)).count() == 0
    assert F is not None
