"""The operators against brute force, planted cases and odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from huescope.llm import components, decontaminate, embeddings, html, licenses, lm, mixing, near_dedup, quality, queries, tokens, urls
from huescope.llm.spans import chunks, mix, span_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `set` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a b c d e f"), (6, "a b c d e f"), (7, LONG), (8, LONG + " tail"), (9, "ÄÖ ñ x \U0001f600")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i else None, None if i == 7 else "s", len(t or ""), 0) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(20, 22), (22, 21), (20, 22)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, 20: 20, 21: 20, 22: 20}


def test_near_duplicates_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = WORD.findall((r.text or "").lower() if (r.text or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, width=4).collect()}
    assert {i: (len(sets[i]), find(i), find(i) == i) for i in ids} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id, r.component_id) for r in rows if r.n_shingles == 0) == [(1, 1), (2, 2), (3, 3)]
    assert {r.component_id for r in rows if r.doc_id in (7, 8)} == {7} and {r.component_id for r in rows if r.doc_id in (None, 6)} == {6}
    kept = sorted(r.doc_id for r in near_dedup.keep_one(odd).collect())
    assert kept == [1, 2, 3, 4, 6, 7, 9]
    assert near_dedup.keep_one(empty).collect() == [] and near_dedup.near_duplicates(empty).collect() == []


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 900, dtype=np.uint64))
    agree = np.mean([(near_dedup.sketch(np.sort(np.append(a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)))) == near_dedup.sketch(a)).mean() for _ in range(20)])
    assert abs(agree - 0.8) < 0.03
    assert (near_dedup.sketch(a[:1]) < 2**64 - 1).all()


def _roots(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def _similar(x, y):
    return 100 * len(x & y) >= 80 * len(x | y)


@pytest.mark.parametrize("refs", ["group", "mixed"])
def test_near_copies_meet_by_their_differences(spark, refs):
    """A group of near copies, its base not among them: those that are linked to none of them aren't paired with all; no link is lost, whatever the groups."""
    rng = np.random.default_rng(5)
    new = lambda n: set(rng.integers(0, 2**62, n).tolist())
    swap = lambda s, n, more: (s - set(rng.choice(sorted(s), n, replace=False).tolist())) | new(more)
    base, second = new(200), new(120)
    members = [swap(base, 8, int(rng.integers(4, 9))) for _ in range(60)]
    outside = [swap(base, 30, int(rng.integers(24, 31))) for _ in range(60)]
    outside += [swap(members[i], 14, 14) for i in range(6)] + [swap(base, 21, 3) for _ in range(6)] + [swap(x, 10, 10) for x in outside[:4]]
    outside += [swap(base, 90, 90) for _ in range(5)] + [second, swap(second, 5, 5), swap(second, 14, 14)]
    sets = dict(enumerate(members + outside))
    root = {i: 0 if i < len(members) else i for i in sets}
    pairs = list(itertools.combinations(sets, 2))
    right = _roots(sets, [(i, j) for i, j in pairs if _similar(sets[i], sets[j])])
    assert {right[i] for i in range(len(members))} == {0} and 20 < len(set(right.values())) < len(outside)
    ref = {i: int(rng.integers(0, 4)) if refs == "mixed" else 0 if i < len(sets) - 3 else i for i in sets}
    nodes = spark.createDataFrame([(i, len(s), root[i], ref[i]) for i, s in sets.items()], "node long, n long, root long, ref long")
    held = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()], "node long, set binary")
    got = {tuple(r) for r in near_dedup._by_prefix(nodes, held, 80).collect()}
    links = [(i, j) for i, j in got if _similar(sets[i], sets[j])]
    assert _roots(sets, links + list(root.items())) == right
    if refs == "group":
        assert len(got) < 2 * len(sets)


def test_near_copies_by_brute_force(spark, monkeypatch):
    """Texts that are edits of one text, some of them with no similar one."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(150)]
    texts = [list(base) for _ in range(240)]
    for i, words in enumerate(texts):
        for k in rng.choice(150, 2 + i % 5, replace=False):
            words[k] = f"e{i}x{k}"
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(texts)}
    right = _roots(sets, [(i, j) for i, j in itertools.combinations(sets, 2) if _similar(sets[i], sets[j])])
    met, by_prefix = [], near_dedup._by_prefix
    monkeypatch.setattr(near_dedup, "_by_prefix", lambda *a: met.append(by_prefix(*a).count()) or by_prefix(*a))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == right
    assert 10 < len(set(right.values())) and len(met) == 1 and met[0] < 2 * len(texts)


def test_decontamination_edits(spark, odd, empty):
    item = " ".join(f"item{i}" for i in range(30))
    words = item.split()
    near = [*words[:7], "other", *words[8:15], *words[16:22], "more", *words[22:]]
    far = [w if i % 3 else "x" for i, w in enumerate(words)]
    rows = [(10, "before " + item.upper() + " after"), (11, "a b " + ", ".join(near) + " c"), (12, " ".join(far)), (13, LONG)]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in rows], DOCS))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "only four words here")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(docs, bench).collect()}
    assert found == {(10, 1): 0, (11, 1): 3}
    assert decontaminate.leaks(docs, bench, block=1).count() == 2
    assert decontaminate.without_leaks(docs, bench).count() == docs.count() - 2
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == docs.count() and decontaminate.leaks(empty, bench).count() == 0


def test_decontamination_recall():
    """Windows with the most edits that count are found: at least 0.97 of them."""
    rng, hits, n = np.random.default_rng(3), 0, 150
    for _ in range(n):
        item = [f"v{x}" for x in rng.integers(0, 500, 30)]
        doc = list(item)
        for p in sorted(rng.choice(30, 6, replace=False), reverse=True):
            kind = rng.integers(3)
            doc[p : p + 1] = [] if kind == 0 else ["z"] if kind == 1 else [doc[p], "z"]
        text = " ".join([f"u{x}" for x in rng.integers(0, 500, 50)] + doc + ["end"] * 40).encode()
        raw = np.frombuffer(text, np.uint8)
        index = decontaminate.Index([(1, " ".join(item))])
        hits += bool(list(index.matches(*decontaminate.words(raw, np.array([0, len(raw)])))))
    assert hits >= 0.97 * n


@pytest.mark.parametrize("n", [100, 200, 400])
@pytest.mark.parametrize("place", ["head cut", "head replaced", "tail cut", "tail replaced", "spread"])
def test_decontamination_recall_of_long_items(n, place):
    """As many edits as count, wherever they are, also in an item longer than others of its group."""
    rng, hits, k = np.random.default_rng(n), 0, n // 5
    for _ in range(20):
        item = [f"v{x}" for x in rng.integers(0, 5000, n)]
        gone = set(rng.choice(n, k, replace=False).tolist()) if place == "spread" else set(range(k)) if "head" in place else set(range(n - k, n))
        doc = [f"x{j}" if j in gone else w for j, w in enumerate(item) if j not in gone or "cut" not in place]
        raw = np.frombuffer(" ".join([f"u{x}" for x in rng.integers(0, 500, n)] + doc + [f"u{x}" for x in rng.integers(0, 500, n)]).encode(), np.uint8)
        index = decontaminate.Index([(1, " ".join(item)), (2, " ".join(f"q{j}" for j in range(n * 9 // 10)))])
        hits += bool(list(index.matches(*decontaminate.words(raw, np.array([0, len(raw)])))))
    assert hits >= 19


def test_decontamination_words_beyond_ascii():
    """Copies inside running text without spaces, and words between punctuation and spaces beyond ASCII."""
    chinese, thai = "水在标准大气压下加热到一百度时会沸腾", "น้ำเดือดที่อุณหภูมิหนึ่งร้อยองศา"
    english = "the “boiling point” of water falls — slowly — as one climbs"
    index = decontaminate.Index([(1, chinese), (2, thai), (3, english), (4, "naïve café über alles 5€"), (5, "😀")])
    docs = [
        "众所周知，" + chinese + "。所以山上不同！", "เรารู้ว่า" + thai + "เสมอ", "众所周知，水在標準大气压下加热，到一百度时会沸腾了。", "(" + english.replace("—", "-").replace("“", '"').replace(" ", "\u00a0") + "…",
        "«naïve\u3000café» über\u2009alles\u00a05 €", "", "水在山上", "cafés naïve", "ok😀😀",
    ]
    raw = [d.encode() for d in docs]
    got = index.matches(*decontaminate.words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])))
    assert sorted((r, i, edits) for r, i, edits, *_ in got) == [(0, 1, 0), (1, 2, 0), (2, 1, 2), (3, 3, 0), (4, 4, 0), (8, 5, 0)]


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.judge(docs, labels).join(labels, "doc_id")
    right = got.select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
    assert quality.choose(docs, labels).count() == quality.judge(docs, labels).filter("kept").count()
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert quality.judge(odd, none).filter("kept").count() == len(ODD)
    assert quality.judge(empty, none).count() == 0 and quality.choose(empty, none).count() == 0


def test_quality_by_brute_force(spark):
    """Weights from n-grams counted in a dictionary, keys sorted: the k greatest stay, with all that tie with the k-th; a temperature lets the draw decide more."""
    rng = np.random.default_rng(8)
    words = ["Water", "the", "of", "x9", "BUY", "now", "!!", "stone", "é", "--", "river", "Ok"]
    texts = [" ".join(rng.choice(words[(i % 2) * 4 : (i % 2) * 4 + 8], rng.integers(0, 40))) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3 + [(None, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fits = {r.doc_id for r in labels.filter("quality = 1 and pmod(xxhash64(doc_id, 1), 2) = 0").collect()}
    buckets = 512

    def ngrams(text):
        data = (text or "").encode()
        found = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+", data)
        hashes = [int(span_hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in found]
        forms = [(1 if re.match(rb"[A-Za-z0-9\x80-\xff]", t) else 2) * 4 + (65 <= t[0] <= 90) * 2 + (65 <= t[-1] <= 90) for t in found]
        mixed = lambda x, n: int(mix(np.array([x % 2**64], np.uint64), n)[0])
        two = [int(quality._AGAIN) if a == b else mixed(3 * a + b, 5) for a, b in itertools.pairwise(hashes)]
        return [h % buckets for h in hashes + two + [mixed(16 * a + b, 6) for a, b in itertools.pairwise(forms)]]

    rows = [(r.doc_id, r.text, r.s) for r in docs.select("*", F.xxhash64("doc_id", "text").alias("s")).collect()]
    raw = Counter(b for _, t, _ in rows for b in ngrams(t))
    target = Counter(b for i, t, _ in rows if i in fits for b in ngrams(t))
    share = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + buckets))
    ratio = {b: share(target, b) - share(raw, b) for b in raw}
    weight = lambda t: 100 * sum(ratio[b] for b in ngrams(t)) / max(1, len(ngrams(t)))
    kept = {}
    for temperature in (1.0, 40.0):
        keys = {(i, t): weight(t) / temperature + float(quality.gumbel(np.array([s]))[0]) for i, t, s in rows}
        order = sorted((keys[i, t] for i, t, _ in rows), reverse=True)
        place = order.index(keys[7, texts[7]]) + 2  # in the midst of rows that tie
        for k in (0, 1, place, 30, len(rows), len(rows) + 5):
            scored, _, least = quality.fit(docs, labels, buckets=buckets, k=k, temperature=temperature)
            want = sorted((i, t) for (i, t) in keys if k and keys[i, t] >= order[min(k, len(order)) - 1] - 1e-9 and i is not None)
            got = scored.filter(F.col("key") >= F.lit(least)).filter("doc_id is not null").collect()
            assert sorted({r.doc_id for r in got}) == [i for i, _ in want]
            assert all(abs(r.key - keys[r.doc_id, texts[r.doc_id]]) < 1e-9 for r in got)
            assert k != place or sum(r.doc_id == 7 for r in got) == 4
            kept[temperature, k] = {i for i, _ in want}
    assert kept[1.0, 30] != kept[40.0, 30]
    with pytest.raises(ValueError):
        quality.judge(docs, labels, temperature=0.0)


def test_kth_greatest(spark):
    values = [3.0, 1.0, 2.0, 2.0, -5.5, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.kth_greatest(df, "v", k) for k in range(1, 7)] == sorted(values, reverse=True)


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><header class=top><a href=/>Home</a></header><nav><ul><li><a href=x>A</a><li>B</ul></nav>"
        "<div id='cookie-notice'>We use cookies on this site, as all of them do. Accept them or leave.</div><article><h1>Big &amp; small</h1><p>First  \n line<br>goes on.<p>caf&eacute; &lt;x&gt;</p></article>"
        "<section class='comments'><p>A reader says a lot here, in many words, and with a full stop at the end.</p></section><aside>Side</aside><form>Mail <input></form><footer>(c)</footer></body></html>"
    )
    want = "Big & small\nFirst line goes on.\ncafé <x>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (4, "u", "<p <article"), (5, "u", page[: page.index("</article>")])], "page_id long, url string, html string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(pages).collect()]
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (1, want, len(want)), (4, "", 0), (5, want, len(want))]


LAYOUTS = [  # (page, the texts of its content)
    ("<div id=page><div class=menu><a href=a>Home</a> <a href=b>News</a></div><div><h2>Title of it</h2><p>A first paragraph, long enough to be one of an article on its own.</p><p><a href=x>A line that is a link</a></p><p>A second paragraph, as long as the first one was, and a little longer.</p></div><div class=footer>(c) Us</div></div>", ["Title of it", "A first paragraph, long enough to be one of an article on its own.", "A line that is a link", "A second paragraph, as long as the first one was, and a little longer."]),
    ("<table><tr><td><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></td><td><p>The text is in a cell of a table here, as it was on old pages of the web.</p><p>Short.</p><p>It goes on with one more sentence, and that ends what there is.</p></td></tr></table>", ["The text is in a cell of a table here, as it was on old pages of the web.", "Short.", "It goes on with one more sentence, and that ends what there is."]),
    ("<main><p>Before the advert there is a paragraph, which has a number of words.</p><div class=advert>Buy it now, for it is cheap and good.</div><p>After the advert there is another, which has about as many words.</p></main><aside><p>A sidebar says a whole sentence too, of some length.</p></aside>", ["Before the advert there is a paragraph, which has a number of words.", "After the advert there is another, which has about as many words."]),
    ("<article><h1>List</h1><ul><li>First</li><li><a href=x>Second</a></li><li>Third</li></ul><p>After the list comes a paragraph with some words in it.</p></article><div class=comments><p>I think that this is a fine list, and a long one.</p></div>", ["List", "First", "Second", "Third", "After the list comes a paragraph with some words in it."]),
    ("<div class=post><p>A quotation follows, which is by somebody else, and it is short:</p><blockquote>So it is</blockquote><p><a href=s>Source</a></p><p>Then the text goes on as it did before, for the length of a line.</p></div><nav><p>All pages of this site are in this list of pages.</p></nav>", ["A quotation follows, which is by somebody else, and it is short:", "So it is", "Source", "Then the text goes on as it did before, for the length of a line."]),
    ("<div>" * 300 + "<p>Deep inside of many containers there is a paragraph of the usual length.</p>" + "</div>" * 300 + "<div class=cookie-notice>We use cookies, as all do.</div>", ["Deep inside of many containers there is a paragraph of the usual length."]),
]


def test_html_layouts_by_hand():
    """Pages labelled by hand, of six layouts: all blocks right, some of them by their neighbours alone."""
    wrong = turned = 0
    for page, want in LAYOUTS:
        assert html.main_text(page) == "\n".join(want)
        found, parent, depth = html.blocks(page)
        own = [html.score(t, linked, h) for t, linked, h, _ in found]
        kept = html.minimum_cut(own, html._edges(found, parent, depth))
        wrong += sum((o > 0) != (t in want) for o, (t, *_) in zip(own, found, strict=True))
        turned += sum((o > 0) != k for o, k in zip(own, kept, strict=True))
    assert wrong == turned >= 2  # what the classifier's signs alone get wrong is what the cut turns


def test_html_names_that_deceive():
    """Names that speak both ways, names on the main element and names about the whole page don't empty it; the same names beside an article count, in other languages, too."""
    body = "<h1>Heading</h1>" + "".join(f"<p>Paragraph {i} of the article, which has a sentence of the usual length, with a comma in it, and one more clause.</p>" for i in range(5))
    want = html.main_text(f"<body><article>{body}</article></body>")
    assert want.count("\n") == 5
    around = "<body><nav><a href=a>Home</a> <a href=b>News</a></nav>{}<div class=fusszeile><p>Alle Rechte liegen bei uns, und zwar in allen Ländern.</p></div><section class=commentaires><p>Un lecteur dit ici beaucoup de choses, en une phrase.</p></section></body>"
    for opened, shut in (("<div class='post-tags-content'>", "</div>"), ("<main class='share-page'>", "</main>"), ("<div class=widget>", "</div>"), ("<div class=promo><div id=overlay>", "</div></div>"), ("<article class=advertorial>", "</article>")):
        assert html.main_text(around.format(opened + body + shut)) == want, opened
    assert html.main_text(f"<body><div hidden>{body}</div></body>") == html.main_text(f"<body><aside>{body}</aside></body>") == ""
    assert html.main_text("<body><div class=cookie-notice><p>We use cookies on this site, as all of them do.</p></div></body>") == ""


def test_html_odd_tables(spark):
    """An empty table, other columns with the output's names, a very long page."""
    pages = spark.createDataFrame([(1, "u", "<article><p>" + "A word. " * 400_000 + "</p></article>", "x", 7)], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(pages).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got] == [(1, "u", ("A word. " * 400_000).strip(), 8 * 400_000 - 1)]
    assert html.extract(pages.filter("page_id < 0")).count() == 0


def test_html_silent_elements():
    """Elements without an end tag take nothing with them, nested ones end where they end, formulas stay in their sentence."""
    text = "<article><h1>Heading</h1><p>A long first paragraph, which says what the page is about.</p>{}<p>A second one, just as long, which ends the page's text.</p></article>"
    want = html.main_text(f"<body>{text.format('')}</body>")
    assert want.count("\n") == 2
    for tag in html.SILENT:
        for page in (f"<div><{tag}></div>{text}", f"<{tag} src=x>{text}", f"<div><{tag}>Menu</div>{text}<{tag}>Menu</{tag}>", f"<div><{tag}>Menu</div>{text}</{tag}>"):
            assert html.main_text("<body>" + page.format("") + "</body>") == want, page
        for inner in (f"<{tag}>Not <{tag}>content</{tag}> of it, however long it is, and whatever it ends with.</{tag}>", f"<{tag}><p>Not content</p></{tag}>", f"<{tag}/>", f"<div><{tag}></div>"):
            assert html.main_text("<body>" + text.format(inner) + "</body>") == want, inner
        assert html.main_text(f"<article><p>One sentence <{tag}>and <{tag}>no</{tag}> button</{tag}>goes on to its end.</p></article>") == "One sentence goes on to its end."
    formula = "<article><p>The formula <math><semantics><mrow><mi>a</mi><mo>=</mo><mi>b</mi></mrow><annotation>a=b</annotation></semantics></math> stays where it is.</p></article>"
    assert html.main_text(formula) == "The formula a=b stays where it is."
    assert html.main_text("<script>x" + text) == ""


def test_clashing_names(spark):
    """Own columns of the names that the operators use inside come back as they were."""
    names = ["row", "id", "tie", "key", "seed", "text", "doc_id", "source", "_id", "_tie", "_key", "_seed", "good_id", "class", "runs", "c0", "start", "a.b"]
    rows = [tuple(LONG if n == "text" else i if n == "doc_id" else "s" if n == "source" else 10 * i + k for k, n in enumerate(names)) for i in (1, 2)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'source') else 'long'}" for n in names))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "not in any of these texts at all")], "item_id long, text string")
    assert [tuple(r) for r in near_dedup.keep_one(docs).collect()] == rows[:1]
    assert sorted(tuple(r) for r in quality.choose(docs, labels).collect()) == rows
    assert sorted(tuple(r) for r in decontaminate.without_leaks(docs, bench).collect()) == rows
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == names and {tuple(x for x, n in zip(r, names, strict=True) if n != "text") for r in mixed.collect()} <= {tuple(x for x, n in zip(r, names, strict=True) if n != "text") for r in rows}
    captures = spark.createDataFrame([(1, "http://a.org/", 5, "x", 7, False), (1, "http://a.org/", 5, "x", 7, False)], "page_id long, url string, fetched long, host string, since long, kept boolean")
    entries = spark.createDataFrame([("host", "a.org", 1, "block")], "kind string, key string, since long, action string")
    got = urls.judge(captures, entries)
    assert got.columns == ["page_id", "url", "fetched", *urls.RESULT] and [(r.host, r.since, r.kept) for r in got.select("host", "since", "kept").collect()] == [("a.org", 1, False)] * 2


def test_minimum_cut_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        own = rng.normal(size=n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda x: sum(o for o, v in zip(own, x) if o > 0 and not v) - sum(o for o, v in zip(own, x) if o < 0 and v) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731, B905, B023
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html.minimum_cut(own, edges)) - best) < 1e-9


def test_urls(spark):
    captures = spark.createDataFrame([(1, "http://a.b.example.org/x?q", 5), (2, "http://a.b.example.org/x", 20), (3, None, 5), (4, "nothing", 5), (5, "https://B.example.org", None)], "page_id long, url string, fetched long")
    entries = spark.createDataFrame([("host", "b.example.org", 1, "block"), ("host", "b.example.org", 10, "allow"), ("url", "a.b.example.org/x", 15, "block"), ("host", None, 1, "block")], "kind string, key string, since long, action string")
    assert {r.page_id: r.kept for r in urls.judge(captures, entries).collect()} == {1: False, 2: False, 3: True, 4: True, 5: True}
    assert urls.judge(captures, entries.limit(0)).filter("kept").count() == 5


def test_lm_base_and_odd_rows(spark, odd, empty):
    model = queries.tokenizer_path("piece_bpe_32k.model")
    docs = odd.withColumn("held", F.col("doc_id") == 7)
    rows = lm.score(docs, model).collect()
    counts = Counter()
    for i, t in ODD:
        if i != 7:
            counts.update([*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None])
    assert len(rows) == len(ODD) and {r.train_tokens for r in rows} == {n}
    assert sorted(round(r.base_score, 6) for r in rows) == sorted(round(base(t), 6) for _, t in ODD)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.score(empty.withColumn("held", F.lit(False)), model).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", "▁".encode(), "▁a".encode()]
    log_p = np.log(np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0.2]))
    p = np.exp(log_p)
    want = (p[3] * p[0] * p[1] + p[3] * p[2] + p[4] * p[1]) * p[5]
    counts = np.zeros(6)
    got = lm.Lattice(pieces).run([b"ab", b"c"], log_p[None, :])[0]
    lm.Lattice(pieces).run([b"ab"], log_p[None, :], counts)
    assert np.isclose(got[0], np.log(want)) and got[1] == -np.inf
    assert np.isclose(counts[2], p[3] * p[2] * p[5] / want) and counts[5] == 1


def test_lm_score_by_brute_force(spark):
    """score and lattice_score against all segmentations, classes and counts in plain Python; held-out documents teach nothing."""
    model = queries.tokenizer_path("piece_bpe_32k.model")
    rows = [(1, "ab cat the the", "en", False), (2, "the cab é", "en", False), (3, "der ab ab", "de", False), (4, "zz cat", None, False), (5, "the quux " + "x1" * 300, "fr", True), (6, "", "de", False), (7, "the quux", "fr", True)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean"), model).collect()}
    pieces, start = lm.vocabulary(model)
    number, most = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))

    def segmentations(b):
        if not b:
            yield []
        for k in range(1, min(len(b), most) + 1):
            if b[:k] in number:
                for rest in segmentations(b[k:]):
                    yield [number[b[:k]], *rest]

    classes, train = ["de", "en", None], [r for r in rows if not r[3]]
    counts = {c: Counter(w for r in train if r[2] == c for w in r[1].split()) for c in classes}
    ends = {c: sum(r[2] == c for r in train) for c in classes}
    every = sum(counts.values(), Counter())
    ways = {w: list(segmentations(("▁" + w).encode())) for w in {*every, "quux"}}
    weights = {c: np.exp(start) for c in classes}
    way = lambda c, w: math.prod(weights[c][p] for p in w) * weights[c][-1]
    for _ in range(lm.ROUNDS):
        used = {c: np.full(len(start), 0.01) for c in classes}
        for c in classes:
            for w in counts[c]:
                shares = np.array([way(c, x) for x in ways[w]])
                for x, share in zip(ways[w], shares / shares.sum(), strict=True):
                    for p in x:
                        used[c][p] += share
                used[c][-1] += 1
        weights = {c: used[c] / used[c].sum() for c in classes}

    def discounted(counter, end, w, base):
        n = [*counter.values(), *([end] if end else [])]
        one, two = n.count(1), n.count(2)
        cut = one / (one + 2 * two) if one and two else 0.5
        have = end if w is None else counter[w]
        return max(have - cut, 0) / sum(n) + cut * len(n) / sum(n) * base

    def probability(c, w):
        base = lm.END if w is None else sum(way(c, x) for x in ways[w]) * (1 - lm.END)
        below = base * (1 - lm.POOLED) + lm.POOLED * discounted(every, sum(ends.values()), w, base)
        return discounted(counts[c], ends[c], w, below)

    for i, text, *_ in rows:
        words = [*text.split(), None]
        if i == 5:
            assert math.isfinite(got[i].score) and got[i].score < got[7].score - 300
            continue
        want = sum(ends[c] / len(train) * math.prod(probability(c, w) for w in words) for c in classes)
        plain = sum(math.log10(lm.END if w is None else sum(math.exp(sum(start[p] for p in x) + start[-1]) for x in ways[w]) * (1 - lm.END)) for w in words)
        assert abs(got[i].score - math.log10(want)) < 1e-6 and abs(got[i].lattice_score - plain) < 1e-6, i


def test_mixing(odd, empty):
    rows = mixing.mix_sizes(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    for size in {(r.source_size, r.target) for r in rows}:
        assert abs(sum(r.taken for r in rows if (r.source_size, r.target) == size) - size[1]) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sizes(odd).collect()))
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0 and mixing.mix_shards(empty).count() == 0


def test_mixing_targets_by_filling_up(spark):
    """Targets against a plain loop that reshares what is above a cap; sizes and words taken against the texts."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], 300, p=[0.6, 0.2, 0.1, 0.05, 0.05]).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(docs).collect()
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        goal = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and goal[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    source = {i: s for i, _, s in rows}
    assert capped and all(r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[source[r.doc_id]] and abs(r.target - goal[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r.size for r in got)
    for s in names:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == math.floor(goal[s] + 0.5)


def test_mixing_passages_and_shards(spark):
    """Passages stand in their texts as they are, line breaks included; blocks hold a fixed number of words; shards are drawn evenly."""
    text = "\n".join(f"line {i}  has words" for i in range(2000))
    docs = spark.createDataFrame([(1, text, "a", 5), (2, "short one", "a", 6), (2, "short one", "a", 6), (3, " a  b ", "b", 7), (4, None, "b", 8)], "doc_id long, text string, source string, `key` int")
    sizes = mixing.mix_sizes(docs)
    taken = sum(r.taken for r in sizes.collect())
    out = mixing.mix_documents(docs).collect()
    assert sum(len(r.text.split()) for r in out) == taken and all(r.text in text for r in out if r.doc_id == 1) and any("\n" in r.text for r in out)
    assert all(r.text == " a  b " for r in out if r.doc_id == 3) and {r.doc_id: r.key for r in out}.items() <= {1: 5, 2: 6, 3: 7}.items()
    blocks = mixing.mix_shards(docs, block=20, shards=4).collect()
    words: Counter = Counter()
    for r in blocks:
        words[r.source_no, r.slot] += len(r.text.split())
        assert len(r.text.split()) == r["last"] - r["first"]
    assert sum(words.values()) == taken and max(words.values()) == 20 and sum(v < 20 for v in words.values()) <= 6
    per = Counter(shard for shard, _, _ in {(r.shard, r.source_no, r.slot) for r in blocks})
    assert set(per) == {0, 1, 2, 3} and all(abs(n - len(words) / 4) < 5 * math.sqrt(len(words) / 4) for n in per.values())


def test_licenses(spark):
    mit = licenses.LICENCES["MIT"][3]
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 A\n\n" + mit.upper()), (2, mit.replace("license", "licence")), (3, "MIT License"), (4, None), (5, ""), (6, mit + " more")], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, licenses.known(spark)).collect()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None}


def test_long_licenses(spark):
    """Whole texts of long licences, with and without title and appendix; each digest has one name."""
    folder = "/usr/share/common-licenses"
    read = lambda name: open(f"{folder}/{name}").read()  # noqa: E731, SIM115
    apache, gpl = read("Apache-2.0"), read("GPL-3")
    want = {"Apache-2.0": "Apache-2.0", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}
    texts = [(read(f), n) for f, n in want.items()]
    texts += [(apache[: apache.index("APPENDIX")], "Apache-2.0"), (apache[apache.index("TERMS AND") :].upper(), "Apache-2.0"), (gpl[: gpl.index("How to Apply")].replace("https:", "http:"), "GPL-3.0"), (apache[:-300], None), (gpl + " and more", None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, licenses.known(spark)).collect()} == {i: n for i, (_, n) in enumerate(texts)}
    known = licenses.known_digests()
    assert len({d for d, _ in known}) == len(known)


def test_tokens_round_trip(odd, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = sorted(tokens.token_digests(odd, path).collect(), key=lambda r: r.start)
    at, want = 0, []
    for i, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert tokens.token_digests(empty, path).count() == 0
    values = np.array([0, 1, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)
    assert (tokens.unpack(tokens.pack(values)) == values).all() and len(tokens.unpack(tokens.pack(values[:0]))) == 0


def test_encoder_equals_the_library():
    """Odd neighbours of letters, digits, marks, apostrophes, white space and the added token, with a cache that runs over."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, encoder, rng = Tokenizer.from_file(path), tokens.Encoder(path), np.random.default_rng(9)
    alpha = [*"ab'sd re,.0 9\n\t  é\u00a0\u3000日x\x1c\x00\x7f<|>!", "<|endoftext|>", "'s", "'re", "\r\n", " '", "can't", "word " * 30, "x" * 90]
    texts = ["".join(rng.choice(alpha, rng.integers(0, 40))) for _ in range(3000)]
    want = [[*e.ids, tokens.END] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.cuts
    for _ in range(2):
        got = []
        for _, _, data, offsets in chunks(pa.array(texts), 4000):
            ids, counts = encoder.encode(data, offsets)
            got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want
        encoder.compact()
    values = rng.integers(0, 2**18, 50).astype(np.uint32)
    back, counts = tokens.unpack_all(tokens.pack_all(values, np.array([7, 0, 43])))
    assert (back == values).all() and counts.tolist() == [7, 0, 43]


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.25, 0.35)])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    extra = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [1.0] * 15 + [None], 0), (1003, [float("nan")] * 16, 0), (1004, x[0].tolist(), None), (1005, x[0].tolist(), 0), (1006, [], 0), (None, [5.0] * 16, 0), (1007, [5.0, 1.0], 0)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.arange(len(x)) % 2
    links = ((u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])).sum(1) - 1
    links = links + np.where((u @ u[0] >= 0.93) & (lab == 0), 1, 0)  # the copy 1005
    assert len(got) == len(rows) + len(extra)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * links.sum() and all(got[i].n_links <= links[i] for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1006, 1007))
    assert got[1005].component_id == 0 and not got[1005].kept
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_embeddings_with_a_common_direction(spark):
    """Links are found as promised where all vectors lean one way."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 64)) / 8
    x[:, 0] += 1.8
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=u.shape)
    off -= (off * u).sum(1, keepdims=True) * u
    u = np.concatenate([u, 0.931 * u + math.sqrt(1 - 0.931**2) * off / np.linalg.norm(off, axis=1, keepdims=True)])
    assert np.linalg.norm(u.mean(0)) > 0.8
    links = (u @ u.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_embeddings(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(u)], "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got.values()) >= 0.98 * links.sum() and all(got[i] <= links[i] for i in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        kept = after
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_odd_rows(spark, odd, empty):
    """Null, empty, repeated and very long rows, and none at all, through every stage."""
    for rows in (odd, empty):
        kept = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == rows.columns and kept.schema["text"].dataType == rows.schema["text"].dataType, name
        out = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
        assert len(out) == kept.count()
        assert (len(out) > 0) == (rows is odd) and all(r.n_tokens > 0 for r in out)
