import math
import os
import random
import time
from html.parser import HTMLParser

import pytest

from quire.llm import htmltext

TEXT = "Some longer article text, with marks. It goes on; and on, as articles do."
CASES = [
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    (f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{TEXT}<p>x</article><footer>&copy; me</footer>", f"T\n{TEXT}\nx"),
    (f"<div class='ad'>Buy, now. Cheap!</div><article><p><b>{TEXT}<br><p>a\n  b</p></article>", f"{TEXT}\na b"),
    (f"<body><div id=main><h2>T</h2><p>{TEXT}</p><aside>{TEXT}</aside><p>z</p></div><div class='cookie-notice'><p>{TEXT}</p></div></body>", f"T\n{TEXT}\nz"),
    (f"<main><p>{TEXT}</p><section id='comments'><p>{TEXT} {TEXT}</p></section><form>f<input>g</form></main>", TEXT),
    (f"<header><p>Site</p></header><article><header><h1>T</h1></header><p>{TEXT}</p></article>", f"T\n{TEXT}"),
    ("<p>a<script>var t='</p>';</script>b<style>p{}</style></p><!-- <p>no</p> -->", "ab"),
    ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"),
    ("<p>cut<!-- open", "cut"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    (f"<div class=sidebar><ul><li>one, two.</ul></div><div class=post>{TEXT}</div>", TEXT),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_extract(page, want):
    assert htmltext.extract(page) == want


FLAGGED = [
    (f"<div class='content has-sidebar'><h1>T</h1><p>{TEXT}</p></div>", f"T\n{TEXT}"),
    (f"<div id='page-with-menu'><nav>m</nav><article><p>{TEXT}</p></article><div class=comments><article>{TEXT} {TEXT}</article></div></div>", TEXT),
    (f"<form action=/><ul class=menu><li>m</ul><div class='page no-sidebar'><p>{TEXT}</p><p>x</p></div></form>", f"{TEXT}\nx"),
]


@pytest.mark.parametrize(("page", "want"), FLAGGED)
def test_flags_spare_wrappers(page, want):
    assert htmltext.extract(page) == want


SPLIT = [
    (f"<nav>n</nav><div id=content><h1>T</h1><div class=body><p>{TEXT}</p><p>x</p></div></div>", f"T\n{TEXT}\nx"),
    (f"<div><div class=lead><p>{TEXT}</p></div><div class=rest>{f'<p>{TEXT}</p>' * 4}</div></div>", "\n".join([TEXT] * 5)),
    (f"<article><p>{TEXT}</p></article><article>{f'<p>{TEXT}</p>' * 4}</article><p>tail</p>", "\n".join([TEXT] * 5)),
    (f"<h1>T</h1><main><p>{TEXT}</p></main>", f"T\n{TEXT}"),
]


@pytest.mark.parametrize(("page", "want"), SPLIT)
def test_split_and_nested_bodies(page, want):
    assert htmltext.extract(page) == want


def test_table(spark):
    rows = [(i, "u", p) for i, (p, _) in enumerate(CASES)] + [(99, None, None), (None, "u", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in htmltext.extract_text(df).collect()}
    assert all(got[i]["text"] == want and got[i]["n_chars"] == len(want) for i, (_, want) in enumerate(CASES))
    assert got[99]["text"] == "" and got[None]["text"] == "x" and htmltext.extract_text(df.where("page_id = 1000")).count() == 0
    long = "<article>" + "<p>word, word.</p>" * 20000 + "</article>"
    assert htmltext.extract(long).count("\n") == 19999


NAMED = [
    (f"<div class='entry-header'><h1>Title</h1></div><div class='entry-content'><p>{TEXT}</p><p>{TEXT}</p></div>", f"Title\n{TEXT}\n{TEXT}"),
    (f"<article><p>{TEXT}</p><div class='notice-period'><p>{TEXT}</p></div><div class='cookie-notice'>Accept, all. Now!</div></article>", f"{TEXT}\n{TEXT}"),
    (f"<article><p>{TEXT}</p><div class='ad-container'>{TEXT}</div><ul class='comment-list'><li>{TEXT}</li></ul></article>", TEXT),
    (f"<div class='postHeader'><h1>T</h1></div><p>{TEXT}</p><div class='siteFooter'>{TEXT}</div>", f"T\n{TEXT}"),
]


@pytest.mark.parametrize(("page", "want"), NAMED)
def test_names_of_boilerplate(page, want):
    assert htmltext.extract(page) == want


#: Without article or main elements, flags or one element around the text: the paths alone tell.
BARE = [
    (
        f"<body><div>My Site</div><div><a href=a>One link</a> <a href=b>Two link</a></div><p>{TEXT}</p><p>Short.</p><p>{TEXT}</p><ul><li><a href=x>More</a></ul><div>All rights</div>",
        f"{TEXT}\nShort.\n{TEXT}",
    ),
    (
        f"<body><table><tr><td class=a><a href=1>Home page</a><td class=b><div class=t>{TEXT} {TEXT} {TEXT}</div><div class=t>x</div><td class=c>Left over</table>",
        f"{TEXT} {TEXT} {TEXT}\nx",
    ),
]


@pytest.mark.parametrize(("page", "want"), BARE)
def test_paths_select(page, want, monkeypatch):
    assert htmltext.extract(page) == want
    every = lambda found, share=0, lost=None: {b.path: 1.0 for b in found}
    monkeypatch.setattr(htmltext, "path_weights", every)
    assert htmltext.extract(page) != want


INLINE = [
    (f"<article><p>{TEXT}</p><pre><code><span class='comment'># say it</span>\nprint(1)</code></pre></article>", f"{TEXT}\n# say it print(1)"),
    (f"<article><p>{TEXT}</p><p>In <span class='ad'>AD</span> 79, the town fell.</p></article>", f"{TEXT}\nIn AD 79, the town fell."),
    (f"<article><p>{TEXT}</p><p>Press <button>Go</button> to start.</p><p><button>Buy</button></p></article>", f"{TEXT}\nPress Go to start."),
    (f"<article><p>{TEXT}</p><p><span class='ad'>Cheap things.</span></p><span class='ad'><div>More, of it. All.</div></span><p>End.</p></article>", f"{TEXT}\nEnd."),
    (f"<article><p>{TEXT}</p><p><span class=ad>An unclosed one.</p><p>{TEXT}</p></article>", f"{TEXT}\n{TEXT}"),
    (f"<article><p>{TEXT}</p><p><span class=ad>a <span>b</span> c</span> and d.</p></article>", f"{TEXT}\na b c and d."),
]
ORDINARY = [
    (f"<article><p>{TEXT}</p><p class='search'>The search went on for days, in vain.</p></article>", f"{TEXT}\nThe search went on for days, in vain."),
    (f"<article><p>{TEXT}</p><ul class='menu'><li>Soup</li><li>Fish</li></ul><p>{TEXT}</p></article>", f"{TEXT}\nSoup\nFish\n{TEXT}"),
    (f"<article><p>{TEXT}</p><ul class='menu'><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></article>", TEXT),
    (f"<article><p>{TEXT}</p><div class='quote-banner'>To be, or not.</div></article>", f"{TEXT}\nTo be, or not."),
    (f"<article><p>{TEXT}</p><div class='search'>Find it <input></div></article>", TEXT),
    (f"<div class='banner'>Big, cheap. Now!</div><p>{TEXT}</p><p>{TEXT}</p>", f"{TEXT}\n{TEXT}"),
]
OTHERS = [
    (f"<article><p>{TEXT}</p><p>{TEXT}</p></article><article class='teaser'><h2>Other</h2><p>Read on.</p></article>", f"{TEXT}\n{TEXT}"),
    (f"<main><article class='post'><p>{TEXT}</p></article><article class='post'><p>Two, too.</p></article></main>", f"{TEXT}\nTwo, too."),
    (f"<article><p>{TEXT} {TEXT}</p><div><article><p>{TEXT}</p></article></div></article>", f"{TEXT} {TEXT}"),
    (f"<article><p>{TEXT}</p></article><section id='user-responses'><p>{TEXT}</p><p>{TEXT}</p></section>", TEXT),
    (f"<article><p>{TEXT}</p><div class='reader-feedback'><p>{TEXT}</p></div></article>", TEXT),
    (f"<div class=c><p>{TEXT}</p><p>{TEXT}</p></div><div class='responses'><p>Nice, this. I like it.</p></div>", f"{TEXT}\n{TEXT}"),
]


@pytest.mark.parametrize(("page", "want"), INLINE + ORDINARY + OTHERS)
def test_names_are_one_feature(page, want):
    assert htmltext.extract(page) == want


def test_weights_decide_in_articles(monkeypatch):
    """Without weights what is named as boilerplate stays, also around an article."""
    page = f"<nav><a href=x>Home</a></nav><div class='ad'>Buy, now.</div><article><h1>T</h1><p>{TEXT}</p><p>x</p><div class='ad'>And this.</div></article><footer>me</footer>"
    assert htmltext.extract(page) == f"T\n{TEXT}\nx"
    monkeypatch.setattr(htmltext, "path_weights", lambda found, share=0, lost=None: {b.path: 1.0 for b in found})
    assert htmltext.extract(page) != f"T\n{TEXT}\nx"


class Plain(HTMLParser):
    """Blocks with their paths, for pages whose elements are all closed; an independent reading."""

    def __init__(self):
        super().__init__()
        self.open, self.out, self.link, self.n = [], [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link += 1
        else:
            self.n += 1
            self.open.append((tag + "".join("." + v for k, v in attrs if k == "class"), self.n))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link -= 1
        else:
            self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.out.append((tuple(t for t, _ in self.open), " ".join(data.split()), self.link > 0, tuple(self.open)))


def brute(page):
    """The method by its definition: ratios by path, smoothed, fused, held against the mean."""
    reader = Plain()
    reader.feed(page)
    paths = list(dict.fromkeys(p for p, *_ in reader.out))
    own, marks = [], []
    for p in paths:
        texts = [(t, linked) for q, t, linked, _ in reader.out if q == p]
        own.append(sum(0 if linked else len(t) for t, linked in texts) / len(texts))
        marks.append(sum(0 if linked else sum(c in ".,;:!?" for c in t) for t, linked in texts) / len(texts))
    smooth = lambda x: [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) / 4 for i in range(len(x))]
    weight = [math.sqrt(a * b * (1 + c)) for a, b, c in zip(own, smooth(own), smooth(marks))]
    good = {p for p, w in zip(paths, weight) if w >= 0.75 * sum(weight) / len(weight)}
    where = [i for i, (p, *_) in enumerate(reader.out) if p in good]
    shared = os.path.commonprefix([reader.out[i][3] for i in where])
    if len(shared) < 2:
        return [t for i, (p, t, linked, _) in enumerate(reader.out) if p in good or (where[0] < i < where[-1] and not linked)]
    return [t for _, t, _, at in reader.out if at[: len(shared)] == shared]


def test_against_brute_force():
    rng = random.Random(4)
    words = lambda n: " ".join("word" + rng.choice(["", ",", "", ".", ""]) for _ in range(n))
    for _ in range(300):
        parts = []
        for i in range(rng.randint(1, 5)):
            inner = "".join(f"<p>{words(rng.randint(1, 60))}</p>" if rng.random() < 0.7 else f"<p><a>{words(3)}</a></p>" for _ in range(rng.randint(1, 5)))
            parts.append(rng.choice([f"<div class='c{i}'>{inner}</div>", f"<section class='s{i}'>{words(2)}</section>", f"<p>{words(rng.randint(1, 30))}</p>"]))
        page = f"<body>{''.join(parts)}</body>"
        assert htmltext.extract(page).split("\n") == brute(page), page


HOSTILE = ["<a '", '<div class="', "<div>", "<p>x<blockquote>", "<div class=ad>", "<li>", "<h2>a</h2>", "<!-- ", "<u class=ad><b class=ad></u>", "a ", "<"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_reading_is_linear(piece):
    start = time.process_time()
    htmltext.extract(f"<div {piece * 40000}>" if piece == "a " else piece * 40000)
    assert time.process_time() - start < 15


def test_edges_of_the_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, __html long"
    df = spark.createDataFrame([(1, None, f"<p>{TEXT}", "clash", 7, 3), (1, "u", f"<p>{TEXT}", None, None, None), (2, "u", "", "x", 1, 1)], schema)
    got = sorted((r["page_id"], r["n_chars"]) for r in htmltext.extract_text(df).collect())
    assert got == [(1, len(TEXT)), (1, len(TEXT)), (2, 0)]
