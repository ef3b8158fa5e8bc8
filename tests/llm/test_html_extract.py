"""Main text of pages built from known parts, and template counts against brute force."""

import random
import time

import pytest

from horizonspark.llm import html_extract
from horizonspark.llm.html_extract import extract_main_text, main_text, parse, site_templates, subtree_hashes

BOX = '<section class="box"><h3>Our paper</h3><p>Support us today.</p></section>'


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div>{body}{extra}<footer>&copy; site</footer></body></html>'


def text(h):
    return main_text(parse(h), set())


def test_article():
    assert text(page("<article><h1>Title &amp; more</h1><p><b>One<br><p>two\n  three&nbsp;four</p></article>")) == "Title & more One two three four"
    assert text(page("<article>in<b>li</b>ne<div>block</div>tail</article>")) == "inline block tail"
    assert text(page('<main><header><h1>Page</h1></header><p>Body</p><aside>side</aside><form>f<input></form><div id="comments"><article>no</article></div></main>')) == "Page Body"
    assert text("<article><p>never closed &lt;tag&gt; 3 < 4") == "never closed <tag> 3 < 4"
    assert text(page("<article><p>a</p></article><article><p>b</p></article>")) == "a b"
    assert text(page("<p>x</p><ul><li><a>m</a></li></ul><ul><li>kept</li></ul>")) == "x kept"
    assert text("") == text("<p") == text("</p></div>") == text("<script>x") == ""
    assert text('<div hidden>h</div><div role="navigation">n</div><p data-x="a>b">y</p>') == "y"
    assert text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert text("plain words") == "plain words"


def test_templates_and_odd_rows(spark):
    r = random.Random(3)
    words = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(999)) for _ in range(12))
    rows, want = [], {}
    for i in range(40):
        t = words()
        rows.append((i, f"https://A.example.com:80/{i}", page(f"<div><p>{t}</p></div>", BOX), "x", "y"))
        want[i] = t
    for i in range(40, 44):  # too few pages to tell
        t = words()
        rows.append((i, f"http://b.example.com/{i}", page(f"<p>{t}</p>", BOX), "x", "y"))
        want[i] = f"{t} Our paper Support us today."
    odd = [(50, None, None), (51, "not a url", ""), (52, "http://A.example.com/", "<article>" + "long words " * 100_000 + "</article>"), (52, "http://A.example.com/", "<p>again</p>"), (None, "http://A.example.com/", "<p>no id</p>")]
    rows += [(*o, None, None) for o in odd]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, main_text string, _host string").repartition(3)
    out = extract_main_text(pages).collect()
    assert len(out) == len(rows)
    for x in out:
        if x["page_id"] in want:
            assert x["main_text"] == want[x["page_id"]]
    assert sorted(x["main_text"][:20] for x in out if x["page_id"] not in want) == sorted(["", "", "long words long word", "again", "no id"])
    assert extract_main_text(pages.limit(0)).count() == 0
    got = {x["host"]: set(x["subtrees"]) for x in site_templates(pages).collect()}
    mine = [set(subtree_hashes(parse(h))) for _, u, h, *_ in rows if u and "A.example" in u]
    counted = {h for h in set().union(*mine) if sum(h in m for m in mine) >= max(8, 0.3 * len(mine))}
    assert got == {"a.example.com": counted}


def test_notices_and_copies_in_articles(spark):
    r = random.Random(4)
    words = lambda n=30: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(999)) for _ in range(n))
    notices = ["Subscribe to our newsletter for more", "Our offices are open every day"]
    rows, want = [], {}

    def add(host, path, body, text):
        want[len(rows)] = text
        rows.append((len(rows), f"http://{host}/{path}", page(f"<article>{body}</article>")))

    for i in range(30):  # notices in different articles
        a, b = words(), words()
        add("n.example.com", i, f"<p>{a}</p><p>{notices[0]}</p><p>{b}</p><p>{notices[1]}</p>", f"{a} {b}")
    copy = [words() for _ in range(4)]
    for i in range(30):  # copies of one article, half of them with an edited paragraph
        some = [*copy]
        if i % 2:
            w = some[i % 4].split()
            w[i % 30] = f"edit{i}"
            some[i % 4] = " ".join(w)
        add("c.example.com", i, "".join(f"<p>{p}</p>" for p in some), " ".join(some))
    for i in range(60):  # a box of one small section of a large host
        a = words()
        box = "<div><p>Only in this section</p></div>" if i < 12 else ""
        add("s.example.com", f"{'small' if i < 12 else 'large'}/{i}", f"<p>{a}</p>{box}", a)
    got = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    assert {x["page_id"]: x["main_text"] for x in got} == want


A = "The long text of the article goes on here with a good many words."


@pytest.mark.parametrize(
    ("h", "want"),
    [
        (f'<nav>menu</nav><div class="layout has-sidebar">{A}</div><footer>foot</footer>', A),
        (f'<div id="search-results-page" class="content">{A}</div>', A),
        (f'<div class="post no-comments">{A}</div>', A),
        (f'<body><form id="aspnetForm"><input value="x"><nav>menu</nav><div>{A}</div><footer>foot</footer></form></body>', A),
        (f'<article><p>{A}</p><p class="notice">Prose with a class.</p><p class="ad">Buy</p></article>', A + " Prose with a class."),
        (f"<main><h1>Head</h1><article><p>{A}</p></article></main>", "Head " + A),
        (f"<body><h1>Head</h1><article><p>{A}</p></article></body>", "Head " + A),
        (f'<div class="content notice">{A}</div>', A),
        (f'<main><p>{A}</p><article class="card">teaser</article></main>', A + " teaser"),
        (f'<main><p>{A}</p><section id="comments"><article>{A} {A}</article></section></main>', A),
        (f'<div><p>{A}</p><form>Name <input></form><div class="widget">w</div></div>', A),
        ('<nav>menu</nav><div class="ad">Buy</div>', ""),
        ("<p don't>a</p><p>isn't</p>", "a isn't"),
        ('<a href="x>text</a> more', "text more"),
    ],
)
def test_classes_are_hints(h, want):
    assert text(h) == want


def test_parsing_is_linear():
    n = 20_000
    for h in ("<b>" * n, "<div>" * n + "</p>" * n, "<b " * n, "<td>" + "<b>" * n + "</p>" * n, "<ul><li>" * n + "x", '<a href="' * n, "<div>" * n + "</span>" * n, "<form>" * n + "x"):
        started = time.process_time()
        text(h)
        assert time.process_time() - started < 1.5


def test_shuffled_templates_and_copied_pages(spark, monkeypatch):
    """The join by a shuffle, with large sections dealt to several tasks, gives what the broadcast gives; copies of a page without an article stay."""
    r = random.Random(6)
    words = lambda n=30: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(999)) for _ in range(n))
    copied, rows, want = words(), [], {}
    for i in range(60):
        host, t = f"h{i % 2}.example.com", words() if i % 3 else copied
        want[i] = t
        rows.append((i, f"http://{host}/{'a' if i % 4 < 2 else 'b'}/{i}", page(f"<div><div>{t}</div></div>", BOX)))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    monkeypatch.setattr(html_extract, "PAGES_A_TASK", 4)
    for limit in (10**6, 0):
        assert {x["page_id"]: x["main_text"] for x in extract_main_text(pages, broadcast_hashes=limit).collect()} == want
