import itertools
import random
import re

from pyspark.sql import functions as F

from seamark.llm import html_extract as h

RICH = """<!doctype html><html><head><title>T</title><script>if (a<b) x="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav>
<div id="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article class="post"><header><h1>The &eacute;t&eacute;</h1></header><p>One <b>bold</b>&nbsp;word &amp;lt; here.<br>Next
line<p>Two<ul><li>a<li>b</ul><div class="newsletter-box">Subscribe now</div><aside>Also</aside><form>Mail <input></form>
<figure><img src=x alt="no"><figcaption>Cap</figcaption></figure><span class="ad">inline ad</span><p hidden>never</p>
<section class="comments"><article class="comment"><p>First!</p></article></section><p>Last 3 < 4</p><footer>By me</footer></article>
<div class="sidebar"><p>Side</p></div><p>outside</p><footer>&copy; all</footer></body></html>"""


def text(page):
    return "\n".join(t for t, kind in h.blocks(page) if kind == h.MAIN)


def test_blocks():
    assert text(RICH) == "The été\nOne bold word &lt; here. Next line\nTwo\na\nb\nCap\nLast 3 < 4"
    assert text("<nav>Menu<article><p>x</article>") == "x"
    assert text("<main><p>a<p>b</main><p>c") == "a\nb"
    assert h.blocks(None) == h.blocks("") == []
    assert h.blocks("plain &amp; simple") == [("plain & simple", h.OPEN)]
    assert h.blocks("<article>a</article>b") == [("a", h.MAIN), ("b", h.NAMED)]
    assert text("<article><p title=\"a>b\">ok<!-- no <p>x</p> --> yes</article>") == "ok yes"
    assert text("<article><p>cut <scr") == "cut <scr"
    assert text('<div class="page with-sidebar"><div id="sidebar">S</div><div class="entry-content"><p>e</p></div></div>') == "e"
    assert h.blocks('<div class="post-header">H</div><div class="header">X</div>') == [("H", h.OPEN), ("X", h.NAMED)]
    assert text('<article>a<div class="no-print sidebar">b</div><div class="has-ads">c</div></article>') == "a\nc"
    assert h.blocks('<article>a<p class="tags">b<p class="ad">c</article>') == [("a", h.MAIN), ("b", h.OPEN), ("c", h.NAMED)]


def test_names_among_other_words_and_headlines():
    page = '<article><p class="ad-hoc">a<p class="login-history">b<p class="ad-slot">c<div class="post-comments">d</div></article>'
    assert h.blocks(page) == [("a", h.OPEN), ("b", h.OPEN), ("c", h.NAMED), ("d", h.NAMED)]
    page = "<h1>Title</h1><p>Lead.</p><div>by line</div><article>text</article><ul><li>Link</ul>"
    assert h.blocks(page) == [("Title", h.OPEN), ("Lead.", h.OPEN), ("by line", h.NAMED), ("text", h.MAIN), ("Link", h.NAMED)]


def test_array_decides_what_structure_leaves_open(spark):
    """A unique headline above the article stays, a line that the host repeats there goes: the texts differ without the array."""
    said = "Welcome to the best place for all of your daily reading"
    pages = [(i, f"http://x.org/{i}", f"<h1>Headline {i} of its own</h1><p>{said}</p><article><p>Body {i} stands here.</p><p class='ad-hoc'>Ad hoc unions {i} met.</p></article>") for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert got == {i: f"Headline {i} of its own\nBody {i} stands here.\nAd hoc unions {i} met." for i in range(4)}
    alone = h.extract(df.limit(1)).first()
    assert said in alone.text  # with no other page nothing repeats


def plain(rows):
    """The whole output, page by page, by comparing every place of a stream with every place of the host's other pages."""
    pages = []
    for page_id, url, page in rows:
        found = h.blocks(page)
        tokens = [t for x, kind in found if kind != h.MAIN for t in x.split(" ")]
        host = re.match(r"[a-z]+://([^/]*)", (url or "").lower())
        pages.append((page_id, url, found, tokens, host[1] if host else ""))
    n = h.MIN_TOKENS
    out = []
    for page_id, url, found, tokens, host in pages:
        hit = set()
        for i in range(len(tokens) - n + 1):
            for other_id, other_url, _, others, other_host in pages:
                if host == other_host and (page_id, url) != (other_id, other_url) and any(others[j : j + n] == tokens[i : i + n] for j in range(len(others) - n + 1)):
                    hit.update(range(i, i + n))
                    break
        at, kept, open_ = 0, [], []
        for x, kind in found:
            if kind == h.MAIN:
                kept.append(x)
                continue
            own = x.split(" ")
            flags = [at + i in hit for i in range(len(own))]
            at += len(own)
            if kind == h.OPEN:
                open_.append(x)
                if sum(flags) < h.MOST * len(own):
                    runs = [(k, [t for _, t in g]) for k, g in itertools.groupby(zip(flags, own, strict=True), key=lambda p: p[0])]
                    if any(k and len(r) >= h.LONG for k, r in runs):
                        parts = [[]]
                        for k, r in runs:
                            if k and len(r) >= h.LONG:
                                parts.append([])
                            else:
                                parts[-1] += r
                        kept += [" ".join(p) for p in parts if len(p) >= n]
                    else:
                        kept.append(x)
        out.append((page_id, url, "\n".join(kept or open_)))
    return out


def test_the_array_decides(spark):
    """Pages without articles and classes that no list has, on a large host, a small one, and in articles; against brute force."""
    rnd = random.Random(3)
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    menu, tail = "<div class=q1>Start page</div><div class=q2>Our shop today</div><div>Write to us</div>", "<p class=zz>All of this was made by hand in our town on {} for you and your friends from near and far</p>"
    rows = []
    for i in range(8):
        rows.append((i, "http://Host.example/a", f"<body>{menu}<div>{words(i, 30)}</div><p>Short {i}</p>{tail.format(f'day {i}')}</body>"))
    shared = " ".join(f"s{j}" for j in range(25))
    rows += [(10, "http://other.example/", rows[3][2]), (11, "https://copy.example/1", rows[5][2]), (12, "https://copy.example/2", rows[5][2])]
    rows += [(30, "http://mix.example/1", f"<p>{words(30, 9)} {shared} {words(31, 3)}</p>"), (31, "http://mix.example/2", f"<p>{words(32, 7)} {shared} {words(33, 8)}<p>own one")]
    # In articles: passages that pages share stay, named blocks go where they repeat; adverts go always.
    for i in range(3):
        own = "Only this page has such a sentence of its article" if i == 2 else "Tagged with old news and other things of our town"
        rows.append((40 + i, f"http://art.example/{i}", f'<nav>n</nav><article><p>{shared}<p class="tags">{own}</p><p>{words(40 + i, 5)}</article><div class="ad">Buy{i} a b c d e f</div>'))
    rows += [(20, None, None), (21, "x", ""), (None, None, RICH), (20, None, None), (41, "http://art.example/1", rows[-2][2])]
    for i in range(60):
        parts = [" ".join(f"b{k}t{j}" for j in range(3 + k * 3)) + ("" if rnd.random() < 0.6 else f" own{i}") for k in (rnd.randrange(12) for _ in range(rnd.randint(1, 8)))]
        rows.append((100 + i, f"http://r{i % 3}.example/{i}", "".join(f"<div class={rnd.choice(('a', 'b', 'tags'))}>{p}</div>" for p in parts)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "text", "k1", "page", "places")})
    got = h.extract(df).collect()
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(repr, plain(rows)))
    assert all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    for i in range(8):
        assert by[i].text == f"{words(i, 30)}\nShort {i}" and by[i].n_repeated == 4
    assert by[10].text.startswith("Start page\nOur shop") and by[11].text == by[12].text == by[10].text.replace("w3x", "w5x").replace("Short 3", "Short 5").replace("day 3", "day 5")
    assert by[30].text == words(30, 9) and by[31].text == f"{words(32, 7)}\n{words(33, 8)}\nown one"
    assert by[40].text == f"{shared}\n{words(40, 5)}" and by[42].text == f"{shared}\nOnly this page has such a sentence of its article\n{words(42, 5)}"
    assert by[20].text == by[21].text == "" and by[None].text == text(RICH)
    assert h.extract(df.limit(0)).count() == 0


def test_a_long_page(spark):
    page = "<article>" + "<p>one two</p>" * 100_000 + "</article><div class=x>" + "tail words " * 20_000 + "</div>"
    r = h.extract(spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", page)], "page_id long, url string, html string")).collect()
    assert [x.n_chars for x in r] == [100_000 * 8 - 1] * 2 and [x.n_repeated for x in r] == [1, 1]


def test_the_whole_page_is_in_the_array(spark, monkeypatch):
    """A teaser in an article goes if it is another page's article, and stays if it isn't; a copy without article element stays whole."""
    said = [" ".join(f"a{i}x{j}" for j in range(12)) for i in range(4)]
    tease = lambda i, t: f"<article><h1>Own {i}</h1><p>{said[i]}</p><div class='related'>{t}</div></article>"
    pages = [tease(0, said[1]), tease(1, "Nobody else says a word of this one"), tease(2, said[2]), f"<div>Print {said[3]}</div><p>{said[0]}</p><div>Nothing else is here</div>", tease(3, said[0])]
    rows = [(i, f"http://t.org/{i}", p) for i, p in enumerate(pages)] + [(9, "http://other.org/", tease(0, said[1]))]
    assert h.stream(h.blocks(pages[0])) == (said[1].split(), list(range(7)), list(range(7)), ["Own", "0", *said[0].split()])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    monkeypatch.setattr(h, "SLOTS", 64)  # suffixes that share a remainder change nothing
    assert {r.page_id: r.text for r in h.extract(df).collect()} == got
    assert got[0] == f"Own 0\n{said[0]}" and got[4].startswith("Own 3") and said[0] not in got[4]
    assert got[1].endswith("of this one") and got[2] == f"Own 2\n{said[2]}\n{said[2]}"
    assert got[3].startswith(f"Print {said[3]}\n")
    assert got[9] == f"Own 0\n{said[0]}\n{said[1]}"
