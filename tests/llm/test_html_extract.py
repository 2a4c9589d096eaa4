import math
import random
import time

from riskloom.llm.html_extract import clusters, extract, lines, main_text, smooth

ARTICLE = "A first paragraph with a fair number of words, so that its ratio is high enough."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href="/">Site name</a><p>Slogan of the site</p></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work for you and others.</div><div class="ad">Buy this product now, it is very good and cheap.</div>
<article><h1>Title &amp; more</h1><p><b>{ARTICLE}<br><p>Short.</p><p>Second   paragraph\n with <i>inline</i> m&eacute;dia&#33; and <a href=x>a link</a> inside.</p><aside>Related things to read elsewhere on this site</aside>
<form><label>Name</label><input><button>Send</button></form><div id="comments"><p>A reader comment that is as long as a paragraph of the article itself.</p></div></article>
<div class="sidebar"><p>Side text that is long enough to look like a paragraph of an article.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "\n\n".join(["Title & more", ARTICLE, "Short.", "Second paragraph with inline média! and a link inside."])


def test_page_without_article_element():
    body = "".join(f"<p>Paragraph {k} has enough words in it to be taken for the text of the page.</p>" for k in range(5))
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div class=content><h2>Head</h2>{body}<p>End.</p></div><div><a href=3>More</a></div></body>"
    got = main_text(page).split("\n\n")
    assert got[0] == "Head" and got[-1] == "End." and len(got) == 7


LONG = "".join(f"<p>Paragraph {k} has enough words in it to be taken for the text of the page.</p>" for k in range(9))


def test_all_lines_of_all_containers():
    parts = lambda html: [t for t in main_text(html).split("\n\n") if not t.startswith("Paragraph")]
    assert parts(f"<body><article>{LONG}</article><article><p>A short one.</p></article></body>") == ["A short one."]
    assert parts(f"<main><h1>Title</h1><p>The lead.</p><article>{LONG}</article><p>The end.</p></main>") == ["Title", "The lead.", "The end."]
    assert parts(f"<body><h1>Title</h1><div>Site</div><article>{LONG}</article></body>") == ["Title"]
    assert len(main_text(f"<body><div>{LONG}</div><article><p>Teaser.</p></article></body>").split("\n\n")) == 10


def test_root_holds_headings_and_all_clusters():
    parts = lambda html: [t for t in main_text(html).split("\n\n") if not t.startswith("Paragraph")]
    assert parts(f"<body><div><h1>Title</h1><div class=body>{LONG}</div></div><div><a href=1>Home</a></div></body>") == ["Title"]
    assert parts(f"<body><div>Slogan</div><div><a href=1>Home</a></div><div>{LONG}<p>End.</p></div><div>Small print</div></body>") == ["End."]
    late = "A late section of its own with a sentence that is long enough to be a cluster."
    assert parts(f"<body><div><div>{LONG * 3}</div><div><p>{late}</p></div></div></body>") == [late]
    assert parts(f"<body><div><ul><li><a href=1>Menu</a></ul>{LONG}<p><a href=2>A paragraph that is all link.</a></p></div></body>") == ["A paragraph that is all link."]


def test_defined_results():
    assert main_text(None) == main_text("") == main_text("<nav>only a menu</nav>") == ""
    assert main_text("<article><p>cut off in a tag<p>next</p><scr") == "cut off in a tag\n\nnext"
    assert main_text("<article><p>an entity &am") == "an entity &am"
    assert main_text("<article>" + "<p>words of a long page</p>" * 20_000).count("\n\n") == 19_999
    assert main_text("plain text without markup") == "plain text without markup"
    assert main_text("<article><!-- hidden --><p hidden>no</p><p style='display:none'>no</p><p>yes</p></article>") == "yes"


def test_smoothing_and_clusters():
    assert smooth([5.0] * 9) == [5.0] * 9 and smooth([]) == []
    kernel = [math.exp(-k * k / 2) for k in (-2, -1, 0, 1, 2)]
    assert abs(smooth([0, 0, 0, 1, 0, 0, 0])[3] - kernel[2] / sum(kernel)) < 1e-12
    assert clusters([1, 1, 1, 90, 95, 90, 1, 1, 1])[4] and not clusters([1, 1, 1, 90, 95, 90, 1, 1, 1])[0] and clusters([]) == []
    assert [x.text() for x in lines("<ul><li>a<li>b</ul>c")] == ["a", "b", "c"]


def test_frames(spark):
    from riskloom.llm.common import ship

    ship(spark)
    rows = [(1, "u1", PAGE, "clash", "clash"), (2, None, None, None, None), (3, "u3", "", "x", "x"), (1, "u1", PAGE, "clash", "clash"), (None, "u4", "<p>t</p>", "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted([(i, u, main_text(h), len(main_text(h))) for i, u, h, *_ in rows], key=str)
    assert extract(pages.limit(0)).count() == 0


PROSE = "".join(f"<p>A long paragraph, number {k}, about many things that happen in the world every day.</p>" for k in range(5))


def test_ambiguous_names_are_left_to_the_ratios():
    parts = lambda inner: [t for t in main_text(f"<article>{PROSE}{inner}{PROSE}</article>").split("\n\n") if not t.startswith("A long")]
    for name in ("legal", "tags", "search", "follow", "alert", "discussion", "commercial", "related"):
        assert parts(f'<div class="{name}">The {name} history of the case is long and well known to all.</div>') == [f"The {name} history of the case is long and well known to all."]
        assert parts(f'<div class="{name}"><a href=1>one</a> <a href=2>two</a></div>') == []
    assert parts("<ul><li><a href=1>Another story</a><li><a href=2>And one more</a></ul>") == []
    assert parts('<div class="cookie-notice">We use cookies to make this site work for you and for others.</div>') == []
    assert parts("<p><a href=1>A paragraph that is all link.</a></p><h2>Head</h2><p>x</p>") == ["A paragraph that is all link.", "Head", "x"]


def test_lines_equal_a_plain_computation():
    """Ratios, smoothing, threshold and choice on pages of one article, from the definition."""
    rng = random.Random(8)
    for _ in range(60):
        kinds, html = [], ""
        for k in range(rng.randrange(1, 30)):
            text = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 25)))
            kind = rng.choice(["p", "menu", "tags"])
            html += {"p": f"<p>{text}</p>", "menu": f"<div><a href=x>{text}</a></div>", "tags": f'<div class="tags">{text}</div>'}[kind]
            kinds.append((kind, text))
        # a line's tags are those since the line before: its own start, the links' starts and ends, and the end in front of it
        tags = [(3 if kind == "menu" else 1) + (1 if k else 2) - (0 if k else 1) for k, (kind, _) in enumerate(kinds)]
        found = lines(f"<article>{html}</article>")
        assert [x.text() for x in found] == [t for _, t in kinds]
        ratios = [0 if kind == "menu" else len(t) / x.tags for (kind, t), x in zip(kinds, found)]
        assert all(abs(x.tags - n) <= 1 for x, n in zip(found, tags))
        w = [math.exp(-d * d / 2) for d in range(3)]
        flat = []
        for i in range(len(ratios)):
            near = [(w[abs(d)], ratios[i + d]) for d in (-2, -1, 0, 1, 2) if 0 <= i + d < len(ratios)]
            flat.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
        mean = sum(flat) / len(flat)
        limit = math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat))
        expected = [t for (kind, t), v, r in zip(kinds, flat, ratios) if kind == "p" or (v >= limit and r >= limit)]
        assert main_text(f"<article>{html}</article>") == "\n\n".join(expected)


def test_time_is_in_proportion_to_the_page():
    for page in ("<div>" * 100_000 + "deep", "<div>text " * 50_000, "<p>" + "<b>" * 50_000 + "<p>x" * 20_000, "<li>" + "<div>" * 50_000 + "<ul><li>x</li></ul>" * 20_000, "<a href=1><p>x" * 20_000):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 10
    assert main_text("5 is more than <") == "5 is more than <" and main_text("<p>a<b>b</b>c</p>") == "abc"
