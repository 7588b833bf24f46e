import random
import time

import pytest

from polysem.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li>Menu two</li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this now</div>
<article><h1>Head &amp; title</h1><p><b>First</b>  part&nbsp;of
the text.<br><p>Second &lt;part&gt; here, long enough to be the text of a page, as any paragraph should be.</p><p>x</p></article>
<aside>More to read</aside><footer>&copy; someone</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "Head & title\nFirst part of the text.\nSecond <part> here, long enough to be the text of a page, as any paragraph should be.\nx"),
        (None, ""), ("", ""), ("plain", "plain"), ("<p>1 < 2 &amp; 3 > 2</p>", "1 < 2 & 3 > 2"), ("<nav>only a menu</nav>", ""),
        ("<article><p>a</p><aside>s</aside><p>tail</p><div class='ad'>buy</div><p>end</p></article>", "a\ntail\nend"),
        ("<main><p>kept<section id=comments><p>Nice post</p></section></main>", "kept"),
        ("<p>one<p>two<ul><li>three<li>four</ul>", "one\ntwo\nthree\nfour"),
        ("<article><p>" + "w " * 100 + "</p><form>Name<input></form><p>z</p></article>", ("w " * 100).strip() + "\nz"),
        ("<p>open <b>bold", "open bold"), ("<p title='a>b'>quoted</p>", "quoted"), ("<p title='a>open quote</p>", "open quote"),
        ("<article>a<table><tr><td>b</td><td>c</td></tr></table></article>", "a\nb\nc"),
        ("<script>x", ""), ("<!-- never closed <p>x", ""),
    ],
)
def test_pages(page, text):
    assert extract.main_text(page) == text


def test_page_without_article():
    body = "".join(f"<p>Paragraph {i} of the story has a number of words in it and goes on.</p>" for i in range(9))
    page = (
        "<body><header><h1>Site name</h1></header><div id='cookie-notice'>We use cookies</div><div class='content'><h1>Story</h1>"
        f"{body}</div><div class='comments'><p>{'I liked it very much. ' * 9}</p></div><div>tiny</div><footer>Imprint</footer></body>"
    )
    text = extract.main_text(page).split("\n")
    assert text[0] == "Story" and text[1:10] == [f"Paragraph {i} of the story has a number of words in it and goes on." for i in range(9)]
    assert not {"Site name", "We use cookies", "Imprint"} & set(text) and not any("liked" in x for x in text)


def test_nested_blocks_are_no_gaps():
    """Pages without article: rows, titles and paragraphs in elements of their own stay."""
    long = "A paragraph of the story that has a good number of words in it and goes on for a while, as they do."
    table = "<table><tbody>" + "".join(f"<tr><td>k{i}</td><td>v{i}</td></tr>" for i in range(4)) + "</tbody></table>"
    page = (
        f"<body><div class='x'><div><div><h1>Title</h1></div></div><div><div><p>{long}</p></div></div><div><div><p>Short.</p></div></div>"
        f"<div><div><p>{long}</p></div></div>{table}</div><nav>Menu</nav><div>tiny</div></body>"
    )
    rows = [x for i in range(4) for x in (f"k{i}", f"v{i}")]
    assert extract.main_text(page).split("\n") == ["Title", long, "Short.", long, *rows]


@pytest.mark.parametrize("name", ["site has-sidebar", "content-sidebar-wrap", "no-sidebar", "hentry has-comments", "sidebar", "search-results"])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_layout_names_keep_the_article(name, tag):
    if tag == "section" and name == "sidebar":
        return
    page = f"<body><div class='{name}'><div><{tag}><p>The story.</p></{tag}></div></div></body>"
    assert extract.main_text(page) == "The story."


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "site-footer", "related-posts", "widget_text", "x sidebar", "ad-slot-2", "comments-area"])
def test_names_of_boilerplate(name):
    inner = "<article class='comment-body'>Nice</article>" if "comments" in name else "Nice"
    assert extract.main_text(f"<article><p>The story.</p></article><div class='{name}'>{inner}</div>") == "The story."
    assert extract.main_text(f"<article><p>The story.</p><div class='{name}'>{inner}</div></article>") == "The story."


LONG = "A paragraph of the story that has a good number of words in it and goes on for a while, as they do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a teaser is not the article
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><article class='teaser'><h3>Other post</h3><a>Read it</a></article></body>", f"{LONG}\n{LONG}\nOther post\nRead it"),
        # an advert or menu within a container does not end the story
        (f"<body><div><p>{LONG}</p><div class='ad'>Buy</div><p>Short closing.</p></div></body>", f"{LONG}\nShort closing."),
        (f"<body><div><p>{LONG}</p><nav>1 2 3</nav><h2>Part two</h2><p>Short.</p></div></body>", f"{LONG}\nPart two\nShort."),
        (f"<body><div><p>{LONG}</p><div class='ad'>Buy</div></div><div>tiny</div></body>", LONG),
        # a form around the page
        (f"<body><form id='aspnet'><div><p>{LONG}</p><label>Name</label><input><button>Go</button><p>End.</p></div></form></body>", f"{LONG}\nEnd."),
        (f"<body><div><p>{LONG}</p><form>Your name <input> please</form><p>End.</p></div></body>", f"{LONG}\nEnd."),
        (f"<article><form id='f'><p>{LONG}</p><select><option>x</select></form></article>", LONG),
        # a line break is white space
        ("<p>one<br>two<br/>three</p>", "one two three"),
        # tables with adverts between rows
        (f"<body><table><tr><td>{LONG}</td></tr><tr><td class='ad'>Buy</td></tr><tr><td>cell</td></tr></table></body>", f"{LONG}\ncell"),
    ],
)
def test_pages_without_marked_article(page, text):
    assert extract.main_text(page) == text


def plain_stretches(lines, window, threshold):
    """Every window summed anew; stretches of windows with text."""
    n = len(lines) - window + 1
    if n < 1:
        lines, n = lines + [""] * (1 - n), 1
    sums = [sum(len(x) for x in lines[i : i + window]) for i in range(n)]
    least = min(threshold, max(sums) / 2)
    kept, i = [], 0
    while i < n:
        j = i
        while j < n and sums[j]:
            j += 1
        if j > i and any(s >= least for s in sums[i:j]):
            kept += [x for x in lines[i : j if j < n else len(lines)] if x]
        i = j + 1
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_windows_against_plain_version(seed):
    rng = random.Random(seed)
    for _ in range(200):
        lines = ["x" * rng.choice([0, 0, 0, 1, 5, 30, 90, 200]) for _ in range(rng.randint(3, 40))]
        window, threshold = rng.choice([1, 2, 3]), rng.choice([1, 40, 86])
        got = extract.main_lines(lines, False, window, threshold)
        assert got == (plain_stretches(lines, window, threshold) if any(lines) else [])


def test_surge_and_dive():
    lines = ["nav", "", "", "", "a" * 50, "b" * 60, "", "c" * 40, "", "", "", "foot"]
    assert extract.main_lines(lines) == ["a" * 50, "b" * 60, "c" * 40]
    assert extract.main_lines(lines, one_stretch=True) == [x for x in lines if x]
    assert extract.main_lines(["", ""]) == extract.main_lines([]) == []


@pytest.mark.parametrize("part", ["<a ", "<", '<p x="', "<p>", "&", "<!--", "<div class='", "</", "<p x='\">", "<nav>", "a "])
def test_time_follows_length(part):
    start = time.process_time()
    extract.main_text(part * 40_000 + ">")
    assert time.process_time() - start < 5


def test_table(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, None, None), (2, None, None, None, None), (None, "v", "<p>" + "é🙂 " * 20_000, None, None)]
    got = extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r["page_id"], r["url"], r["n_chars"]) for r in got] == [(1, "u", 124), (1, "u", 124), (2, None, 0), (None, "v", 59_999)]
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    assert extract.extract(spark.createDataFrame([], schema)).count() == 0
