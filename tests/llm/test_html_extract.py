import random
import re
import time

from deckloom.llm.html_extract import Block, classify, first_pass, html_extract, main_text
from deckloom.llm.quality import FUNCTION_WORDS

STORY = "The house stood by the river and it was old. " * 6


def test_markup_of_the_page_itself():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t="</p>";</script></head><body>
      <header><a href=/>Home</a> The site of the river</header><nav><ul><li><a href="/a">a</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy the thing now.</div>
      <article><h1>A &amp; B</h1><p>One<b>two</b> <i>three</i><br>four<p>Five&nbsp;six &lt;b&gt; <div class="share-links">Share this</div><p>{STORY}</p><form>Name <input></form>
      <aside>Also read</aside><section id="comments"><p>First! The best of the river and the house.</p></section></article><div class="cookie-notice"><p>We use the cookies</p></div>
      <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == f"A & B Onetwo three four Five six <b> {STORY.strip()}"


def test_pages_without_an_article_element():
    page = f"<body><div><a href=x>One</a> <a href=y>Two</a></div><h1>Title</h1><p>{STORY}</p><p>Short.</p><p>{STORY}</p><div><a href=z>Back to the top of the page</a></div><p>© 2020</p></body>"
    assert main_text(page) == f"Title {STORY.strip()} Short. {STORY.strip()}"


def test_links_of_an_article_stay():
    """Linked headings, lists of linked items and closing links are the article's; a run of short links is a menu."""
    page = f"""<article><h1><a href=a>Head of it</a></h1><p>{STORY}</p><h2><a href="#x">How it was found</a></h2><p>{STORY}</p><ul><li><a href=b>The first source</a></li><li><a href=c>The second source</a></li>
      <li><a href=d>The third source</a></li></ul><div><a href=e>Home</a></div><div><a href=f>About us</a></div><div><a href=g>Contact</a></div><p><a href=h>Download the data</a></p></article>"""
    assert main_text(page) == f"Head of it {STORY.strip()} How it was found {STORY.strip()} The first source The second source The third source Download the data"
    assert main_text(f"<h1><a href=a>Head of it</a></h1><p>{STORY}</p>") == f"Head of it {STORY.strip()}"


def test_comments_and_notices_go_by_name():
    names = ("user-comments", "reader-comments", "comment-thread", "comment-content", "userComments", "discussion", "responses", "feedback", "cookie-message", "gdpr-text", "privacy-consent", "promo-text", "sponsored-content", "cookie_law_info")
    other = STORY.replace("house", "boat")
    for name in names:
        part = f'<div class="{name}"><p>{other}</p></div>'
        for page in (f"<article><p>{STORY}</p>{part}</article>", f"<article><p>{STORY}</p></article>{part}", f"{part}<p>{STORY}</p>"):
            assert main_text(page) == STORY.strip(), (name, page[:60])
    for name in ("no-comments", "has-promo", "with-cookie-bar", "comments-open", "recommended-reading-of-the-week"):
        assert main_text(f'<div class="{name}"><p>{STORY}</p></div>') == STORY.strip(), name
    assert main_text(f'<div class="promo"><article><p>{STORY}</p></article></div>') == STORY.strip()
    assert main_text(f'<article><section id="discussion"><p>{STORY}</p></section></article>') == STORY.strip()
    # Beside a marked article prose comes in only if no element of a name of its own is around it.
    assert main_text(f'<div class="page"><p>{other}</p><article><p>{STORY}</p></article><div class="privacy-banner-text"><p>{other}</p></div></div>') == f"{other.strip()} {STORY.strip()}"


def test_unclosed_and_broken():
    assert main_text("<article><p>One <b>two<br><p>three</article><footer>x") == "One two three"
    assert main_text("<p class='notice'>Old page<p>" + STORY) == STORY.strip()
    assert main_text("a < b and <3 of the") == "a < b and <3 of the"
    assert main_text("<article>x <!-- open") == "x" and main_text("<script>only") == "" and main_text("<") == "<"
    assert main_text("<article><div><div class=menu><div>m</div></div>text</div></article>") == "text"


def test_long_page():
    assert main_text("<article>" + "<p>word word</p>" * 50000 + "</article>") == " ".join(["word word"] * 50000)
    assert main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_names_of_wrappers_do_not_empty_a_page():
    for page in (f'<div class="content no-sidebar"><p>{STORY}</p></div>', f'<div class="layout with-sidebar"><article><p>{STORY}</p></article></div>', f'<article class="post tags-news"><p>{STORY}</p></article>',
                 f'<div class="sidebar"><article><p>{STORY}</p></article></div>', f'<div id="widget"><p>{STORY}</p></div>', f'<p title="the hidden cost">{STORY}</p>', f'<article class="ad"><p>{STORY}</p></article>'):
        assert main_text(page) == STORY.strip(), page
    assert main_text(f'<p>{STORY}</p><div class="ad-box">{STORY}</div><div hidden>{STORY}</div><p style="display: none">{STORY}</p><ul class="related-posts"><li>{STORY}</ul>') == STORY.strip()
    assert main_text(f"<article><header><h1>Head</h1><p>By me</p></header><p>{STORY}</p><p>© 2020 is a year</p></article>") == f"Head {STORY.strip()} © 2020 is a year"


def brute(rows):
    """The two passes by their words: rows are (text, characters in links, in the article element)."""
    marked = any(main for *_, main in rows)
    article = [i for i, r in enumerate(rows) if r[2]]
    tiny = [rows[i][1] > 0.8 * len(rows[i][0]) and len(rows[i][0].split()) <= 2 for i in article]
    menu = {i for at, i in enumerate(article) if any(lo <= at < lo + 3 and all(tiny[lo : lo + 3]) for lo in range(len(tiny) - 2))}
    labels = []
    for k, (text, links, main) in enumerate(rows):
        words = text.lower().split()
        stops = sum(w.strip(".,;:!?\"'()") in FUNCTION_WORDS for w in words) / len(words)
        if links > 0.8 * len(text) and len(words) <= 12:
            labels.append(None if marked and main and k not in menu else False)
        elif links > 0.33 * len(text) and not (marked and main):
            labels.append(False)
        elif marked and not main:
            labels.append(len(text) >= 200 and stops >= 0.22 and links == 0)
        elif len(text) >= 70 and (stops >= 0.22 or stops >= 0.12 and len(text) >= 200):
            labels.append(True)
        else:
            labels.append(None)
    out = []
    for i, x in enumerate(labels):
        if x is None:
            own = [j for j, y in enumerate(labels) if y is not None and (rows[j][2] or not marked)]
            if marked:
                sides = [max((j for j in own if j < i), default=None), min((j for j in own if j > i), default=None)]
                x = any(j is None or labels[j] for j in sides)
            else:
                least = min((abs(i - j) for j in own), default=None)
                x = least is None or any(labels[j] for j in own if abs(i - j) == least)
        out.append(x)
    return out


def test_passes_like_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        rows = []
        for _ in range(rng.randrange(1, 14)):
            text = " ".join(rng.choice(["the", "of", "river", "stone", "blorgh", "house", "x1"]) for _ in range(rng.choice([1, 5, 12, 30, 60])))
            rows.append((text, rng.choice([0, 0, 0, len(text) // 2, len(text)]), rng.random() < 0.5))
        if rng.random() < 0.4:
            rows = [(t, n, False) for t, n, _ in rows]
        blocks = [Block(t, n, main=m) for t, n, m in rows]
        assert classify(blocks) == brute(rows)
    assert first_pass(Block("Short."), False) is None


def test_given_pages_without_their_mark(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert len(pages) > 20
    for page in pages:
        bare = re.sub("</?(article|main)[^>]*>", "", page)
        assert bare != page and main_text(bare) == main_text(page) != ""


def test_time_is_linear():
    for page in ("<div>" * 100000 + "deep" + "</div>" * 100000, '<p "' * 100000, '<p a="' * 100001 + ">", "<" * 300000, '<div class="ad">' * 50000, "<p " + "a " * 100000 + ">"):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 5


def test_table(spark):
    pages = spark.createDataFrame([(1, None, "u", "x"), (2, "", "u", "x"), (3, "<article>é 😀</article>", None, "x"), (3, "<article>é 😀</article>", None, "x")], "page_id long, html string, url string, text string")
    got = html_extract(pages, ["page_id", "url"]).collect()
    assert sorted((r.page.c0, r.text) for r in got) == [(1, ""), (2, ""), (3, "é 😀"), (3, "é 😀")]
    assert html_extract(pages.limit(0), ["page_id"]).collect() == []
