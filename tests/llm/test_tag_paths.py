"""Tag-path ratios: what the ratios decide without names, and what names alone
must not decide."""

import hashlib
import re

import pytest

from tallyspark.llm import queries, tag_paths

LINES = ["The river rose again in the night, and the lower fields, which had been dry since May, went under.",
         "Nobody in the village had seen it so high; the old marks on the mill, cut in stone, were passed by noon.",
         "By evening the road to the station was closed, and the bakery, the school and two barns had been cleared.",
         "A second wave was expected, said the warden, but the dam would hold: it had been raised only last year."]
BODY = "".join(f"<p>{x}</p>" for x in LINES)
TEXT = "\n\n".join(LINES)
NAV = '<ul class="menu">' + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("home", "news", "sport", "about")) + "</ul>"
COMMENTS = '<div class="comments"><h3>Comments</h3>' + "".join(f'<div class="comment" id="c{i}"><p>User{i}: I think so, too. {i}!</p></div>' for i in range(9)) + "</div>"


def page(main, before="", after=""):
    return (f'<html><body><div class="top">Daily News</div>{NAV}{before}<div class="content"><h1>The river rose</h1>{main}</div>'
            f'{after}<div class="ad">Buy now, really. Good.</div><div class="foot">Copyright 2024 Daily News.</div></body></html>')


def hashed(html):
    """All class names and ids replaced."""
    return re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="x{hashlib.md5(m[2].encode()).hexdigest()[:8]}"', html)


WANT = "The river rose\n\n" + TEXT


@pytest.mark.parametrize("rename", [lambda h: h, hashed])
@pytest.mark.parametrize("html", [page(BODY), page(BODY, after=COMMENTS), page(BODY, before=COMMENTS), page(f"<div>{BODY}</div>"), page(BODY + COMMENTS),
                                  page(f'<div class="text">{BODY}</div>{COMMENTS}'), page("".join(f'<div class="para"><p>{x}</p></div>' for x in LINES))])
def test_renamed_classes(html, rename):
    assert tag_paths.extract(rename(html)) == WANT


@pytest.mark.parametrize("names", [True, False])
def test_listed_words_inside_the_article(names, monkeypatch):
    html = ('<html><body><nav><a href="/">Home</a></nav><article><h1>The river rose</h1>'
            f'<div class="post-notice"><p>{LINES[0]}</p></div><section id="widget-design"><h2>Widgets</h2><p>{LINES[1]}</p></section>'
            f'<p class="share-price">{LINES[2]}</p><p>{LINES[3]}</p></article><footer>Copyright</footer></body></html>')
    if not names:
        monkeypatch.setattr(tag_paths, "NOT_CONTENT", set())
    assert tag_paths.extract(html) == "\n\n".join(["The river rose", LINES[0], "Widgets", *LINES[1:]])


def test_named_parts_inside_the_article_go():
    html = f'<article><h1>The river rose</h1><p>{LINES[0]}</p><div class="ad">Buy now. Good.</div><p>{LINES[1]}</p><div role="search">Find it here.</div></article>'
    assert tag_paths.extract(html) == "\n\n".join(["The river rose", *LINES[:2]])


def test_pages_without_the_lists(spark, small_dir, monkeypatch):
    """Class names hashed, or the lists emptied: most pages keep their text."""
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    want = {r.page_id: r.text for r in queries.op6_tag_paths(spark, small_dir).collect()}
    assert sum(tag_paths.extract(hashed(h)) == want[i] for i, h in rows if h) >= 0.9 * len(rows)
    monkeypatch.setattr(tag_paths, "NOT_CONTENT", set())
    monkeypatch.setattr(tag_paths, "ROLES", set())
    assert sum(tag_paths.extract(h) == want[i] for i, h in rows) >= 0.9 * len(rows)


def test_articles_of_the_test_pages(spark, small_dir):
    """Brute force for these pages: the blocks between <article> and its end."""
    import html as entities

    for r in queries.op6_tag_paths(spark, small_dir).join(spark.read.parquet(f"{small_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h1|article)\b[^>]*>", inner[1]) if inner else []
        parts = [" ".join(entities.unescape(re.sub(r"<(?!br)[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
