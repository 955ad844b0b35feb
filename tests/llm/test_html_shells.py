"""Pages whose outer elements carry words that elsewhere mark menus, notices or comments; hosts of one title; hosts without article elements."""

import random

import pytest

from litprops.llm import html_extract

VOCAB = [a + b for a in "bcdfghklmnprst" for b in ("a", "eno", "ir", "om", "ust")]

SHELLS = {
    "plain": ("<html><body>", "<article>{0}</article>", "</body></html>"),
    "body": ("<html><body class='single no-sidebar'>", "<article>{0}</article>", "</body></html>"),
    "html": ("<html class='no-cookies'><body>", "<article>{0}</article>", "</body></html>"),
    "article": ("<html><body>", "<article class='post comments-open'>{0}</article>", "</body></html>"),
    "wrapper": ("<html><body><div class='with-sidebar'>", "<article>{0}</article>", "</div></body></html>"),
    "topic": ("<html><body>", "<div id='content' class='topic search'><h1>t</h1>{0}</div>", "</body></html>"),
    "nested": ("<html><body class='search'><div class='page-widget'>", "<div class='banner-free'>{0}</div>", "</div></body></html>"),
    "form": ("<html><body><form id=aspnetForm>", "<main>{0}</main>", "</form></body></html>"),
    "no article": ("<html><body>", "<div class='tags'>{0}</div>", "</body></html>"),
}
AROUND = "<nav><a href=a>Home</a></nav><div class='sidebar'><p>{0}</div>"
BELOW = "<section class='comments'><div class='comment'><p>{0}</div><div class='comment'><article class='comment-body'><p>{1}</article></div></section><form><p>Sign up for our letter</form><footer>All rights</footer>"


def sentence(rng, n=30):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def pages(shell, title, rng, comments=1):
    start, middle, end = SHELLS[shell]
    rows, want = [], {}
    for i in range(6):
        body = [sentence(rng) for _ in range(4)]
        text = "".join(f"<p>{b}</p>" for b in body)
        below = BELOW.format(sentence(rng, 8), sentence(rng, 8)) * comments
        rows.append((i, f"http://{shell.replace(' ', '-')}.org/{i}", start.replace("<body", f"<head><title>{title.format(i)}</title></head><body", 1) + AROUND.format(sentence(rng, 10)) + middle.format(text) + below + end))
        want[i] = ("t " if shell == "topic" else "") + " ".join(body)
    return rows, want


@pytest.mark.parametrize("title", ["Title {0}", "The site's name"])
def test_shells(spark, title):
    rng = random.Random(9)
    rows, want = [], {}
    for k, shell in enumerate(SHELLS):
        own, texts = pages(shell, title, rng)
        rows += [(100 * k + i, url, html) for i, url, html in own]
        want |= {100 * k + i: t for i, t in texts.items()}
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = {i: (got[i][:60], want[i][:60]) for i in want if got[i].removeprefix("t ") != want[i].removeprefix("t ")}
    assert not wrong


def test_many_comments_do_not_win(spark):
    """Reader comments that hold more text than the article stay out."""
    rows, want = pages("plain", "x {0}", random.Random(2), comments=20)
    got = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_one_title_host_has_a_template(spark):
    rng = random.Random(4)
    shared = sentence(rng, 12)
    rows = [(i, f"http://one.org/{i}", f"<title>Site</title><div class=x><p>{sentence(rng)}</p><p>{shared}</p></div>") for i in range(8)]
    got = [r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all(got) and not any(shared in t for t in got)


def test_copies_of_one_article_are_no_template(spark):
    rng = random.Random(6)
    body = "".join(f"<p>{sentence(rng)}</p>" for _ in range(4))
    rows = [(i, f"http://copy.org/{i}", f"<title>A</title><article>{body}</article>") for i in range(9)]
    got = {r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 1 and len(got.pop().split()) == 120
