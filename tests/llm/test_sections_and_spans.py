"""Sections whose ids are made of headings, parts that are none of the article, and long texts of few signs."""

import time

import pytest

from scholarium.llm import pii
from scholarium.llm.html_text import main_text

WORDS = "A paragraph of the article with quite some words in it, and then some more of them. "


@pytest.mark.parametrize("name", ["search", "social", "comments", "cookies", "login", "copyright", "newsletter", "menu", "skip", "share"])
def test_sections_named_by_their_headings_stay(name):
    page = f"<html><body><nav><a href=1>Home</a></nav><main><h1>Title</h1><p>{WORDS * 3}</p><section id='{name}'><h2>{name.title()}</h2><p>{WORDS}first</p><p>With <a href=2>a link</a> in it, {WORDS}</p></section><p>{WORDS}last</p></main><footer>{WORDS}</footer></body></html>"
    text = main_text(page)
    assert name.title() in text.split("\n") and "first" in text and "With a link in it" in text and "last" in text and "Home" not in text and text.count("A paragraph") == 3 + 2 + 1
    heading = f"<html><body><article><h1>Title</h1><p>{WORDS * 3}</p><div><h2 id='{name}'>About {name}</h2><p>{WORDS}tail</p></div></article></body></html>"
    assert f"About {name}" in main_text(heading) and "tail" in main_text(heading)


@pytest.mark.parametrize("part", [
    "<section id='comments'><h2>Comments</h2><div class='comment'><p>{0}</p></div><div class='comment'><p>Yes</p></div></section>",
    "<div id='comments'><h3>2 replies</h3><p>{0}</p><form><textarea></textarea><p>Your reply</p></form></div>",
    "<div class='comments'><h3>Comments</h3><p>{0}</p></div>",
    "<div id='social'><h3>Share</h3><p><a href=1>{0}</a></p></div>",
    "<div id='menu'><ul><li><a href=1>{0}</a></li></ul></div>",
    "<div id='newsletter'><p>{0}</p></div>",
    "<section id='cookies' role='banner'><h2>Cookies</h2><p>{0}</p></section>",
])
def test_parts_that_are_none_of_the_article_go(part):
    for page in ("<html><body><article><h1>T</h1><p>{1}</p><p>{1}</p></article>{0}</body></html>", "<html><body><main><h1>T</h1><p>{1}</p>{0}<p>{1}</p></main></body></html>"):
        text = main_text(page.format(part.format("Not of the article."), WORDS * 3))
        assert "Not of the article" not in text and text.count("A paragraph") == 6


def test_long_texts_of_signs_take_time_in_proportion(spark):
    texts = ["call +1" + "(" * 1_000_000 + "2", "+1" + " " * 1_000_000 + "2345678901", "%%%%@" * 200_000, "+1((((" * 170_000, " at " * 250_000, "a@" * 500_000, "1.1." * 20_000, "4 4-" * 250_000]
    docs = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(texts)), (99, "mail me at a.b@example.com", "x")], "doc_id long, text string, base string")
    began = time.time()
    got = {r.doc_id: len(r.base) for r in pii.find_spans(docs).collect()}
    assert got[99] == 1 and got[1] == 1 and got[6] == 10_000 and time.time() - began < 80


def test_what_comes_before_an_at():
    assert [pii._before_at(t) for t in ("jo.doe (at) x", "jo @ x", "at x", "cat", "jo_@@x", "((((at")] == ["jo.doe", "jo", "", "cat", "jo_", ""]
