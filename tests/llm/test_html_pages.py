"""Token F1 of main texts on built pages of varied layouts, each block labelled as article or not when it is built."""

import random
from collections import Counter

import pytest

from tessera.llm import html

WORDS = "river stone market letter winter engine harbour paper garden method signal village copper window bridge record morning theory silver number".split()


class Layout:
    """A site's template: how it wraps articles, and what stands around them."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        pick = self.rng.choice
        self.wrap = pick(
            [
                ("<article>", "</article>"), ("<main><article class='post has-comments'>", "</article></main>"), ("<div id='content'><div class='entry-content'>", "</div></div>"),
                ("<div class='page'><div class='story-body'>", "</div></div>"), ("<table><tr><td class='text-main'>", "</td></tr></table>"), ("<section class='post-text'>", "</section>"),
            ]
        )
        self.part = pick([None, None, "split", "lead"])
        self.side = self.rng.sample(
            [
                "<nav><ul><li><a href='/'>Home page</a></li><li><a href='/n'>News of today</a></li></ul></nav>", "<div class='sidebar-left'><h3>Elsewhere</h3><p>{s}</p></div>", "<aside><p>{s}</p></aside>",
                "<div class='widget'><a href='/x'>Latest story of the day</a> <a href='/y'>Another one</a></div>", "<div class='ad-box'><p>Buy now, {s}</p></div>", "<div id='cookie-notice'><p>We use cookies. {s}</p></div>",
                "<form><label>Your name please</label><input></form>", "<div style='display:none'><p>{s}</p></div>", "<div hidden><p>{s}</p></div>", "<div role='banner'><p>{s}</p></div>", "<div class='related'><ul><li><a href='/r'>Read this too</a></li></ul></div>",
                "<div class='newsletter-signup'><p>{s}</p></div>",
            ],
            4,
        )
        self.comments = pick(["", "<div class='comments'>{c}</div>", "<section id='comments'><ol class='comment-list'>{c}</ol></section>", "<div class='post-comments'>{c}</div>"])
        self.odd = self.rng.sample(
            [
                "<p title='the hidden truth'>{s}</p>", "<p id='alert'>{s}</p>", "<div class='related-work'><p>{s}</p></div>", "<div class='share-count-explained'><p>{s}</p></div>", "<section class='reply-to-critics'><p>{s}</p></section>",
                "<blockquote>{s}</blockquote>", "<h2 class='header'>{s}</h2>", "<ul><li>{s}</li></ul>", "<p class='ad'>{s}</p>", "<figure class='chart'><figcaption>{s}</figcaption></figure>", "<p data-state='hidden'>{s}</p>", "<pre>{s}</pre>",
            ],
            3,
        )

    def sentence(self, n=12):
        return (" ".join(self.rng.choice(WORDS) for _ in range(n)) + ".").capitalize()

    def page(self):
        """(html, text of the article)."""
        rng, text = self.rng, []

        def block(template, n):
            s = " ".join(self.sentence() for _ in range(n))
            text.append(s)
            return template.replace("{s}", s.replace(" ", "\n ", 1))

        body = [block("<p>{s}</p>", rng.randint(1, 4)) for _ in range(rng.randint(4, 9))] + [block(t, 1) for t in self.odd]
        if self.part == "split":
            half = len(body) // 2
            inner = f"<div class='part'>{''.join(body[:half])}</div><div class='part'>{''.join(body[half:])}</div>"
        elif self.part == "lead":
            inner = f"<div class='lead'>{body[0]}</div><div class='rest'>{''.join(body[1:])}</div>"
        else:
            inner = "".join(body)
        side = [t.replace("{s}", self.sentence()) for t in self.side]
        remarks = "".join(f"<li class='comment'><p>{self.sentence(20)}</p></li>" for _ in range(rng.randint(1, 15)))
        return f"<html><head><title>T</title><script>var a = '<p>x</p>';</script></head><body><header><p>{self.sentence(4)}</p></header>{side[0]}{side[1]}<div id='frame'>{self.wrap[0]}{inner}{self.wrap[1]}{side[2]}{self.comments.replace('{c}', remarks)}</div>{side[3]}<footer><p>{self.sentence(6)}</p></footer></body></html>", " ".join(text)


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if a or b else 1.0


@pytest.fixture(scope="module")
def pages():
    return [(f"https://site{h}.example/{i}", *layout.page()) for h in range(30) for layout in [Layout(h)] for i in range(4)]


def test_f1_of_each_page_by_itself(pages):
    scores = [f1(html.Page(page).text(None), want) for _, page, want in pages]
    assert len(scores) == 120 and sum(scores) / len(scores) >= 0.97, sorted(zip(scores, (u for u, _, _ in pages)))[:12]


def test_f1_with_votes_of_hosts(spark, pages):
    df = spark.createDataFrame([(i, url, page) for i, (url, page, _) in enumerate(pages)], "page_id long, url string, html string")
    scores = [f1(r["text"], pages[r["page_id"]][2]) for r in html.extract_text(df).collect()]
    assert len(scores) == 120 and sum(scores) / len(scores) >= 0.97


def test_ties_of_paths_go_to_the_smallest_hash(spark):
    prose = "One sentence that is long enough to be read as running text. " * 3
    df = spark.createDataFrame([(i, "http://tie", f"<div class=a><p>{prose}</p></div><div class=b><p>{prose}</p></div>") for i in range(3)], "page_id long, url string, html string")
    (row,) = html.vote(df).collect()
    assert row["path"] == min(html.path_key("div.a"), html.path_key("div.b"))
    assert len({r["text"] for r in html.extract_text(df).collect()}) == 1


def test_set_can_fail(pages, monkeypatch):
    """The same pages with any word of a name counting, and without siblings, score lower: the set tells rules apart."""
    monkeypatch.setattr(html.Page, "_siblings", lambda self, chosen: set())
    scores = [f1(html.Page(page).text(None), want) for _, page, want in pages]
    assert sum(scores) / len(scores) < 0.985
