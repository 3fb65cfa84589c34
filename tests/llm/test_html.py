import pytest

from tessera.llm import html

html_module = html

SCHEMA = "page_id long, url string, html string, path string"
RUN = "The main text of this page goes on for quite a while, as articles do, and says one thing after another."


def page(body, kind="post"):
    return f"""<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>
    <header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu entry</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies on this site, and this is a long notice that says so in many words.</p></div>
    <div id=wrap><div class="{kind}">{body}</div><div class=sidebar><p>Other things to read elsewhere on this site.</p></div></div>
    <div class=comments><p>Reader: {RUN}</p></div><footer>Imprint</footer><script>var x = "<p>no</p>";</script></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<h1>Title</h1><p>{RUN}</p><p>Second&nbsp;&amp; <b>bo</b>ld&#33;\n\n text</p>", f"Title {RUN} Second & bold! text"),
        (f"<p>{RUN}<p>Unclosed<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", f"{RUN} Unclosed one two a b"),
        (f"<p>{RUN}<!-- gone --><br>after</p><form><p>Your name</p><input></form><aside>Aside</aside>", f"{RUN} after"),
        (f"<p>{RUN}</p><div class='ad-box'><p>Buy now</p></div><p>1 &lt; 2 &eacute; &#x4e2d;</p>", f"{RUN} 1 < 2 é 中"),
    ],
)
def test_main_text(body, text):
    p = html.Page(page(body))
    best = max(p.votes().items(), key=lambda kv: kv[1])[0]
    assert p.text(best) == text and p.text(None) == text


def test_hosts_agree(spark):
    rows = [(i, f"https://Example.org:80/{i}", page(f"<p>{RUN} {i}</p>"), "x") for i in range(12)]
    # on a page of its own the list of links and remarks would win; the host's other pages tell where its text stands
    rows.append((50, "http://example.org/x", page("<p>Short text.</p>").replace("<div id=wrap>", f"<div class=extra><p>{RUN}</p></div><div id=wrap>"), "x"))
    rows += [(60, "u", None, None), (61, None, "", None), (62, None, "plain words only", None), (63, "http://other", page(f"<p>{RUN}</p>", "entry"), None), (63, "http://other", page(f"<p>{RUN}</p>", "entry"), None), (64, "http://long", page("<p>" + "word " * 200_000 + "</p>"), None), (65, "http://deep", "<div>" * 3000 + RUN, None)]
    got = html.extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"{RUN} {i}" for i in range(12)) and text[50] == "Short text."
    assert text[60] == text[61] == "" and text[62] == "plain words only" and text[63] == RUN and text[64] == ("word " * 200_000).strip() and text[65] == RUN
    joined = html.extract_text(spark.createDataFrame(rows, SCHEMA), broadcast_hosts=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_empty(spark):
    assert html.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


PROSE = "Plain running words of an article that go on for a while. " * 6


def page_text(html):
    return html_module.Page(html).text(None)


def test_class_words_only_suggest_side_matter():
    from tessera.llm.html import side_matter

    for names in ("content has-sidebar", "post with-comments", "single comments-open", "no-sidebar page"):
        assert side_matter("div", names, False) is None
    assert side_matter("div", "sidebar-left", False) == "side" and side_matter("div", "comment-body", False) == "comments" and side_matter("section", "post-comments", False) == "comments"
    assert side_matter("body", "comments sidebar", False) is None and side_matter("article", "post has-comments", False) is None
    want = PROSE.strip()
    assert page_text(f'<body><div class="content has-sidebar"><p>{PROSE}</p></div><div class="sidebar"><p>Side words.</p></div></body>') == want
    assert page_text(f'<body><div class="widget-article"><p>{PROSE}</p></div><div class="widget"><p>Side words.</p></div></body>') == want
    assert page_text(f'<body class="single comments-open"><article class="post has-comments"><p>{PROSE}</p><div class="comments"><p>{PROSE * 9}</p></div></article></body>') == want
    assert page_text("<body><div class='menu'></div></body>") == ""


def test_long_paths_stay_apart():
    from tessera.llm.html import path_key

    deep = "div.abcdefgh/" * 200
    assert path_key(deep + "div.a") != path_key(deep + "div.b") and -(2**63) <= path_key(deep) < 2**63
