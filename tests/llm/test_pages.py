import json
import random
import time

from gatemeter.llm.pages import expression, extract, main_region, main_text, merged, query, template_texts, tree, wrappers

DDL = "page_id bigint, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:"<p>x</p>"}</style></head><body class="menu-open">
<header><a href="/">Site</a></header><nav><ul><li><a>Menu</a><li>More</ul></nav><div id="cookie-banner"><div>We use</div> cookies</div>
<div class="ad">Buy</div><!-- <p>gone</p> --><script>var t="</p><p>no";</script>
<article class="post"><header><h1>The &amp; title</h1></header><p>One <b>two
  three</b>&nbsp;&eacute; 5 &lt; 6 <p>Next<br>line <a href="a>b">link</a>.<ul><li>i1<li>i2</ul><div class="share">Share me</div>
<form><input><p>mail</p></form><blockquote>Quote</blockquote><aside>Side</aside>tail<div class="comments"><article class="comment"><p>Nice!</p></article></div></article>
<section id="comments"><article><p>Reader says</p></article></section><div role="complementary">Right</div><footer>&copy; x</footer></body></html>"""
TEXT = "The & title\nOne two three é 5 < 6\nNext line link.\ni1\ni2\nQuote\ntail"


def test_main_text():
    assert main_text(PAGE) == TEXT
    assert main_text("") == "" and main_text("   ") == "" and main_text("plain < text &amp; more") == "plain < text & more"
    assert main_text("<div class=ad>never closed <article><p>kept</article>") == "kept"
    assert main_text("<article><p>a<p>b") == "a\nb" and main_text("<nav>x") == ""
    assert main_text("<p>no article</p><div>here</div><nav>m</nav>") == "no article\nhere"
    assert main_text("<article><p>" + "w " * 200_000 + "</p></article>") == ("w " * 200_000).strip()
    assert main_text("<div>" * 3000 + "deep") == "deep" and tree("<div>" * 3000 + "deep")["n"] == 1


def test_elements_left_out_end_where_html_closes_them():
    assert main_text('<article><p>One<p class="notice">Ad<p>Two<p>Three</article>') == "One\nTwo\nThree"
    assert main_text('<article><p>One<p class="ad">Ad <b>x</b><div>Two</div></article>') == "One\nTwo"
    assert main_text('<article><ul><li>1<li class="ad">Ad<ul><li>deep</ul><li>2</ul>After</article>') == "1\n2\nAfter"
    assert main_text('<article><ul><li>1<li class="ad">Ad</ul><p>After</article><p>out') == "1\nAfter"
    assert main_text('<article><dl><dt>a<dd class="ad">Ad<dt>b<dd>c</dl>d</article>') == "a\nb\nc\nd"
    assert main_text('<article><table><tr><td>1<td class="ad">Ad<table><tr><td>x</table>y<td>2<tr class="ad"><td>z<tr><td>3</table>After</article>') == "1\n2\n3\nAfter"
    assert main_text('<article><b>One two three<div class="ad">Ad</b> still</div>Two</article>') == "One two three\nTwo"
    assert main_text('<div><article><p>One</div><p>Two</article></div>') == "One\nTwo"
    assert main_text("<nav>menu<article><p>kept</article>") == "kept"


def test_classes_leave_out_no_article_and_count_as_whole_names():
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "side", "header", "share", "related"):
        assert main_text(f'<div class="{name}"><p>x</p><article><h1>T</h1><p>Text</article></div><p>out') == "T\nText", name
        assert main_text(f'<div class="{name}"><main><h1>T</h1><p>Text</main></div>') == "T\nText", name
    inner = '<h1 class="entry-header">T</h1><div class="post-header">By</div><div class="header">H</div><section id="related-work"><p>Work</section>'
    assert main_text(f"<article>{inner}<p>Text</article>") == "T\nBy\nH\nWork\nText"
    for name in ("ad", "site-footer", "cookie-banner", "related-posts", "comment-list", "post-comments", "nav-menu", "share_buttons", "Sidebar__inner", "ad-slot-3"):
        assert main_text(f'<p>Main text of the page<div class="{name}">gone</div>') == "Main text of the page", name
    assert main_text('<div class="share">' + "<p>long text" * 9 + "</div><p>end") == "\n".join(["long text"] * 9 + ["end"])
    assert main_text('<p>Main<div id="comments"><p>' + "said " * 50 + "</div>") == "Main"
    assert main_text('<div><p>Main text, unmarked</div><div class="related"><article>tease</article></div>') == "Main text, unmarked\ntease"
    assert main_text('<div class="side"><div class="related"><article>tease</article></div><article>Main</article></div>') == "Main"


def page(items, extra="", note="Terms apply"):
    return f"<html><body><div><p>{note}</p></div><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>{extra}<div class='b'><p>{items[0]} body</p></div></body></html>"


def test_alignment_finds_slots_optionals_and_repeats():
    whole = None
    for p in (page("ab"), page("c", "<h2>Sometimes</h2>"), page("defg")):
        whole = merged(whole, tree(p))
    assert expression(whole) == "<html><body><div><p>Terms apply</p></div><ul>(<li>#PCDATA</li>)+</ul>(<h2>Sometimes</h2>)?<div.b><p>#PCDATA</p></div.b></body></html>"
    assert template_texts(whole) == ["Terms apply"]


def made_site(r, host, n):
    """Pages of one made-up template whose names say nothing, each with its true main text."""
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    names = [f"k{r.randint(1, 9)}{word()}" for _ in range(6)]
    deep, heads, note, side_first, table = r.randint(1, 4), r.random() < 0.5, some(3, 6), r.random() < 0.5, r.random() < 0.5
    out = []
    for i in range(n):
        blocks, parts = [], []

        def add(tag, text, blocks=blocks, parts=parts):
            blocks.append(text)
            parts.append(f"<{tag}>{text.replace(' ', '  ', 1)}</{tag}>")

        title = some(3, 7)
        for _ in range(r.randint(3, 9)):
            kind = r.random()
            if kind < 0.7:
                add("p", some(10, 60))
            elif kind < 0.8:
                add("blockquote", some(4, 20))
            elif kind < 0.9:
                items = [some(2, 8) for _ in range(r.randint(1, 5))]
                blocks += items
                parts.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
            else:
                add("h2", some(2, 5))
        add("h3", "Ingredients")
        add("p", some(20, 40))
        links = "".join(f'<li><a href="/{word()}">{some(1, 4)}</a></li>' for _ in range(r.randint(2, 9)))
        teaser = f'<div class="{names[1]}" id="t{i}"><p>{some(3, 12)}</p></div>' if r.random() < 0.7 else ""
        side = f'<div class="{names[2]}"><p>{note}</p><p>{some(2, 6)}</p></div>'
        inner = f'<div class="{names[0]}" id="post-{i}">{"" if heads else f"<h1>{title}</h1>"}{"".join(parts)}</div>'
        for d in range(deep):
            inner = f'<div class="{names[3]}-{d}">{f"<h1>{title}</h1>" if heads and not d else ""}{inner}</div>'
        last = f"<table><tr><td>{some(1, 3)}</td></tr></table>" if table else ""
        body = f'<div class="{names[4]}"><ul>{links}</ul></div>{side if side_first else ""}{inner}{teaser}{"" if side_first else side}{last}<p>{note}</p>'
        out.append((f"https://{host}/{i}", f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{body}</body></html>", "\n".join([title, *blocks])))
    return out


def test_wrappers_find_the_main_text_of_made_up_templates(spark):
    r = random.Random(5)
    site = [x for k in range(12) for x in made_site(r, f"h{k}.example", r.choice([6, 15, 40, 90]))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(site)], DDL).repartition(5)
    got = {x["page_id"]: x["text"] for x in extract(pages).collect()}
    assert [got[i] for i in range(len(site))] == [t for _, _, t in site]
    assert not any(main_text(h) == t for _, h, t in site)  # without the wrappers no page comes out right


def test_link_lists_marked_as_articles_do_not_hide_the_main_text():
    site = made_site(random.Random(8), "one.example", 30)
    site = [(u, h.replace('<div class="k', '<article class="k', 1).replace("</ul></div>", "</ul></article>", 1), t) for u, h, t in site]
    whole = None
    for _, h, _ in site:
        whole = merged(whole, tree(h))
    assert [main_text(h, set(template_texts(whole)), main_region(whole)) for _, h, _ in site] == [t for _, _, t in site]


def test_a_region_gives_way_to_a_larger_article_and_to_missing_elements():
    path = ["html", "body", "article.b"]
    assert main_text("<html><body><article class=b><p>tease</p></article><div><article><p>the long main text</p></article></div>", (), path) == "tease\nthe long main text"
    assert main_text("<html><body><article class=b><p>the main text</p></article><div><article><p>tease</p></article></div>", (), path) == "the main text"
    assert main_text("<html><body><div><p>no such element</p></div>", (), path) == "no such element"
    assert main_text("<html><body><h1>T</h1><div class=m><p>x</p></div><p>out</p>", (), ["html", "body", "div.m"]) == "T\nx"
    assert main_region({"n": 2, "c": tree("<html><body><div class=m><p>x</p></div>")["c"]}) == []


def test_wrappers_stay_small_however_many_pages():
    whole, sizes = None, []
    for i in range(1200):
        p = f"<html><body><div class='m' id='post-{i}'><p>text {i}</p></div><div class='x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>{i}</div></body></html>"
        whole = merged(whole, tree(p))
        sizes.append(len(json.dumps(whole)))
    assert whole["n"] == 1200 and main_region(whole) == ["html", "body", "div.m"]
    assert max(sizes[600:]) < 60_000 and sizes[-1] < 40_000


def test_custom_elements_and_broken_tags():
    assert main_text("<p>one</p><svg-icon></svg-icon><p>two</p>") == "one\ntwo"
    assert main_text("<article>a<title-bar></title-bar><p>b</p><style-guide>c</style-guide></article>") == "a\nb\nc"
    assert main_text('<p>a</p><div title="never closed><p>b</p>') == "a\nb"
    assert main_text("<p>a</p><b") == "a\n<b" and main_text("<p>x <!-- open") == "x" and main_text("<p>x<script>var a") == "x"
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    for unit in ('<a "', '<a ">"', "<a '\">", "<script ", "<!-- ", "<", "</"):
        began = time.process_time()
        main_text(unit * 20_000)
        assert time.process_time() - began < 5, unit


def test_template_texts_are_left_out_without_an_article(spark):
    rows = [(i, f"http://U@Host.example:80/{i}", page([f"item{i}", f"more{i}"])) for i in range(12)] + [(50, "http://other.example/", page(["x"])), (51, None, None), (52, "not a url", ""), (0, "http://host.example/0", page(["item0", "more0"]))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DDL + ", text int").repartition(4)
    for limit in (32 << 20, 0):
        got = extract(docs, broadcast_bytes=limit).collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r for r in got}
        assert by[3]["text"] == "item3\nmore3\nitem3 body" and by[50]["text"] == "Terms apply\nx\nx body"
        assert by[51]["text"] == by[52]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    made = {r["host"]: json.loads(r["wrapper"]) for r in wrappers(docs).collect()}
    assert made["host.example"]["n"] == 13 and set(made) == {"host.example", "other.example", ""}


def test_query_keeps_articles_whole(spark):
    r = random.Random(1)
    rows = [(i, f"https://h{i % 3}.example/{i}", PAGE.replace("Quote", f"Quote {r.random()}") if i % 2 else PAGE) for i in range(30)]
    for x in query(spark.createDataFrame(rows, DDL)).collect():
        assert x["text"].startswith(TEXT[:60]) and (x["page_id"] % 2 or x["text"] == TEXT)


def test_empty_table(spark):
    assert query(spark.createDataFrame([], DDL)).count() == 0
