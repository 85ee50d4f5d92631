"""WARC and main text."""

import io
import math
import random
import re
from xml.etree import ElementTree

import pytest

from layerroutes.llm import warc
from layerroutes.llm.html_text import BLOCK, PENALTY, PUNCTUATION, content_paths, extract, main_text

SCHEMA = "page_id long, url string, html string, key string, refers int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None) for i, u, h in rows], SCHEMA)


def test_warc_round_trip_against_brute_force(spark):
    html = ["<p>a</p>", None, "", "é" * 5000, "<p>a</p>", "x\r\n\r\ny", "<p>a</p>", "b" * 300_000, "", "WARC/1.1\r\n\r\n"]
    rows = [((i * 7) % 31, None if i == 3 else f"http://x/ ä{i}", h) for i, h in enumerate(html)]
    for least in (0, 10):
        got = {tuple(r) for r in warc.round_trip(frame(spark, rows).repartition(3), min_bytes=least).collect()}
        want = set()
        for i, _, h in rows:
            data = (h or "").encode()
            last = max(k for k, _, g in rows if (g or "") == (h or "")) if len(data) >= least else i
            want.add((i, len(data), warc.digest(data), "response" if last == i else "revisit", None if last == i else last))
        assert got == want


def test_warc_ties_nulls_and_empty(spark):
    got = warc.round_trip(frame(spark, [(5, "u", "a"), (5, "u", "a"), (None, None, "a"), (None, "u", "b")])).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("5", "response", None), ("5", "revisit", 5), ("None", "response", None), ("None", "revisit", 5)]
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_warc_reader_finds_damage():
    good = warc.member(warc.record("1", "u", b"payload", warc.digest(b"payload"), None, False))
    assert [r["payload"] for r in warc.read_records(io.BytesIO(good * 3))] == [b"payload"] * 3
    bad = [
        good[:-9],
        warc.member(warc.record("1", "u", b"payload", warc.digest(b"other"), None, False)),
        warc.member(warc.record("1", "u", b"payload", warc.digest(b"payload"), None, False).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")),
        warc.member(warc.record("1", "u", b"payload", warc.digest(b"payload"), None, False)[:-2]),
    ]
    for data in bad:
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(good + data)))


LONG = "Some sentence, with words and points. " * 6
PAGES = [
    ("", ""),
    ("just text,\n no  tags", "just text, no tags"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class='ad'>{LONG}</div><article><h1>Head &amp; line</h1><p><b>{LONG}<br><p>Short.</p><p>a <i>b</i>\n c</p></article><footer>{LONG}</footer></body></html>", f"Head & line\n{LONG.strip()}\nShort.\na b c"),
    (f"<body><div id=menu><ul><li>x<li>y</ul></div><div class='content'><h2>T</h2><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG}</p></div><div class='user comments'><p>{LONG}</p></div><aside>{LONG}</aside><form><p>{LONG}</p></form></body>", f"T\n{LONG.strip()}\none\ntwo\n{LONG.strip()}"),
    (f"<main><div class='cookie-notice'>{LONG}</div><p>{LONG}</p><script>var a='<p>x</p>'</script></main>", LONG.strip()),
    ("<p>unclosed <b>tags &lt; here", "unclosed tags < here"),
    ("<script>x</script>", ""),
    ("<div><", "<"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text(html, want):
    assert main_text(html) == want


def test_deep_and_broken_nesting():
    deep = 30_000
    assert main_text("<div>" * deep + LONG + "</div>" * deep) == LONG.strip()
    assert main_text("<span>" * deep + "</b></p></i>" * deep + LONG) == LONG.strip()


def test_extract(spark):
    rows = [(1, "u", PAGES[2][0]), (1, None, None), (None, "v", "<p>" + "x" * 500_000)]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(frame(spark, rows)).collect()}
    assert got == {(1, "u"): (PAGES[2][1], len(PAGES[2][1])), (1, None): ("", 0), (None, "v"): ("x" * 500_000, 500_000)}
    assert extract(frame(spark, [])).count() == 0


TRIED = [
    (f'<body><article><h1>T</h1><p>{LONG}</p><h2 id="related-work">Related work</h2><p>{LONG}</p><h2 id="login-flow">Login flow</h2><p>Short.</p><section class="form-theory"><p>{LONG}</p></section><ul class="toc"><li><a href=#a>One</a><li><a href=#b>Two</a></ul></article></body>', ["T", LONG, "Related work", LONG, "Login flow", "Short.", LONG]),
    (f'<body><div class="post has-share"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><p>Copyright line.</p></body>', ["T", LONG, LONG]),
    (f'<body><div class="has-sidebar"><div class=menu><a href=x>a</a></div><p>{LONG}</p><p>x y</p></div></body>', [LONG, "x y"]),
    (f'<body><div id="page" class="login-open"><p>{LONG}</p></div></body>', [LONG]),
    (f'<div><h1>Head</h1><div class="intro">lead text</div><div class="body"><p>{LONG}</p><p>{LONG}</p></div></div>', ["Head", "lead text", LONG, LONG]),
    (f'<body><div class="x9">Buy now, cheap.</div><h1>A</h1><p>{LONG}</p><h2 id=search>S</h2><p class="notice-periods">np</p><p>{LONG}</p></body>', ["A", LONG, "S", "np", LONG]),
    (f'<body><main><article><h1>Q</h1><p>{LONG}</p></article><div class="related-posts"><p>More, too.</p></div></main></body>', ["Q", LONG]),
]


COMMENT = "I liked this post a lot, thank you. Really. "
POST = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
ONLY = "\n".join(["T", LONG.strip(), LONG.strip()])
BESIDE_THE_POST = [
    f"<body><main>{POST}<ol class='commentlist'><li>{COMMENT}</li><li>{COMMENT * 3}</li></ol></main></body>",
    f"<body><main>{POST}<div id='disqus_thread'><p>{COMMENT * 9}</p></div></main></body>",
    f"<body><article>{POST}<div id='comments'><p>{COMMENT * 9}</p></div></article></body>",
    f"<body><div class='post'>{POST}</div><div class='comments-area'><p>{LONG * 5}</p><p>{LONG * 5}</p></div></body>",
    f"<body><div class='post'>{POST}</div><div class='comments'><ul><li>{LONG * 9}</li><li>{LONG * 9}</li></ul></div></body>",
    f"<body><article><h1>T</h1><p>{LONG}</p><div class='newsletter-signup'>Get our news, every week, by mail. Sign up now.</div><p>{LONG}</p></article></body>",
    f"<body><article><h1>T</h1><p>{LONG}</p><div class='adbox'><p>{LONG}</p></div><p>{LONG}</p></article></body>",
    f"<body><article>{POST}<div style='display: none'>{LONG}</div><p aria-hidden='true'>{LONG}</p></article></body>",
    f"<body><article>{POST}</article><article class='teaser'><h2>Other</h2><p>Read this, too.</p></article></body>",
    f"<body><div class='no-sidebar'><div class='cookie-notice'>We use cookies, ok?</div>{POST}</div></body>",
]


@pytest.mark.parametrize("html", BESIDE_THE_POST)
def test_comments_adverts_and_hidden_parts_stay_out(html):
    assert main_text(html) == ONLY


def test_comments_alone_are_no_article_and_equal_articles_all_stay():
    assert main_text(f"<body><div class='comments'><p>{LONG}</p></div></body>") == ""
    assert main_text(f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>") == "\n".join([LONG.strip()] * 2)
    assert main_text(f"<article><h2 id='comments'>Comments</h2><section id='search'><p>{LONG}</p></section></article>") == "Comments\n" + LONG.strip()


@pytest.mark.parametrize(("html", "want"), TRIED)
def test_names_alone_do_not_decide(html, want):
    assert main_text(html) == "\n".join(x.strip() for x in want)


def brute_paths(nodes):
    """Scores and threshold as the docstring of ``content_paths`` has them, one by one."""
    paths = {p: [n for n in nodes if n[0] == p] for p, *_ in nodes}
    ratio = []
    for p, *_ in nodes:
        own = paths[p]
        length = sum(0 if link else len(t.strip()) for _, t, link, _ in own) / len(own)
        points = sum(sum(c in PUNCTUATION for c in t) for _, t, *_ in own) / len(own)
        ratio.append(length * (1 + points))
    weight, fused = {-2: 0.054, -1: 0.242, 0: 0.399, 1: 0.242, 2: 0.054}, []
    for i, r in enumerate(ratio):
        near = [(w, ratio[i + k]) for k, w in weight.items() if 0 <= i + k < len(ratio)]
        fused.append(math.sqrt(r * sum(w * v for w, v in near) / sum(w for w, _ in near)) * (PENALTY if nodes[i][3] else 1))
    score = {p: sum(f for f, n in zip(fused, nodes, strict=True) if n[0] == p) / len(paths[p]) for p in paths}
    chars = [0 if link else len(t.strip()) for _, t, link, _ in nodes]
    if sum(c for c, n in zip(chars, nodes, strict=True) if not n[3]):
        chars = [0 if n[3] else c for c, n in zip(chars, nodes, strict=True)]
    below, typical = 0, None
    for f, c in sorted(zip(fused, chars, strict=True), key=lambda x: x[0]):
        below += c
        if 2 * below >= sum(chars):
            typical = f
            break
    edge = min(typical / 5, max(score.values()))
    return {p for p, s in score.items() if s >= edge * (1 - 1e-12)}


@pytest.mark.parametrize("seed", range(20))
def test_scores_match_brute_force(seed):
    r = random.Random(seed)
    nodes = []
    for _ in range(r.randint(1, 60)):
        p = r.randint(0, 7)
        nodes.append((p, r.choice(["word ", "a, b. ", "x! "]) * r.randint(1, 3 + 20 * (p % 3)), r.random() < 0.2, p == 5))
    assert content_paths(nodes) == brute_paths(nodes)


def brute_article(html):
    """Main text of a well-formed page whose article holds most content: each node of it but
    elements that are out, link lists, and marked containers below the threshold."""
    root, nodes = ElementTree.fromstring(html), []
    names = lambda e: "".join("." + x for x in sorted(set(re.split("[^a-z]+", e.get("class", "").lower())) - {""}))

    def text_of(e):
        return sum(len(x.strip()) for x in e.itertext())

    def walk(e, chain):
        chain = [*chain, e]
        if e.tag in ("nav", "script", "footer"):
            return
        nodes.append("|" if e.tag in BLOCK else "")
        nodes.append((chain, e.text or ""))
        for c in e:
            walk(c, chain)
            nodes.append((chain, c.tail or ""))
        nodes.append("|" if e.tag in BLOCK else "")

    walk(root, [])
    for e in list(root.iter()):
        for c in list(e):
            if c.tag in ("nav", "script", "footer"):
                tail = c.tail
                c.clear()
                c.tail = tail
    holds = lambda e: any(c.tag == "article" for c in e.iter() if c is not e)
    mark = lambda e: e.tag in ("div", "ul", "section") and e.get("class") in ("ad", "comments", "share-box") and not holds(e)
    row = lambda n: ("/".join(x.tag + names(x) for x in n[0]), n[1], any(x.tag == "a" for x in n[0]), any(map(mark, n[0])))
    chosen = brute_paths([row(n) for n in nodes if isinstance(n, tuple) and n[1].strip()])
    out, block = [], []
    for n in [*nodes, "|"]:
        if n == "|":
            joined = re.sub(r"\s+", " ", "".join(block)).strip()
            out += [joined] if joined else []
            block = []
        elif n and any(x.tag == "article" for x in n[0]):
            links = lambda e: [c for c in e.iter("a") if text_of(c)]
            menu = any(x.tag in ("div", "ul", "section", "article") and len(links(x)) > 1 and 10 * sum(map(text_of, links(x))) >= 6 * text_of(x) > 0 for x in n[0])
            path, _, _, marked = row(n)
            comments = any(x.get("class") == "comments" and mark(x) for x in n[0])
            if not menu and not comments and not (marked and path not in chosen):
                block.append(n[1])
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(20))
def test_articles_match_brute_force(seed):
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["some", "words,", "here.", "and", "there"]) for _ in range(n))
    def piece():
        return r.choice([
            lambda: f"<p>{words(r.randint(20, 60))} <b>{words(3)}</b> tail</p>", lambda: f"<h2>{words(3)}</h2>", lambda: "<p>Short.</p>", lambda: f"<div class='{r.choice(['ad', 'comments', 'body', 'form-theory', 'share-box'])}'>{words(r.randint(2, 12))}</div>",
            lambda: "<ul>" + "".join(f"<li><a href='x'>{words(2)}</a></li>" for _ in range(4)) + "</ul>", lambda: "<ul>" + "".join(f"<li>{words(6)}</li>" for _ in range(3)) + "</ul>", lambda: f"<nav>{words(5)}</nav>", lambda: f"<section><p>{words(30)}</p></section>",
        ])()
    html = f"<html><body><nav><a href='x'>{words(2)}</a></nav><div class='ad'>{words(5)}</div><article><h1>{words(4)}</h1><p>{words(80)}</p>{''.join(piece() for _ in range(r.randint(2, 12)))}<p>{words(80)}</p></article><footer>{words(9)}</footer></body></html>"
    assert main_text(html) == brute_article(html)
