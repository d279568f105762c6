"""Main text of pages, and archives of them."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from llm_samples import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import differences, duck, plain
from motorpool.llm import archive, html_text
from motorpool.llm.common import scratch
from motorpool.llm.html_text import main_text
from motorpool.llm.queries import SQL, op5_html_extraction, op7_warc

LONG = "This sentence has a comma, another comma, and enough words to look like the prose of a real article. " * 3
NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav>'


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"{NAV}<article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>foot</footer>", ["Title", LONG.strip(), "Short."]),
        (f'<div class="sidebar"><p>{LONG}</p></div><div id="main"><p>{LONG}A</p></div>', [LONG + "A"]),
        (f'<div id=x><p>{LONG}<p><b>Bold<br>  line</b> &amp; more&nbsp;here</div>', [LONG.strip(), "Bold line & more here"]),
        (f'<article><p>{LONG}</p><div class="ad">buy</div><form>mail</form><p>end</p></article><div class="comments"><p>{LONG}</p></div>', [LONG.strip(), "end"]),
        (f'<main><header><h1>H</h1></header><p>{LONG}</p></main><header>site</header>', ["H", LONG.strip()]),
        (f'<article><p>one</p></article><div class="cookie-notice">{LONG}</div><aside>{LONG}</aside>', ["one"]),
        (f'<div><div><p>{LONG}</p></div><div><p>{LONG}2</p></div></div>', [LONG.strip(), LONG + "2"]),
        (f'<div><a href="x">{LONG}</a></div><div><p>{LONG}</p></div>', [LONG.strip()]),
        ("<article><p>a<span>b</span>c</p><!-- no --><ul><li>x</li><li>y</li></ul></article>", ["abc", "x", "y"]),
        ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes &lt;b&gt; &#233;&amp</article>", ["yes <b> é&"]),
        ("", []),
        ("<script>only()</script>", []),
    ],
)
def test_article_and_nothing_else(body, want):
    assert main_text(page(body)) == "\n\n".join(w.strip() for w in want)


@pytest.mark.parametrize(
    "body, want",
    [
        (f'<div class="content with-sidebar"><p>{LONG}</p><p>end</p></div><div>two words</div>', [LONG, "end", "two words"]),
        (f'<article class="post comments-open"><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>', [LONG]),
        (f'<div id="no-ads-wrapper"><article><p>{LONG}</p></article><div class="cookie-notice">{LONG}{LONG}</div></div>', [LONG]),
        (f'<form id="f"><input value="x">{NAV}<div><p>{LONG}</p><button>go</button></div></form>', [LONG]),
        (f'<main><article><p>{LONG}</p></article><div class="related"><article><p>{LONG}2</p></article></div></main>', [LONG]),
        (f'<div><p>{LONG}</p></div><ol class="comment-list"><li><article class="comment-body"><p>{LONG}</p></article></ol>', [LONG]),
    ],
)
def test_a_name_or_a_form_does_not_cut_the_article(body, want):
    assert main_text(page(body)) == "\n\n".join(w.strip() for w in want)


def test_all_sections_of_an_article():
    long = "".join(f"<p>{LONG}{i}</p>" for i in range(40))
    sections = f"<section>{long}</section><section><h4>Note</h4><p>Two, three words.</p></section>"
    for body in (f"<article><header><h1>T</h1></header>{sections}</article>", f"<main><div><h5>T</h5></div>{sections}</main>", f"<div><h5>T</h5>{sections}</div>"):
        got = main_text(page(f'{body}<div><a href="x">{LONG}</a></div>')).split("\n\n")
        assert len(got) == 43 and got[0] == "T" and got[-2:] == ["Note", "Two, three words."]


@pytest.mark.parametrize("name", ['id="related-work"', 'class="how-ads-work"', 'class="social-impact"', 'class="sharing economy"'])
def test_one_word_of_a_name_cuts_nothing_inside_an_article(name):
    body = f"<article><p>{LONG}</p><section {name}><p>{LONG}more.</p></section><p {name}>{LONG}last.</p></article>"
    assert main_text(page(body)).split("\n\n") == [LONG.strip(), f"{LONG}more.", f"{LONG}last."]


@pytest.mark.parametrize(
    "remarks",
    [
        '<div class="comment-list">{}</div>',
        '<div class="comments">{}</div>',
        '<section id="disqus_thread">{}</section>',
        '<div class="thread"><h3>Comments</h3>{}</div>',
        '<div class="thread"><h4>12 comments</h4>{}</div>',
        '<div class="article-comments">{}</div>',
    ],
)
def test_reader_comments_never_count(remarks):
    said = "".join(f"<p>{LONG}I say {i}.</p>" for i in range(9))
    story = f"<p>{LONG}</p><p>{LONG}end.</p>"
    for body in (f"<div id=story>{story}</div>{remarks}", f"<article>{story}{remarks}</article>", f"<main><article>{story}</article>{remarks}</main>"):
        assert main_text(page(body.format(said))).split("\n\n") == [LONG.strip(), f"{LONG}end."]


@pytest.mark.parametrize("name", ["ad-slot", "ad container", "share-buttons", "related-links", "social bar"])
def test_names_that_say_nothing_else_cut_inside_an_article_too(name):
    body = f'<article><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></article>'
    assert main_text(page(body)) == LONG.strip()


def test_comments_may_be_open_on_an_article():
    for name in ("post comments-open", "content comments-open"):
        for tag in ("article", "div"):
            assert main_text(page(f'<{tag} class="{name}"><p>{LONG}</p><p>{LONG}so.</p></{tag}>')).count("\n\n") == 1


def test_time_grows_with_the_page():
    import time

    def spent(n, open_tag):
        body = "".join(f"{open_tag}<p>{LONG}{i}</p>" for i in range(n))
        return min(_timed(lambda: main_text(body), time.process_time) for _ in range(3))

    for open_tag in ("<div>", '<div class="how-ads-work">', "<b>"):
        assert spent(2000, open_tag) < 3.5 * spent(1000, open_tag), open_tag


def _timed(run, clock):
    started = clock()
    run()
    return clock() - started


@pytest.mark.parametrize("text", ["just words, no markup", "", "<", "<p", "</p></div>", "<!--", "<a href='x", "&#xD800; &bogus;", "<p>" * 5000])
def test_whatever_the_markup(text):
    main_text(text)


def test_plain_text_is_its_own_article():
    assert main_text("just words,\n no markup") == "just words, no markup"


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000) == LONG.strip()
    many = "".join(f"<p>{LONG}{i}</p>" for i in range(500))
    assert main_text(page(f"<article>{many}</article>")).count("\n\n") == 499


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<b>", "</b>", "<table><tr><td>", "</table>", "<script>", "text, ", "&amp;", "<!--", "-->", "<a b='c>"]), max_size=30))
def test_never_fails(parts):
    main_text("".join(parts))


def test_query_against_a_plain_reading_of_the_pages(spark):
    """Each page of the table holds one article; tags cut off, it is what should be found."""
    import html
    import re

    rows = {r.page_id: r for r in op5_html_extraction(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert (rows[p.page_id].text, rows[p.page_id].n_chars, rows[p.page_id].url) == (want, len(want), p.url)


def odd_pages(spark):
    rows = [
        (1, "http://www.B.com:80/x?b=2&a=1#f", "x\r\n\r\ny"),
        (2, "http://a.com/", "x\r\n\r\ny"),
        (3, "evil\r\nWARC-Type: z", "é" * 5000),
        (4, None, None),
        (5, "http://a.com/", ""),
        (None, "http://[bad", "x\r\n\r\ny"),
        (2, "http://a.com/", "x\r\n\r\ny"),
        (7, "", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "1 as digest", "2 as bytes", "'p' as payload", "3 as head"), rows


def test_extraction_of_odd_rows(spark):
    df, rows = odd_pages(spark)
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0


def test_archive_round_trip_of_odd_rows(spark):
    df, rows = odd_pages(spark)
    archive.write(df, path := scratch(spark, "a"), records_per_file=3)
    index = archive.merged_index(spark, path, scratch(spark, "b")).collect()
    assert len(index) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted(((i, len((h or "").encode()), sha(h), u or "") for i, u, h in rows), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.url) for r in index), key=repr) == want
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in index)
    assert kinds == [
        ("1", "revisit", 2), ("2", "response", None), ("2", "response", None), ("3", "response", None),
        ("4", "revisit", 5), ("5", "response", None), ("7", "response", None), ("None", "revisit", 2),
    ]
    keys = [(r.url_key, r.captured_at, r.page_id or -1) for r in index]
    assert keys == sorted(keys)


def test_small_payloads_are_always_whole(spark):
    df, rows = odd_pages(spark)
    archive.write(df, path := scratch(spark, "a"), least_bytes=7)
    assert {r.record_type for r in archive.runs(spark, path).collect()} == {"response"}


def test_records_can_be_found_by_offset(spark):
    df, _ = odd_pages(spark)
    archive.write(df, path := scratch(spark, "a"))
    for r in archive.runs(spark, path).collect():
        data = open(r.archive.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
        (record,) = archive.parse(data)
        assert record["page_id"] == r.page_id and record["payload_digest"] == r.payload_digest


def test_empty_table(spark):
    df, _ = odd_pages(spark)
    archive.write(df.limit(0), path := scratch(spark, "a"))
    assert archive.merged_index(spark, path, scratch(spark, "b")).count() == 0


def test_damaged_records_are_noticed():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nWARC-Date: d\r\n"
    bad = f"{head}WARC-Payload-Digest: sha1:AAAA\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(archive.parse(bad))


def test_loser_tree_merges_like_sorting():
    draw = random.Random(2)
    for k in [0, 1, 2, 3, 5, 8, 13]:
        runs = [sorted(draw.randint(0, 20) for _ in range(draw.randint(0, 30))) for _ in range(k)]
        assert list(archive.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_equal_entries_come_in_the_order_of_runs():
    runs = [[(1, "a"), (1, "b")], [(1, "c")], [(0, "d"), (1, "e")]]
    assert [x[1] for x in archive.LoserTree(runs, lambda x: x[0])] == ["d", "a", "b", "c", "e"]


def test_history_of_one_url_is_spread_and_ordered(spark):
    df = spark.range(400).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.com/', concat('http://h', id, '.com/')) as url", "concat('p', id) as html")
    archive.write(df.repartition(8), path := scratch(spark, "a"), records_per_file=40)
    index = archive.merged_index(spark, path, scratch(spark, "b")).collect()
    assert [r.page_id for r in index if r.url_key == "com,hot)/"] == list(range(0, 400, 3))


def test_query_agrees_with_sql(spark):
    got = plain(op7_warc(spark, DATA).toArrow())
    assert differences(got, plain(duck(DATA).execute(SQL["op7_warc"]).to_arrow_table())) == []
