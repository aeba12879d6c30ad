"""WARC round trips and HTML extraction."""

import base64
import gzip
import hashlib
import io
import json
import re
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from servicelens.llm import html_text, warc

PAGES = [(3, "http://a/", "<p>same</p>"), (1, "http://b/ x\r\ny", "<p>same</p>"), (2, None, None), (4, "http://c/", ""),
         (5, "http://d/é", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n"), (None, "http://e/", "<p>same</p>"), (None, "http://f", "own"),
         (6, "u", "once"), (6, "u", "once")]


@pytest.fixture
def pages(rows):
    return rows("page_id bigint, url string, html string, digest string, URL string", *((*p, "x", "y") for p in PAGES))


@pytest.mark.parametrize("archive_bytes, digests", [(64_000_000, 100_000), (100, 0)])
def test_round_trip(pages, tmp_path, monkeypatch, archive_bytes, digests):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    folder = f"file://{tmp_path}"
    archives = warc.write_archives(pages, folder, broadcast_digests=digests)
    index = warc.normalise(archives, folder)
    found = warc.read_records(index, folder).collect()
    firsts = {}
    for page_id, _, text in PAGES:
        if page_id is not None:
            firsts[text or ""] = min(page_id, firsts.get(text or "", page_id))
    wanted = []
    for page_id, _, text in PAGES:
        data = (text or "").encode()
        first = firsts.get(text or "")
        again = first is not None and page_id != first
        wanted.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                       "revisit" if again else "response", first if again else None, None if again else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in found), key=str) == sorted(wanted, key=str)


def test_each_record_is_a_member_and_the_sidecar_tells_where(pages, tmp_path):
    folder = f"file://{tmp_path}"
    index = warc.normalise(warc.write_archives(pages, folder), folder).collect()
    assert len(index) == len(PAGES)
    for path in {r.path for r in index}:
        data = open(path, "rb").read()
        lines = [x.split(" ") for x in open(f"{path}.idx", encoding="utf-8").read().splitlines()]
        assert sum(int(n) for _, _, n in lines) == len(data)
        for name, offset, length in lines:
            record = gzip.decompress(data[int(offset):int(offset) + int(length)])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            assert warc.parse_record(record)[0]["WARC-Record-ID"] == name


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_streams_of_any_chunking(step, monkeypatch):
    monkeypatch.setattr(warc, "STEP", step)
    records = [warc.encode_record(i, "u", bytes([i]) * i * 50, None, False) for i in range(6)]
    whole = gzip.compress(b"".join(records[:4])) + gzip.compress(b"".join(records[4:]))
    assert list(warc.split_records(warc.inflated(io.BytesIO(whole)))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(warc.inflated(io.BytesIO(gzip.compress(records[5][:-10])))))


def test_no_revisits_below_the_limit(pages, tmp_path):
    folder = f"file://{tmp_path}"
    index = warc.normalise(warc.write_archives(pages, folder, least_revisit=100), folder)
    assert {r.record_type for r in warc.read_records(index, folder).collect()} == {"response"}


def test_empty_pages(pages, tmp_path):
    folder = f"file://{tmp_path}"
    index = warc.normalise(warc.write_archives(pages.limit(0), folder), folder)
    assert warc.read_records(index, folder).count() == 0


# HTML

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  &amp; simple", "plain & simple"), ("a < b &lt; c", "a < b < c"),
    ("<article><h1>T</h1><p><b>T<br><p>One&nbsp;two</p></article><footer>f</footer>", "T T One two"),
    ("<nav>menu</nav><article>x<b>y</b>z<p>q\n  r</article>tail", "xyz q r"),
    ("<body><header>h</header><main><div>A</div><aside>s</aside><div class='ad-slot'>ad</div>B</main></body>", "A B"),
    ("<article>ok<section id=comments><p>no</section><form><input value=x>f<button>b</button></form></article>", "ok"),
    ("<article>t<script>var a='</p><p>'</script><style>p{}</style><!-- c > <p> -->u</article>", "tu"),
    ("<p class=\"cookie-notice\">n</p><p title='a > b'>kept</p>", "kept"),
    ("<div role=main>in</div><div>out</div>", "in"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a b c"), ("<article>&#233;&eacute;&#x1F600;&copy;&unknown;</article>", "éé\U0001F600©&unknown;"),
    ("<article>x</article><article>y</article>", "x y"), ("<p>a</p></div></b><p>b", "a b"),
    ("<article><pre>a\n b</pre>c<hr>d</article>", "a b c d"), ("<title>t</title><p>x", "x"), ("<p hidden>h</p>v", "v"),
    ("<article class='post has-ad'>kept</article>", "kept"), ("x<span class=share>s</span>y", "xy"), ("<p>1 <a href=x>2</a>, 3", "1 2, 3"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    long = "<article>" + "<p>some words</p>" * 50_000 + "</article>"
    assert len(html_text.main_text(long)) == 50_000 * 11 - 1


def whole(*pages):
    """[pages, nodes, digests] as the host's tasks make them."""
    one = [[1, html_text.page_wrapper(html_text.parse(p)), [html_text._digest(html_text.main_text(p))]] for p in pages]
    return html_text.merged_all(one)


def wrapper(*pages):
    return whole(*pages)[1]


def test_alignment_finds_slots_repeats_and_options():
    found = wrapper("<div><h1>A</h1><p>x</p><p>y</p></div><h6>same</h6>", "<div><h1>B</h1><table></table><p>z</p></div><h6>same</h6>")
    div, end = found
    assert [n[0] for n in div[3]] == ["h1", "table", "p"]
    heading, table, paragraph = div[3]
    assert heading[3] == [["#", 2, "", 0]]                      # a slot
    assert (table[1], heading[1]) == (1, 2)                     # shown by one page of two
    assert paragraph[2]                                         # repeated
    assert end[3][0][2:] == [html_text._digest("same"), 2]      # fixed text
    pairs = wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>", "<dl><dt>q<dd>r<dt>s<dd>t<dt>u<dd>v</dl>")
    assert [(n[0], n[2]) for n in pairs[0][3]][-1] == ("(dt dd)", True)


def test_neighbours_of_equal_pages_are_not_folded():
    nodes = wrapper(*(f"<div><p>Slogan</p></div><div><p>{i}</p></div>" for i in range(4)))
    assert [n[0] for n in nodes] == ["div", "div"] and nodes[0][3][0][3] == [["#", 4, html_text._digest("Slogan"), 4]]


SLOGAN = "<div><p>Site slogan</p></div><div><p>{}</p></div>"


def test_template_text_outside_articles_goes(rows):
    table = rows("page_id bigint, url string, html string, wrapper string, HOST int",
                 *((i, f"http://one.example/{i}", SLOGAN.format(f"story {i}"), "", 0) for i in range(9)),
                 (10, "http://two.example/", SLOGAN.format("alone"), "", 0), (11, None, SLOGAN.format("no url"), "", 0),
                 (12, "http://one.example/x", None, "", 0), (13, "http://one.example/y", "<div><p>odd</p></div>", "", 0),
                 (3, "http://one.example/3", SLOGAN.format("story 3"), "", 0),
                 *((20 + i, None, SLOGAN.format(f"nowhere {i}"), "", 0) for i in range(5)))
    found = sorted((r.page_id, r.text) for r in html_text.extract(table.repartition(3)).collect())
    assert found == sorted([*((i, f"story {i}") for i in range(9)), (3, "story 3"), (10, "Site slogan alone"),
                            (11, "Site slogan no url"), (12, ""), (13, "odd"),
                            *((20 + i, f"Site slogan nowhere {i}") for i in range(5))])


BLOG = ("<div class=top><h2>The Daily</h2><p>News since 1900</p></div><div class=text><h1>Title {0}</h1>{1}<p>Support us today.</p>"
        "</div><div><p>Printed in Rome</p></div>")


def blog(n, paragraphs):
    return BLOG.format(n, "".join(f"<p>part {i} of {n}</p>" for i in range(paragraphs)))


def test_wrappers_decide_where_no_mark_does(rows):
    """Sites without any telling tag or class: the text is what their pages do not share."""
    sizes = [3, 1, 5, 2, 4, 3, 7, 1, 2, 6, 3, 3]
    table = rows("page_id bigint, url string, html string",
                 *((i, f"https://blog.example/{i}", blog(i, n)) for i, n in enumerate(sizes)))
    for parts in (1, 4):
        found = {r.page_id: r.text for r in html_text.extract(table.repartition(parts)).collect()}
        assert found == {i: " ".join([f"Title {i}", *(f"part {k} of {i}" for k in range(n))]) for i, n in enumerate(sizes)}
    for i, n in enumerate(sizes):
        assert "Support us today." in html_text.main_text(blog(i, n))          # without the wrapper


def test_one_odd_page_does_not_turn_a_wrapper_off():
    pages = [blog(i, 1 + i % 4) for i in range(12)]
    odd = ["<h1>Gone</h1><p>moved</p>", BLOG.replace("Support us today.", "Read on.").format(99, "<p>a</p>")]
    for made in (pages + odd, odd + pages, pages[:6] + odd + pages[6:]):
        known = whole(*made)
        assert html_text.main_text(pages[5], known) == "Title 5 part 0 of 5 part 1 of 5"
        assert html_text.main_text(odd[1], known) == "Title 99 a Read on."
        assert html_text.main_text(odd[0], known) == "Gone moved"


def test_wrapper_size_follows_the_template():
    """Pages that each have parts of their own: the wrapper stays as large as some pages."""
    def page(i):
        own = "".join(f"<{t}>{i}</{t}>" for t in (f"x{i % 97}", f"y{i % 89}", f"z{i % 83}"))
        return f"<div><h1>{i}</h1>{own}<p>Contact us</p></div>"

    sizes = {n: len(json.dumps(whole(*map(page, range(n))))) for n in (50, 200, 800)}
    assert sizes[800] < 1.3 * sizes[50] and sizes[800] < 10 * len(json.dumps(whole(page(0))))
    assert html_text.main_text(page(5), whole(*map(page, range(200)))) == "5 5 5 5"


def slow_likest(a, b):
    """The most that any alignment of two levels can be worth, by trying all."""
    if not a or not b:
        return 0
    return max(slow_likest(a[1:], b), slow_likest(a, b[1:]),
               slow_likest(a[1:], b[1:]) + html_text._likeness(a[0], b[0]) if html_text._likeness(a[0], b[0]) else 0)


LEVEL = st.lists(st.tuples(st.sampled_from("pqr"), st.sampled_from("xyz ")), max_size=5)


def level(nodes):
    return [[n, 1, False, [["#", 1, t, 1]] if t.strip() else []] for n, t in nodes]


@settings(max_examples=200, deadline=None)
@given(LEVEL, LEVEL)
def test_alignment_is_the_likest(a, b):
    """Without folding, what is merged is worth as much as the best of all alignments."""
    a, b = level(a), level(b)
    if [n[0] for n in a] == [n[0] for n in b]:
        return
    with mock.patch.object(html_text, "fold", lambda nodes, pages: nodes), \
            mock.patch.object(html_text, "_same", lambda x, y, one: [x[0], 2, html_text._likeness(x, y), []]):
        done = html_text.align(a, b, 1, 1)
    assert sum(n[2] for n in done if n[1] == 2) == slow_likest(a, b)
    assert len(done) + sum(n[1] == 2 for n in done) == len(a) + len(b)


def test_extract_follows_the_article_on_all_hosts(rows):
    table = rows("page_id bigint, url string, html string",
                 *((i, f"https://h{i % 3}.example/{i}", f"<nav>m</nav><article><h1>{i}</h1><p>same line</p></article>")
                   for i in range(30)))
    assert {r.page_id: r.text for r in html_text.extract(table.repartition(5)).collect()} == {
        i: f"{i} same line" for i in range(30)}
    assert html_text.extract(table.limit(0)).count() == 0
    wrappers = html_text.infer_wrappers(table.repartition(5)).collect()
    assert len(wrappers) == 3 and all(re.match(r"\[10, ", w.wrapper) for w in wrappers)


STORY = "<nav>m</nav><article><h1>Title {0}</h1><p>story {0} has words<p>and {0} more<div>Read <a href=x>on</a> here</div>{1}</article>"


def test_template_text_inside_articles_goes(rows):
    pages = [STORY.format(i, f"<table><tr><td>only page {i}</table>" if i == 2 else "") for i in range(6)]
    table = rows("page_id bigint, url string, html string",
                 *((i, "http://one.example/", p) for i, p in enumerate(pages)),
                 *((10 + i, "http://copies.example/", pages[0]) for i in range(6)),
                 *((20 + i, "http://two.example/", p) for i, p in enumerate(pages[:2])))
    found = {r.page_id: r.text for r in html_text.extract(table.repartition(5)).collect()}

    def text(i, end):
        return f"Title {i} story {i} has words and {i} more{end}"

    assert found == {**{i: text(i, " only page 2" if i == 2 else "") for i in range(6)},
                     **{10 + i: text(0, " Read on here") for i in range(6)},
                     **{20 + i: text(i, " Read on here") for i in range(2)}}


def test_what_a_wrapper_cannot_tell_stays():
    pages = [*(STORY.format(i, "") for i in range(3)), STORY.format(3, "<section><h2>Part</h2></section>")]
    known = whole(*pages)
    assert html_text.main_text(pages[3], known) == "Title 3 story 3 has words and 3 more Part"    # perhaps of one page
    assert html_text.main_text(pages[3], whole(*pages[2:])).endswith("Read on here Part")         # too few pages
    assert html_text.main_text(pages[0], whole(*pages[:1] * 9)).endswith("Read on here")          # copies only


@pytest.mark.parametrize("page, text", [
    ("<article>a<article class=comment>c</article><div>b</div></article>", "a b"),
    ("<article>a</article><article class='teaser card'>t</article>", "a"),
    ("<article><p class='ad-hoc'>a</p><p id='share-price'>b</p><div class='social-science'>c</div></article>", "a b c"),
    ("<article><div class='entry-header'><h1>T</h1></div><div class='post-comments'>no</div>x</article>", "T x"),
    ("<article><header><h1>T</h1></header><p>x</p></article><header>no</header>", "T x"),
    ("<article>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</article>", "a x=1 b"),
    ("<div role=article>in</div><div>out</div>", "in"), ("<div class='site-header'>no</div><div class='related-posts'>no</div>x", "x"),
    ("<div class='sidebar-left'>no</div><div class='no-sidebar'>x</div><p class='menu-item-12'>no</p>", "x"),
])
def test_which_parts_belong_to_an_article(page, text):
    assert html_text.main_text(page) == text


def nested(inner, tag="div", levels=2 * html_text.DEPTH):
    return f"<{tag}>" * levels + inner + f"</{tag}>" * levels


@pytest.mark.parametrize("page, text", [
    (f"<div><article>{nested('a')}after<p>end</article></div>out", "a after end"),
    (nested("a<nav>menu<div>m</div></nav>b<div class=comments>c<div>d</div>e</div>f"), "a b f"),
    (nested("a<div>b</div>c<b>d</b>e<p>f<p>g"), "a b cde f g"),
    (nested("out<article>in<div>x</div>y<article>z</article>end</article>out"), "in x y z end"),
    (nested(f"a<aside>{nested('x<article>y</article>', 'aside')}</aside>b"), "a b"),
    (nested("<ul><li>a<li>b<ul><li>c</ul></ul>"), "a b c"),
])
def test_levels_beyond_the_depth(page, text):
    assert html_text.main_text(page) == text
    assert html_text.main_text(page, whole(page, page, page)) == text
