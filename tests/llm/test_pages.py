"""WARC round trip and main texts of pages."""

import base64
import hashlib

import pytest

from ledgerloom.llm import warc, wrapper

SCHEMA = "page_id bigint, url string, html string, digest int, host string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", "t") for r in rows], SCHEMA)


ROWS = [
    (1, "http://a.example/x?y=1", "<p>one"), (2, "http://a.example/", "<p>one"), (3, None, None), (4, "a\r\nb", ""), (5, "u", "a\r\n\r\nWARC/1.1\r\n\r\né😀"),
    (None, "u", "<p>one"), (2, "v", "<p>one"), (6, "w", "x" * 200_000), (7, "w", "y"), (7, "w", "y"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    captures = warc.archive(pages(spark, ROWS), least_bytes=least)
    found = warc.page_digests(captures).collect()
    newest = {}
    for key, _, html in ROWS:
        newest[html or ""] = max(newest.get(html or "", -1), -1 if key is None else key)
    expected = []
    for key, _, html in ROWS:
        data = (html or "").encode()
        top = newest[html or ""]
        revisit = key != top and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append(str((key, len(data), digest, "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found) == sorted(expected)
    assert all(r.digest_ok for r in found if r.record_type == "response")


def test_captures_are_nested(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    warc.write(warc.capture_records(pages(spark, ROWS)), path, records_per_file=4)
    rows = warc.assemble(warc.read(spark, path)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.main.record_id == r.request.concurrent_to == r.metadata.concurrent_to == r.capture_id
    by = {r.metadata.fields.get("page-id"): r for r in rows}
    assert bytes(by["5"].main.payload).decode() == ROWS[4][2]
    revisit = by["1"].main
    assert revisit.record_type == "revisit" and revisit.refers_to in {r.capture_id for r in rows}
    assert warc.archive(pages(spark, [])).count() == 0


def test_parts_may_be_missing(spark):
    schema = "record_id string, record_type string, concurrent_to string"
    records = spark.createDataFrame([("a", "response", None), ("m", "metadata", "b"), ("c", "request", "c0"), ("d", "response", "")], schema)
    found = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert set(found) == {"a", "b", "c0", "d"} and found["b"].main is None and found["a"].request is None


def test_a_damaged_archive_is_an_error():
    whole = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [block for _, block in warc.parse(whole * 2)] == [b"abc", b"abc"]
    for broken in (whole[:-3], whole.replace(b"3", b"2"), b"junk" + whole):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


ARTICLES = [
    ("<body><nav>Menu<p>x</nav><p>Hello&nbsp;<b>big</b>\n world<p>two</body>", "Hello big world\n\ntwo"),
    ("plain &amp; &lt;b&gt; &#233;", "plain & <b> é"), ("", ""), ("<p>", ""),
    ("<article class='post'>A<header>H</header><p>B</p><section id=comments><p>c</p></section></article><aside><article>no</article></aside>", "A\n\nB"),
    ("<nav><ul><li>a<article><p>Text</p></article>", "Text"),
    ("<div class='cookie-notice'>c</div><div class='content has-sidebar'><p>T</p></div>", "T"),
    ("<form>x<p>y</form><p>z<script>if(a<b){}</script><style>p{}</style><!-- c -->", "z"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p>unfinished <a href='x", "unfinished"),
    ("<ul><li>a<li>b</ul>c<br>d", "a\n\nb\n\nc d"), ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>s</div>t", "t"),
    ("<article><p>a</p><article class='comment'>reader</article></article>", "a"), ("<button>press</button><p>" + "é " * 50_000, ("é " * 50_000).strip()),
    ("<article><h1>T</h1><p><b>one.<br><p>two</p></article><footer>&copy; f</footer>", "T\n\none.\n\ntwo"), ("a < b > c", "a < b > c"),
]


@pytest.mark.parametrize("html, text", ARTICLES)
def test_main_text(html, text):
    assert wrapper.main_text(wrapper.parse(html), [])[0] == text


def site(i, article):
    paragraphs = "".join(f"<p>{p}</p>" for p in article)
    return f"<body><p>Welcome to the site</p><div><p>We use some things</p></div>{paragraphs}<p>End of page</p></body>"


def test_constant_blocks_are_template(spark):
    rows = [(i, "http://One.example:80/p", site(i, [f"text {i} {j}" for j in range(i % 4 + 1)])) for i in range(30)]
    rows += [(100, "https://other.example/", site(0, ["alone"])), (101, None, None), (102, "https://other.example/", ""), (None, "https://one.example", "<p>n</p>")]
    rows += [(200, "http://same.example/1", "<p>copy</p>")] * 3
    out = wrapper.extract(pages(spark, rows))
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    for i in range(30):
        assert found[i].text == "\n\n".join(f"text {i} {j}" for j in range(i % 4 + 1)) and found[i].n_template == 3
    # A host with one page has nothing to compare with, and copies say nothing about each other.
    assert found[100].text.startswith("Welcome") and found[101].text == "" and found[102].n_chars == 0
    assert found[None].text == "n" and found[200].text == "copy"
    assert wrapper.extract(pages(spark, [])).count() == 0


def test_matching_maps_the_most_nodes():
    page = wrapper.parse("<div><p>x</p><ul><li>1</li></ul><p>same</p></div>")
    sample = wrapper.parse("<div><p>same</p><ul><li>2</li><li>1</li></ul></div>")
    texts = {leaf.text for leaf in wrapper.leaves(page) if id(leaf) in wrapper.constant_leaves(page, sample)}
    assert texts == {"1"}
