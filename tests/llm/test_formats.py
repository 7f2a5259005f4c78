"""Chat trees and WARC records: exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat_trees, warc

MESSAGES = "tree long, node long, parent long, score double, role string, text string"


def _paths(rows):
    """The best branch of every tree, in plain code."""
    trees = {}
    for t, n, p, s, role, text in rows:
        trees.setdefault(t, {})[n] = (p, s or 0.0, role or "", text or "")
    out = {}
    for t, nodes in trees.items():
        inner = {p for p, *_ in nodes.values()}
        best = None
        for leaf in sorted(n for n in nodes if n not in inner):
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][0]
            score = sum(nodes[n][1] for n in path) / len(path)
            if best is None or score > best[0] + 1e-12:
                best = (score, [nodes[n][2:] for n in reversed(path)])
        out[t] = best[1]
    return out


TEXT = st.text(alphabet=st.sampled_from("ab\\<>lg\n</turn> é😀"), max_size=12) | st.none()


@st.composite
def forests(draw):
    rows = []
    for t in range(draw(st.integers(1, 3))):
        for n in range(draw(st.integers(1, 12))):
            rows.append((t, n, draw(st.integers(0, n - 1)) if n and draw(st.booleans()) else (n - 1 if n else 99), float(draw(st.integers(0, 3))), draw(st.sampled_from(["user", "assistant", None, "a>b"])), draw(TEXT)))
    return rows


@given(st.lists(forests(), min_size=40, max_size=40))
@settings(max_examples=1, deadline=None)
def test_best_paths(spark, many):
    """Many forests at once: each gets tree numbers of its own."""
    rows = [(10 * k + r[0], *r[1:]) for k, forest in enumerate(many) for r in forest]
    df = spark.createDataFrame(rows, MESSAGES)
    got = chat_trees.read_back(chat_trees.formatted_paths(df)).collect()
    want = _paths(rows)
    assert {r["tree"]: [tuple(t) for t in r["turns"]] for r in got} == want
    for r in got:
        assert r["loss_texts"] == [text for role, text in want[r["tree"]] if role == "assistant"]


def test_long_chain_null_tree_and_empty(spark):
    rows = [(None, k, k - 1 if k else None, 0.0, "assistant" if k % 2 else "user", f"turn {k}") for k in range(150)]
    df = spark.createDataFrame(rows, MESSAGES)
    got = chat_trees.read_back(chat_trees.formatted_paths(df)).collect()
    assert len(got) == 1 and [t["text"] for t in got[0]["turns"]] == [r[5] for r in rows] and got[0]["tree"] is None
    assert chat_trees.formatted_paths(df.where(F.lit(False))).count() == 0
    assert chat_trees.formatted_paths(df.union(df)).first()["n_turns"] == 150


def test_cycles_are_refused(spark):
    with pytest.raises(ValueError):
        chat_trees.formatted_paths(spark.createDataFrame([(1, 1, 2, 0.0, "user", "a"), (1, 2, 1, 0.0, "user", "b")], MESSAGES))


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, None, 0.0, "user", "a")], MESSAGES)
    plan = chat_trees.read_back(chat_trees.formatted_paths(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_linear_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", None), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_trees.read_back(chat_trees.formatted_paths(chat_trees.linear_messages(df))).first()
    assert [tuple(t) for t in got["turns"]] == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]


PAGE = '<!DOCTYPE html><html lang="fr"><head><title>T &amp; U</title><style>p{x}</style><script>var t="</p>";</script></head><body><nav><a href="/a?x=1&amp;y=2">L</a></nav><!-- no --><p>One<br>two &lt;3</p><div>three <b>bold</b></div></body></html>'


def test_derivatives(spark):
    pages = spark.createDataFrame([(1, "http://x/1", PAGE, "clash"), (2, None, None, "clash"), (None, "http://x/2", "a < b <p>c", "x"), (1, "http://x/1", PAGE, "clash")], "page_id long, url string, html string, record string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 8
    for r in made:
        headers, block = warc.parse(r["record"])
        assert block.decode() == r["block"] and headers["warc-refers-to"] == r["refers_to"] and headers["warc-block-digest"] == warc.digest(block)
    first = next(r for r in made if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert first["block"] == "L\nOne\ntwo <3\nthree bold"
    source, http_block = warc.parse(warc.response(1, "http://x/1", PAGE))
    assert first["refers_to"] == source["warc-record-id"] and first["source_digest"] == warc.digest(PAGE.encode()) == source["warc-payload-digest"]
    about = next(r for r in made if r["page_id"] == 1 and r["warc_type"] == "metadata")["block"]
    assert "title: T & U" in about and "outlink: /a?x=1&y=2" in about and "language: fr" in about and "http-content-type: text/html; charset=utf-8" in about
    assert next(r for r in made if r["page_id"] == 2 and r["warc_type"] == "conversion")["block"] == ""
    assert warc.derivatives(warc.responses(pages.where(F.lit(False)))).count() == 0


@given(st.binary(max_size=200), st.text(max_size=30))
@settings(max_examples=100, deadline=None)
def test_records_round_trip(block, url):
    headers, got = warc.parse(warc.serialise([("WARC-Type", "response"), ("WARC-Target-URI", url.replace("\r", "").replace("\n", "").strip())], block))
    assert got == block and headers["warc-type"] == "response"


def test_other_charset_and_plain_block():
    record = warc.serialise([("WARC-Record-ID", "<r>"), ("WARC-Target-URI", "u")], b"HTTP/1.1 404 No\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9")
    assert warc.derive(record)[1][1].decode() == "café" and b"http-status: HTTP/1.1 404 No" in warc.derive(record)[0][1]
    assert warc.derive(warc.serialise([], b"<p>x"))[1][1] == b"x"
    assert hashlib.sha1(b"").hexdigest() and warc.digest(b"").startswith("sha1:")


def _naive_tags(text):
    """Tags by walking on from each one's first letter, character by character."""
    out, at = [], 0
    for i in range(len(text) - 1):
        if i < at or text[i] != "<" or not (text[i + 1] in "/!?" or text[i + 1].isascii() and text[i + 1].isalpha()):
            continue
        quote, end = None, -1
        for j in range(i + 1, len(text)):
            if quote:
                quote = None if text[j] == quote else quote
            elif text[j] in "\"'":
                quote = text[j]
            elif text[j] == ">":
                end = j
                break
        if end < 0:
            end = text.find(">", i)
        if end < 0:
            break
        out.append((i, end + 1))
        at = end + 1
    return out


@given(st.text(alphabet=st.sampled_from("<>\"'/ap !b"), max_size=40))
@settings(max_examples=1000, deadline=None)
def test_tags(text):
    assert [(a, b) for a, b, _ in warc.tags(text)] == _naive_tags(text)


@pytest.mark.parametrize("part", ['<a "', "<a ", "<p ", "<title>", "<html ", '<a "> "', '<a href="', "<!--", "<script", "<script>x</script ", "'", "< "])
def test_hostile_pages_are_linear(part):
    """Hundreds of kilobytes of one unfinished thing."""
    import time

    start = time.process_time()
    for page in (part * 60_000, part * 60_000 + "'>", part * 60_000 + '">'):
        warc.derive(warc.response(1, "u", page))
    assert time.process_time() - start < 5


def test_page_fields():
    page = """<!doctype html><HTML xml:lang='x' lang=de-CH><head><Title a="b">One &amp;
    two</title ><style>p > q</style></head><body><p title="a > b">Hi <b>there</b><br>you</p><a class=x HREF='l?a=1&amp;b'>l</a><a name=n>no</a><a
    href = "m n">m</a><!-- <a href=z> --></body>"""
    assert warc.title_of(page).split() == ["One", "&amp;", "two"] and warc.language_of(page) == "x"
    assert warc.links_of(page) == ["l?a=1&amp;b", "m n", "z"]
    assert warc.plain_text(page) == "Hi there\nyou\nlnom"
    assert warc.links_of("") == [] and warc.title_of("<title>x") is None and warc.plain_text("a < b > c") == "a < b > c"


def test_query(spark):
    """The registered query against digests and names computed apart, over a whole table."""
    import base64
    import hashlib
    import uuid

    from plumbline.llm.queries import op9_warc

    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = op9_warc(spark, "/root/testdata/sf0.001").collect()
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    name = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, x)))}>"
    assert len(got) == 2 * len(pages) and {(r["page_id"], r["warc_type"]) for r in got} == {(i, k) for i in pages for k in ("metadata", "conversion")}
    for r in got:
        url, html = pages[r["page_id"]]["url"] or "", (pages[r["page_id"]]["html"] or "").encode()
        source = name("response", r["page_id"], url)
        assert (r["target_uri"], r["refers_to"], r["record_id"]) == (url, source, name(r["warc_type"], source))
        assert r["source_digest"] == sha(html) and r["block_digest"] == sha(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        if r["warc_type"] == "metadata":
            fields = [x.partition(": ")[::2] for x in r["block"].split("\r\n")[:-1]]
            assert ("source-payload-digest", sha(html)) in fields and ("http-status", "HTTP/1.1 200 OK") in fields and ("http-content-length", str(len(html))) in fields
        else:
            assert "<p" not in r["block"] and not any(x != x.strip() or not x for x in r["block"].split("\n")[1:-1])
