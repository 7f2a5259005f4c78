"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response record's block is an HTTP message.  Its derivatives name it in
WARC-Refers-To, keep its target URI and date, carry its HTTP status and headers and
its payload digest, and have digests of their own blocks.  Records are WARC/1.1 bytes.

Rules: null url or html counts as empty.  Blocks that are no HTTP message are taken as
a payload without headers.  Repeated rows give repeated records with equal ids.  Text
that is not in the stated character set is decoded with replacement marks.  An empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Pages carry no date; records say so with this one unless told another.
NO_DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
_EOL = b"\r\n"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = ((k, re.sub(r"[\r\n]+", " ", v)) for k, v in headers)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + _EOL * 2


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = record.partition(_EOL * 2)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(_EOL * 2)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Elements that stand on lines of their own (fixed values).
_BLOCKS = frozenset("p div br hr li ul ol dl dt dd table tr h1 h2 h3 h4 h5 h6 section article aside header footer nav main pre blockquote form figure figcaption body html title td th".split())
_OPEN = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[/!?])")
_MARK = re.compile(r"""["'>]""")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_CLOSED = re.compile(r"</title\s*>", re.I)
_LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?=[^\s>])""", re.I)
_VALUE = re.compile(r""""([^"]*)"|'([^']*)'|([^\s>]+)""")
_HEADS = {k: re.compile(rf"<{k}\b", re.I) for k in ("title", "html", "a")}


def tags(text: str):
    """(start, end, name in lower case or "") of each tag, in time linear in the text.

    A tag ends at the first ``>`` outside quotes, or at the first one if a quote in it is
    never closed; without any ``>`` there is no tag.  Where a tag ends that stands outside
    quotes at a quote or a ``>`` is worked out once for all of these, from the last one back."""
    place = [m.start() for m in _MARK.finditer(text)]
    n = len(place)
    close, first, again = [-1] * (n + 1), [-1] * (n + 1), {'"': -1, "'": -1}
    for k in range(n - 1, -1, -1):
        c = text[place[k]]
        if c == ">":
            close[k] = first[k] = place[k]
        else:
            first[k] = first[k + 1]
            if again[c] >= 0:
                close[k] = close[again[c] + 1]
            again[c] = k
    at = k = 0
    for m in _OPEN.finditer(text):
        if m.start() < at:
            continue
        while k < n and place[k] < m.start():
            k += 1
        end = close[k] if close[k] >= 0 else first[k]
        if end < 0:
            return
        at = end + 1
        yield m.start(), at, (m[1] or "").lower()


def plain_text(page: str) -> str:
    """What a page shows, a line for each block."""
    page, out, at = _HIDDEN.sub(" ", page), [], 0
    for start, end, name in tags(page):
        out += (page[at:start], "\n") if name in _BLOCKS else (page[at:start],)
        at = end
    out.append(page[at:])
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)))).strip()


def _heads(page: str, name: str):
    """(start, end) of what follows each ``<name`` up to the next ``>``; such stretches do not
    overlap, so they are linear in the page together."""
    at = 0
    while m := _HEADS[name].search(page, at):
        end = page.find(">", m.end())
        at = end if end >= 0 else len(page)
        yield m.end(), at


def title_of(page: str) -> str | None:
    for _, end in _heads(page, "title"):
        closed = _CLOSED.search(page, end + 1)
        return page[end + 1 : closed.start()] if closed else None
    return None


def language_of(page: str) -> str | None:
    for start, end in _heads(page, "html"):
        if m := _LANG.search(page, start, end):
            return m[1]
    return None


def links_of(page: str) -> list[str]:
    out = []
    for start, end in _heads(page, "a"):
        if m := _HREF.search(page, start, end):
            value = _VALUE.match(page, m.end())
            out.append(value[1] or value[2] or value[3] or "")
    return out


def response(page_id: object, url: str, page: str, date: str = NO_DATE) -> bytes:
    """A response record of a page."""
    payload = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url)), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return serialise(headers, block)


def derive(record: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the metadata and the conversion record of a response."""
    source, block = parse(record)
    status, http, payload = parse_http(block)
    kinds = {k.lower(): v for k, v in http}
    charset = re.search(r"charset=\"?([\w-]+)", kinds.get("content-type", ""), re.I)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    own, uri, date = source.get("warc-record-id", ""), source.get("warc-target-uri", ""), source.get("warc-date", NO_DATE)
    payload_digest = source.get("warc-payload-digest") or digest(payload)
    title, lang = title_of(page), language_of(page)
    one = lambda x: re.sub(r"\s+", " ", html.unescape(x)).strip()
    fields = [("source-payload-digest", payload_digest), ("source-block-digest", source.get("warc-block-digest") or digest(block)), ("http-status", status)]
    fields += [(f"http-{k.lower()}", v) for k, v in http]
    if title is not None:
        fields.append(("title", one(title)))
    if lang:
        fields.append(("language", lang))
    fields += [("outlink", one(x)) for x in links_of(page)]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = plain_text(page).encode()
    shared = [("WARC-Refers-To", own), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    return [
        ([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", own)), *shared, ("WARC-Block-Digest", digest(about)), ("Content-Type", "application/warc-fields")], about),
        ([("WARC-Type", "conversion"), ("WARC-Record-ID", record_id("conversion", own)), *shared, ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain; charset=utf-8")], text),
    ]


def _parts(column):
    """Ranges of a batch's rows that hold about SCAN_BYTES together, one row at least."""
    return slices(pc.fill_null(pc.binary_length(column), 0).to_pylist())


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """page_id and ``record``, the bytes of a response, of every row of ``pages``."""

    def run(batches):
        for batch in batches:
            for a, b in _parts(batch.column(2)):
                rows = zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in range(3)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([response(i, u or "", h or "", date) for i, u, h in rows], pa.binary())], names=["page_id", "record"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, record binary")


_OUT = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, content_length long, block string, record binary"


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response in ``records`` (page_id, record): its metadata and its
    conversion, as columns and as the bytes ``record``."""

    def run(batches):
        kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for a, b in _parts(batch.column(1)):
                out = []
                for page_id, record in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in range(2)), strict=True):
                    made = derive(record)
                    named = dict(made[1][0])
                    for headers, block in made:
                        h = dict(headers)
                        out.append((page_id, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Target-URI"], named["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], len(block), block, serialise(headers, block)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return records.select("page_id", "record").mapInArrow(run, _OUT)
