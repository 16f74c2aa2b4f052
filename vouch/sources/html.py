"""One pass over an HTML page, as an Arrow function for what Spark cannot parse itself."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())
PAGE_FIELDS = T.StructType([
    T.StructField("lang", _S), T.StructField("title", _S), T.StructField("heading", _S),
    T.StructField("description", _S), T.StructField("og_description", _S),
    T.StructField("hrefs", _A), T.StructField("json_ld", _A), T.StructField("text", _S),
    T.StructField("channel_title", _S), T.StructField("channel_description", _S),
])
_ARROW = pa.struct([pa.field(f.name, pa.list_(pa.string()) if f.dataType == _A else pa.string())
                    for f in PAGE_FIELDS.fields])
#: Bytes of HTML that are Python texts at a time.
SLICE_BYTES = 1 << 20
_MUTE = {"script", "style", "noscript", "template"}


class _Reader(HTMLParser):
    """Collects the handful of page parts the evidence rules look at."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {"hrefs": [], "json_ld": []}
        self.chunks: list[str] = []
        self.open: list[list] = []  # part name, tag, depth, chunks
        self.mute: list[str] = []
        self.ld: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        for part in self.open:
            part[2] += part[1] == tag
        if tag == "html" and "lang" not in self.out:
            self.out["lang"] = a.get("lang") or None
        elif tag == "a" and "href" in a:
            self.out["hrefs"].append(a["href"])
        elif tag == "meta":
            if a.get("name") == "description" and "description" not in self.out:
                self.out["description"] = a.get("content", "")
            if a.get("property") == "og:description" and "og_description" not in self.out:
                self.out["og_description"] = a.get("content", "")
        if tag in _MUTE:
            self.mute.append(tag)
            if tag == "script" and a.get("type") == "application/ld+json":
                self.ld = []
        classes = a.get("class", "").split()
        parts = (("title", tag == "title"), ("heading", tag == "h1"),
                 ("channel_title", "tgme_page_title" in classes),
                 ("channel_description", "tgme_page_description" in classes))
        for name, here in parts:
            if here and name not in self.out:
                self.out[name] = ""
                self.open.append([name, tag, 1, []])

    def handle_endtag(self, tag: str) -> None:
        for part in list(self.open):
            part[2] -= part[1] == tag
            if part[2] == 0:
                self.out[part[0]] = " ".join(part[3])
                self.open.remove(part)
        if tag in self.mute:
            del self.mute[self.mute.index(tag):]
            if tag == "script" and self.ld is not None:
                self.out["json_ld"].append("".join(self.ld))
                self.ld = None

    def handle_data(self, data: str) -> None:
        if self.ld is not None:
            self.ld.append(data)
        chunk = data.strip()
        if self.mute or not chunk:
            return
        self.chunks.append(chunk)
        for part in self.open:
            part[3].append(chunk)


def read_page(html: str | None, url: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    for name, _, _, chunks in reader.open:  # never closed
        reader.out[name] = " ".join(chunks)
    out = {f.name: reader.out.get(f.name) for f in PAGE_FIELDS.fields}
    out["text"] = " ".join(reader.chunks)
    out["hrefs"] = [_absolute(url or "", h) for h in out["hrefs"]]
    return out


def _absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


@F.arrow_udf(PAGE_FIELDS)
def page_fields(html: pa.Array, url: pa.Array) -> pa.Array:
    """Struct of page parts. Links are made absolute; text is whole, never cut here."""
    # a slice at a time, so that a batch never stands in memory as Python texts
    done = []
    for start, stop in byte_slices(html):
        pairs = zip(html.slice(start, stop - start).to_pylist(),
                    url.slice(start, stop - start).to_pylist(), strict=True)
        done.append(pa.array([read_page(h, u) for h, u in pairs], _ARROW))
    return pa.concat_arrays(done) if done else pa.array([], _ARROW)


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of about ``most`` bytes; a longer text is a part alone."""
    ends = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum(dtype="int64")
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(base + most, "right")))
        yield start, stop
        start = stop


@F.arrow_udf(_S)
def plain_html(fragment: pa.Array) -> pa.Array:
    """Text of an HTML fragment (entities in structured data), chunks joined as they stand."""
    class Text(HTMLParser):
        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.parts: list[str] = []

        def handle_data(self, data: str) -> None:
            self.parts.append(data)

    def text(t: str | None) -> str | None:
        if t is None or ("&" not in t and "<" not in t):
            return t
        p = Text()
        p.feed(t)
        p.close()
        return "".join(p.parts)

    return pa.array([text(t) for t in fragment.to_pylist()], pa.string())
