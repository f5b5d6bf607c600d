"""Extractors: from the bytes of a document to its text.

An extractor is a function bytes, name -> text. Those for HTML, OOXML and plain text need nothing but the standard library;
services (remote extraction, reading text off pictures) are protocols that a deployment fills in.
"""

from __future__ import annotations

import html.parser
import io
import json
import re
import urllib.request
import uuid
import zipfile
from collections.abc import Callable
from typing import Protocol
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[bytes, str], str]


class Ocr(Protocol):
    """Reads the text off a picture."""

    def read(self, image: bytes, media_type: str) -> str: ...


class _Text(html.parser.HTMLParser):
    BLOCKS = set("p div li ul ol table tr h1 h2 h3 h4 h5 h6 br section article header footer blockquote pre td th title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")
        if tag in self.BLOCKS:
            self.parts.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.parts[-1] += data


def html_text(raw: bytes, name: str = "") -> str:
    """The visible text, blocks apart by a blank line."""
    reader = _Text()
    reader.feed(raw.decode("utf-8", "replace"))
    reader.close()
    return "\n\n".join(p for p in (re.sub(r"\s+", " ", x).strip() for x in reader.parts) if p)


def plain_text(raw: bytes, name: str = "") -> str:
    return raw.decode("utf-8", "replace")


def docx_text(raw: bytes, name: str = "") -> str:
    """The paragraphs that are not empty, one per line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]
    return "\n".join(x for x in lines if x.strip())


def xlsx_text(raw: bytes, name: str = "") -> str:
    """Every sheet under its name, a row a line, cells apart by a bar."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"), 1):
            out.append(f"## {sheet.get('name')}")
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{m}row"):
                cells = []
                for c in row.iter(f"{m}c"):
                    v = c.find(f"{m}v")
                    text = "".join(t.text or "" for t in c.iter(f"{m}t")) if v is None else v.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if any(cells):
                    out.append(" | ".join(cells))
    return "\n".join(out)


BUILT_IN: dict[str, Extractor] = {"html": html_text, "htm": html_text, "docx": docx_text, "xlsx": xlsx_text}


def built_in(raw: bytes, name: str) -> str:
    """By the ending of the name; anything unknown is read as text."""
    return BUILT_IN.get(name.rsplit(".", 1)[-1].lower(), plain_text)(raw, name)


class Remote:
    """An extraction service: POST /extract with the file, GET /formats, GET /health. An empty text is an error."""

    def __init__(self, url: str, timeout: float = 60.0):
        self.url, self.timeout, self._formats = url.rstrip("/"), timeout, None

    def _get(self, path: str):
        with urllib.request.urlopen(f"{self.url}{path}", timeout=self.timeout) as answer:
            return json.load(answer)

    def healthy(self) -> bool:
        try:
            self._get("/health")
        except OSError:
            return False
        return True

    def formats(self) -> list[str]:
        if self._formats is None:
            self._formats = list(self._get("/formats").get("formats", []))
        return self._formats

    def __call__(self, raw: bytes, name: str) -> str:
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        body = head.encode() + raw + f"\r\n--{mark}--\r\n".encode()
        request = urllib.request.Request(f"{self.url}/extract", body, {"Content-Type": f"multipart/form-data; boundary={mark}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            text = json.load(answer).get("content", "")
        if not text:
            raise ValueError(f"nothing was extracted from {name}")
        return text


def chosen(flag: str | None, collection: str | None, default: str | None, known: dict[str, Extractor] | None = None) -> Extractor:
    """The extractor that is named: by the flag, else by the collection, else by default; without a name the built-in one."""
    name = flag or collection or default or "builtin"
    every = {"builtin": built_in} | (known or {})
    if name not in every:
        raise KeyError(f"there is no extractor {name}")
    return every[name]


def extract(files: DataFrame, extractor: Extractor = built_in, key: str = "path", data: str = "content", name: str = "name") -> DataFrame:
    """(key, text, error) of binary files. A file that cannot be read has a null text and says why; the others go on."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, errors = [], []
            for n, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    texts.append(None if raw is None else extractor(raw, n or ""))
                    errors.append(None)
                except Exception as e:  # one broken file must not end the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["key", "text", "error"])

    kind = dict(files.dtypes)[key]
    done = files.select(F.col(key).alias("key"), F.col(name).alias("name"), F.col(data).cast("binary").alias("data")).mapInArrow(run, f"key {kind}, text string, error string")
    return done.withColumnRenamed("key", key)
