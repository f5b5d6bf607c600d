"""Cutting texts into chunks, with line numbers, and putting context around a hit.

Cutting is a fold over the lines of one text, so it runs in Arrow batches, a text at a time; texts are never joined up.
Sizes are counted in bytes of UTF-8, but no sign is ever cut in two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: sizes in bytes
CHUNK_BYTES, OVERLAP_BYTES = 1000, 100


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _tail(text: str, size: int) -> str:
    """The last `size` bytes of a text, whole signs only."""
    return text.encode("utf-8", "surrogatepass")[-size:].decode("utf-8", "ignore") if size else ""


def _sections(text: str) -> Iterator[str]:
    """Stretches that begin at lines whose first sign is #."""
    part: list[str] = []
    for line in text.split("\n"):
        if line.strip().startswith("#") and part:
            yield "\n".join(part)
            part = []
        part.append(line)
    yield "\n".join(part)


def markdown_chunks(text: str, most: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[str]:
    """A chunk per section; a section beyond `most` bytes is cut between paragraphs, each piece led by the end of the one before.

    A paragraph that alone exceeds the size stays whole. With the lead a chunk may exceed `most` by the overlap and a blank line.
    """
    most, overlap = (most if most > 0 else CHUNK_BYTES), (overlap if overlap > 0 else OVERLAP_BYTES)
    out = []
    for section in map(str.strip, _sections(text)):
        if not section:
            continue
        if _size(section) <= most:
            out.append(section)
            continue
        held = ""
        for paragraph in filter(None, map(str.strip, section.split("\n\n"))):
            if held and _size(held) + _size(paragraph) + 2 > most:
                out.append(held.strip())
                held = _tail(held, overlap) + "\n\n" if _size(held) > overlap else ""
            held += paragraph + "\n\n"
        if held.strip():
            out.append(held.strip())
    return out


def conversation_chunks(text: str, most: int = CHUNK_BYTES) -> list[str]:
    """Lines gathered up to `most` bytes, without overlap; a line beyond that is a chunk of its own. Blank chunks are left out."""
    most = most if most > 0 else CHUNK_BYTES
    out, held, size = [], [], 0
    for line in text.split("\n"):
        n = _size(line) + 1
        if held and size + n > most:
            out.append("\n".join(held).strip())
            held, size = [], 0
        held.append(line)
        size += n
    return [c for c in [*out, "\n".join(held).strip()] if c]


def _windows(line: str, most: int, overlap: int) -> list[str]:
    """A line of any length as windows of `most` bytes that overlap."""
    raw = line.encode("utf-8", "surrogatepass")
    step = most - (overlap if overlap < most else most // 2)
    return [w for at in range(0, len(raw), max(step, 1)) if (w := raw[at : at + most].decode("utf-8", "ignore")) and (at == 0 or at + most - step < len(raw))]


def code_chunks(text: str, most: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> list[str]:
    """Blocks between blank lines gathered up to `most` bytes, each chunk led by the last lines of the one before; a block
    beyond that is gathered line by line, and a line beyond that is cut into windows."""
    most, overlap = (most if most > 0 else CHUNK_BYTES), (overlap if overlap >= 0 else OVERLAP_BYTES)
    text = text.strip()
    if not text:
        return []
    if _size(text) <= most:
        return [text]
    out: list[str] = []
    held = ""

    def flush() -> None:
        nonlocal held
        if held.strip():
            out.append(held.strip("\n"))
        held = ""

    for block in (b.strip("\n") for b in text.replace("\r\n", "\n").split("\n\n")):
        if not block.strip():
            continue
        if _size(block) > most:
            flush()
            for line in block.split("\n"):
                if _size(line) + 1 > most:
                    flush()
                    out += _windows(line, most, overlap)
                    continue
                if held and _size(held) + _size(line) + 1 > most:
                    flush()
                held += line + "\n"
            flush()
            continue
        if held and _size(held) + _size(block) + 2 > most:
            lead, size = [], 0
            for line in reversed(held.rstrip("\n").split("\n")):
                size += _size(line) + 1
                if lead and size > overlap:
                    break
                lead.insert(0, line)
            flush()
            held = "\n".join(lead) if overlap else ""
        held = f"{held}\n\n{block}" if held else block
    flush()
    return out


def line_spans(text: str, chunks: list[str]) -> list[tuple[int, int]]:
    """(first, last) line of each chunk, from 1: the first line of a chunk is looked for from where the last one was found.

    A line fits if it equals the chunk's first line, or holds it where that has more than five signs.
    """
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    out, at = [], 0
    for chunk in chunks:
        first = chunk.strip().split("\n")[0].strip()
        hit = next((i for i in range(at, len(lines)) if lines[i] == first or len(first) > 5 and first in lines[i]), None)
        at = at if hit is None else hit
        out.append((at + 1, min(at + chunk.count("\n") + 1, len(lines))))
    return out


CHUNKERS: dict[str, Callable[[str], list[str]]] = {"markdown": markdown_chunks, "document": markdown_chunks, "pdf": markdown_chunks, "conversation": conversation_chunks, "parser": conversation_chunks, "code": code_chunks}


def chunk_documents(docs: DataFrame, kind: str, key: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """(key, seq, content, start_line, end_line): the chunks of every text, numbered from 0. Null and blank texts have none."""
    cutter = CHUNKERS[kind]
    kind_of_key = dict(docs.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pieces = cutter(t, **sizes) if t else []
                rows += [(k, i, c, *span) for i, (c, span) in enumerate(zip(pieces, line_spans(t or "", pieces), strict=True))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [key, "seq", "content", "start_line", "end_line"])

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind_of_key}, seq int, content string, start_line int, end_line int")


def with_context(hits: DataFrame, chunks: DataFrame, radius: int, key: str = "doc_id") -> DataFrame:
    """`hits` (key, seq) with the contents of the chunks up to `radius` away in order, a blank line between, and the lines they span.

    An equi-join on the document with a bound on seq; missing and empty chunks are passed over.
    """
    near = hits.select(key, "seq").distinct().withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("seq") - radius), F.col("seq") + radius)))
    around = near.join(chunks.select(F.col(key), F.col("seq").alias("at"), "content", "start_line", "end_line"), [key, "at"])
    filled = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.struct("at", "content"))
    joined = around.groupBy(key, "seq").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(filled)), lambda x: x["content"]), "\n\n").alias("context"),
        F.min(F.when(F.col("start_line") > 0, F.col("start_line"))).alias("from_line"), F.max("end_line").alias("to_line"),
    )
    return hits.join(joined, [key, "seq"], "left")


def page_text(name, page, pages, text):
    """What a page of a paginated document is indexed as."""
    return F.format_string("Page %d of %d - %s\n%s", page, pages, name, text)
