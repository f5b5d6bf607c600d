"""Encoding whole corpora with a public byte-level BPE vocabulary.

A batch of texts is cut into pre-tokens with array operations over its bytes, without a loop over texts. Then two tiers:
a minimal perfect hash over the vocabulary resolves every pre-token that is itself a token, in array operations; what
misses is merged by a heap over a linked list of bytes, once per distinct piece and worker (bounded cache).
Texts are never cut: a text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# fixed values: Unicode White_Space
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Bytes of text handled at once (arrays of 8 bytes each), and distinct merged pieces a worker keeps.
CHUNK, CACHE = 1 << 20, 400_000


@dataclass
class Vocabulary:
    """What a worker needs: character classes, the perfect hash with its keys, and the ranks."""

    classes: np.ndarray
    displacement: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    token: np.ndarray
    ranks: dict[bytes, int]


def _mixed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of a key of up to 16 bytes."""
    x = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + size.astype("uint64")) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _displaced(mixed: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Place of each key under displacement d. Mixed anew for each d: steps of a fixed width would come round before all free places are tried."""
    x = mixed ^ d * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return (x % np.uint64(n)).astype("int64")


def _slot(mixed: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """Place of each key by its bucket's displacement; a negative one names the place itself."""
    d = displacement[(mixed % np.uint64(len(displacement))).astype("int64")]
    return np.where(d < 0, -d - 1, _displaced(mixed, np.abs(d).astype("uint64"), n))


def _perfect_hash(mixed: np.ndarray) -> np.ndarray:
    """Displacements that give len(mixed) keys as many different places: large buckets first, single keys into what is left."""
    n = len(mixed)
    buckets = max(1, n // 3)
    of = (mixed % np.uint64(buckets)).astype("int64")
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    taken, out = np.zeros(n, bool), np.zeros(buckets, "int64")
    singles = []
    for k in np.argsort(-np.diff(edges), kind="stable"):
        members = order[edges[k] : edges[k + 1]]
        if len(members) <= 1:
            singles += [(k, m) for m in members]
            continue
        base = 0
        while True:
            tries = np.arange(base, base + 512, dtype="uint64")
            at = _displaced(mixed[members][:, None], tries, n)
            free = ~taken[at].any(0)
            for t in np.flatnonzero(free):
                if len(set(at[:, t].tolist())) == len(members):
                    taken[at[:, t]] = True
                    out[k] = base + t
                    break
            else:
                base += 512
                continue
            break
    for (k, _), place in zip(singles, np.flatnonzero(~taken), strict=True):
        out[k] = -place - 1
    return out


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """From a rank file (base64 token and rank per line), read on the driver."""
    with open(path or f"{TOKENIZERS}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    short = [t for t in ranks if len(t) <= 16]
    flat = np.frombuffer(b"".join(t.ljust(16, b"\0") for t in short), "<u8").reshape(-1, 2)
    low, high, size = flat[:, 0].copy(), flat[:, 1].copy(), np.array([len(t) for t in short], "uint8")
    mixed = _mixed(low, high, size)
    displacement = _perfect_hash(mixed)
    at = _slot(mixed, displacement, len(short))
    place = np.argsort(at)
    classes = np.zeros(0x110000, "uint8")
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            classes[c] = LETTER if kind == "L" else NUMBER
    classes[_WHITE] = SPACE
    return Vocabulary(classes, displacement, low[place], high[place], size[place], np.array([ranks[t] for t in short], "int64")[place], ranks)


def piece_starts(data: np.ndarray, docs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens begin. `data`: UTF-8 of all texts; `docs`: where each non-empty text begins.

    The rules of the public pattern: a run of letters, of numbers or of other signs takes one plain space before it; of white
    space before a run the last sign stands alone or is taken; an apostrophe that begins such a run makes s, t, m, d, re, ve
    and ll a piece of their own.
    """
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[chars]
    kind = classes[lead]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        at = chars[wide]
        padded = np.append(data, np.zeros(3, "uint8"))
        b0, b1, b2, b3 = (padded[at + i].astype("uint32") for i in range(4))
        two, three = (b0 & 0x1F) << 6 | b1 & 0x3F, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F
        four = (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F
        kind[wide] = classes[np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, np.minimum(four, 0x10FFFF)))]
    n = len(chars)
    first = np.zeros(n + 3, bool)
    first[np.searchsorted(chars, docs)] = True
    first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = np.flatnonzero(run[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[lead[after - 1] == 0x20]] = False
    quote = np.flatnonzero((lead == 0x27) & start[:n] & run[:n] & run[1 : n + 1] & ~first[1 : n + 1])
    if len(quote):
        text = np.append(lead, np.zeros(3, "uint8"))
        c1, c2 = text[quote + 1], text[quote + 2]
        one = np.isin(c1, np.frombuffer(b"stmd", "uint8"))
        pair = c1.astype("uint16") << 8 | c2
        two = np.isin(pair, [ord(x) << 8 | ord(y) for x, y in ("re", "ve", "ll")]) & ~first[quote + 2]
        for which, width in ((one, 2), (two & ~one, 3)):
            q = quote[which]
            start[q + 1] = False
            start[q + width] = True
    return chars[np.flatnonzero(start[:n])]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one piece: the lowest rank first, the leftmost of equals, by a heap over linked bytes."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if part[i] else n
        if j >= n or len(part[i]) + len(part[j]) != size:
            continue  # one of the two has been merged since
        part[i] += part[j]
        part[j] = b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
        h = before[i]
        if h >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
    return [ranks[p] for p in part if p]


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], "uint64")


def encode_chunk(data: np.ndarray, docs: np.ndarray, v: Vocabulary, cache: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, where each text's ids begin, plus their end) of UTF-8 texts laid end to end; docs has len(texts) + 1 offsets."""
    if not len(data):
        return np.zeros(0, "int64"), np.zeros(len(docs), "int64")
    filled = docs[:-1][np.diff(docs) > 0]
    at = piece_starts(data, filled, v.classes)
    size = np.diff(np.append(at, len(data)))
    padded = np.append(data, np.zeros(16, "uint8"))
    words = np.ndarray(len(data) + 8, "<u8", padded, 0, (1,))
    low = words[at] & _MASK[np.minimum(size, 8)]
    high = np.zeros(len(at), "uint64")
    long = np.flatnonzero(size > 8)
    high[long] = words[at[long] + 8] & _MASK[np.minimum(size[long] - 8, 8)]
    place = _slot(_mixed(low, high, np.minimum(size, 255)), v.displacement, len(v.token))
    hit = (v.low[place] == low) & (v.high[place] == high) & (v.size[place] == size) & (size <= 16)
    ids, counts = v.token[place], np.ones(len(at), "int64")
    miss = np.flatnonzero(~hit)
    if len(miss):
        raw, found = data.tobytes(), []
        for a, b in zip(at[miss].tolist(), (at[miss] + size[miss]).tolist(), strict=True):
            piece = raw[a:b]
            got = cache.get(piece)
            if got is None:
                got = merged(piece, v.ranks)
                if len(piece) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = got
            found.append(got)
        counts[miss] = [len(x) for x in found]
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "int64")
        out[offset[hit]] = ids[hit]
        width = counts[miss]
        inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        out[np.repeat(offset[miss], width) + inner] = [x for xs in found for x in xs]
    else:
        out = ids
    ends = np.append(0, np.cumsum(counts))
    return out, ends[np.searchsorted(at, docs)]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], "int64")[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return (np.frombuffer(body, "uint8") if body is not None and body.size else np.zeros(0, "uint8")), offsets


def encode_column(column: pa.Array, v: Vocabulary, cache: dict[bytes, list[int]]):
    """Yields (first row, end row, ids, offsets) for stretches of about CHUNK bytes of whole texts."""
    data, offsets = _texts(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, *encode_chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], v, cache)
        i = j


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, shared by its tasks."""
    return sys.modules.setdefault(f"_siftlake_{name}", types.ModuleType(name)).__dict__.setdefault("cache", {})


def encode(docs: DataFrame, key: str, text: str, vocabulary: str | None = None, counts_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) with `counts_only`: the token ids of every text, without special tokens.

    Empty and null texts give the empty list and 0. Rows are neither dropped nor merged: a repeated key comes out as often as
    it goes in, a null key stays null. No shuffle. The vocabulary is broadcast: its size is that of the rank file.
    """
    # plain arrays: a broadcast class would have to be importable on the executors
    shared = docs.sparkSession.sparkContext.broadcast(vars(load_vocabulary(vocabulary)))
    named = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))

    def run(batches):
        v, cache = Vocabulary(**shared.value), worker_cache("pieces")
        for batch in batches:
            for i, j, ids, ends in encode_column(batch.column(1), v, cache):
                keys = batch.column(0).slice(i, j - i)
                value = pa.array(np.diff(ends)) if counts_only else pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys, value], [key, "n_tokens" if counts_only else "ids"])

    return named.mapInArrow(run, f"`{key}` long, " + ("n_tokens long" if counts_only else "ids array<long>"))
