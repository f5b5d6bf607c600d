"""Embedding texts and images in batches, by a service or by a hash of words that needs none."""

from __future__ import annotations

import base64
import json
import math
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.analysis import index_words
from siftlake.operators import filters

# fixed values: how many items a request takes, and how many of them may be images
TEXT_BATCH, MIXED_BATCH, IMAGE_BATCH = 6, 20, 5
DIMENSION = 1024
Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimension: int = DIMENSION) -> Embedder:
    """Unit vectors from the words of a text: every word adds or takes one at a place that its hash names. The same anywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in index_words(t or ""):
                h = xxhash.xxh64_intdigest(w.encode())
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def in_order(answer: list[dict], n: int) -> list[list[float] | None]:
    """The vectors of a service's answer by their index; None where it has none."""
    out: list[list[float] | None] = [None] * n
    for item in answer:
        i = int(item.get("index", -1))
        if 0 <= i < n:
            out[i] = item.get("embedding")
    return out


@dataclass
class Service:
    """An embedding service: POST with the texts, answered by vectors with an index. Put back in order."""

    url: str
    model: str
    key: str = ""
    timeout: float = 60.0

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
            return in_order(json.load(answer).get("data", []), len(texts))


def mixed_batches(items: list[dict], most: int = MIXED_BATCH, images: int = IMAGE_BATCH) -> list[list[dict]]:
    """Items (with a text or an image) in order, so many a request, of which so many images at most."""
    out: list[list[dict]] = []
    held: list[dict] = []
    pictures = 0
    for item in items:
        picture = bool(item.get("image"))
        if held and (len(held) == most or picture and pictures == images):
            out.append(held)
            held, pictures = [], 0
        held.append(item)
        pictures += picture
    return [*out, held] if held else out


def request_lines(items: list[tuple[str, str]], model: str, url: str = "/v1/embeddings") -> str:
    """The JSON lines of a batch job, one request an item (id, text)."""
    return "".join(json.dumps({"custom_id": i, "method": "POST", "url": url, "body": {"model": model, "input": t}}) + "\n" for i, t in items)


def batch_vectors(lines: str) -> dict[str, list[float]]:
    """Vectors by id of a batch job's result; failed and broken lines are passed over, so a part result is of use."""
    out = {}
    for line in lines.splitlines():
        try:
            row = json.loads(line)
            out[row["custom_id"]] = row["response"]["body"]["data"][0]["embedding"]
        except (ValueError, KeyError, IndexError, TypeError):
            continue
    return out


def is_multimodal(model: str) -> bool:
    """Whether a model takes images, by its name."""
    name = model.lower()
    return any(x in name for x in ("-vl", "vl-", "vision", "multimodal", "clip"))


def image_item(raw: bytes, media_type: str) -> dict:
    return {"image": f"data:{media_type};base64,{base64.b64encode(raw).decode()}"}


def embedded(rows: DataFrame, embedder: Embedder, key: str = "chunk_id", text: str = "content", batch: int = TEXT_BATCH) -> DataFrame:
    """(key, embedding) of texts, `batch` a call; null where the service has no vector. Blank texts are not asked for."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            vectors: list = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                for i, v in zip(part, embedder([texts[i] for i in part]), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([keys, pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    return rows.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, embedding array<float>")


def embed_pending(store, embedder: Embedder, force: bool = False) -> int:
    """Embed the text chunks of a store that lack a vector, all with `force`; the number of the version."""
    todo = filters.pending(store.read("chunks"), force).filter(F.coalesce("chunk_type", F.lit(0)) == 0)
    return store.update("chunks", embedded(todo, embedder), "chunk_id")
