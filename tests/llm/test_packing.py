from collections import defaultdict

from __spark_entry__ import queries
from siftlake.llm.packing import pack
from siftlake.plans.session import table


def held(rows, sizes, caps):
    """Every token of every item once per limit, nothing split without need, nothing overfull; containers by limit."""
    full, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        full[r.limit_id, r.container] += r.n_tokens
        parts[r.limit_id, r.k].append((r.part, r.first, r.n_tokens))
    assert set(parts) == {(c, k) for c in caps for k in sizes}
    for (c, k), p in parts.items():
        at = 0
        for i, (part, first, n) in enumerate(sorted(p)):
            assert (part, first) == (i, at) and (n > 0 or len(p) == 1)
            at += n
        assert at == sizes[k] and len(p) == max(1, -(-sizes[k] // caps[c]))
    assert all(n <= caps[c] for (c, _), n in full.items())
    return {c: sum(x == c for x, _ in full) for c in caps}


def test_packs_whole_and_close(spark):
    sizes = {i: (i * 37) % 97 for i in range(400)} | {1000: 250, 1001: 200, 1002: 0}
    items = spark.createDataFrame(list(sizes.items()), "k long, n long")
    limits = spark.createDataFrame([(1, 100), (2, 1000), (3, 0), (None, 5)], "limit_id long, capacity int")
    for shard, shards in ((50_000, 1), (100, 5)):
        used = held(pack(items, limits, "k", "n", shard).collect(), sizes, {1: 100, 2: 1000})
        for c, capacity in ((1, 100), (2, 1000)):
            assert used[c] <= 1.02 * sum(sizes.values()) / capacity + 4 * shards
    assert pack(items.limit(0), limits, "k", "n").count() == 0


def test_query_holds_every_document(spark, small):
    caps = {r.limit_id: r.capacity for r in table(spark, small, "pack_limits").collect()}
    sizes = {r.doc_id: len(r.ids) for r in queries()["p8_ids"](spark, small).collect()}
    held(queries()["p9_packed"](spark, small).withColumnRenamed("doc_id", "k").collect(), sizes, caps)
