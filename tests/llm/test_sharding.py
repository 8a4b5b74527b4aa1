"""Shards against a global sort."""

import hashlib
import zlib

from pyspark.sql import functions as F

from askgrid.llm import sharding


def expected(rows, shards):
    """Multiset of (id, size, crc, shard, slot), rows of one key and id in any order."""
    facts = []
    for doc_id, text in rows:
        data = (text or "").encode()
        facts.append((int(hashlib.md5(data).hexdigest()[:15], 16), doc_id is not None, doc_id or 0, doc_id, len(data) + 16, zlib.crc32(data)))
    facts.sort(key=lambda f: f[:3])
    total, at, slots, result = sum(f[4] for f in facts), 0, {}, []
    for *_, doc_id, size, crc in facts:
        shard = at * shards // total
        at += size
        result.append((doc_id, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return sorted(result, key=str)


def found(df, shards, **options):
    rows = sharding.shard_documents(df, shards, **options).collect()
    return sorted([(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows], key=str)


def test_hot_text_nulls_and_repeated_rows(documents, prose):
    rows = [(i, prose(i, i % 50)) for i in range(300)] + [(1000 + i, "the same") for i in range(200)]
    rows += [(None, "n"), (5000, None), (5001, ""), (5002, "ä" * 3000)] + [(7, "again")] * 3
    df = documents(rows)
    for options in ({}, {"ranges_per_shard": 2, "draws_per_range": 1}):
        assert found(df, 7, **options) == expected(rows, 7)


def test_sizes_are_near_equal(documents, prose):
    rows = [(i, prose(i, 20 + i % 9)) for i in range(400)] + [(1000 + i, prose(1, 25)) for i in range(200)]
    shards = sharding.shard_documents(documents(rows), 10).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    sizes = [r["b"] for r in shards]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * max(len(t) + 16 for _, t in rows)
    assert all(r["n"] == r["m"] + 1 for r in shards)


def test_empty_table(documents):
    assert sharding.shard_documents(documents([])).count() == 0
