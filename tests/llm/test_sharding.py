import hashlib
import zlib
from collections import defaultdict

from foldwise.llm.sharding import MODULUS, MULTIPLIER, shard_documents
from tests.llm.helpers import SF, awkward, awkward_rows, empty, table


def jump(key, shards):
    word = "null" if key is None else str(key)
    state = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % (MODULUS - 1) + 1
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        state = state * MULTIPLIER % MODULUS
        nxt = (at + 1) * MODULUS // state
    return at


def check(rows, texts):
    slots = defaultdict(list)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 24), jump(r.doc_id, 25))
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want


def test_against_brute_force(spark):
    docs = table(spark, "documents", SF)
    check(shard_documents(docs, 24).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    check(shard_documents(awkward(spark), 24).collect(), [r[:2] for r in awkward_rows()])
    assert shard_documents(empty(spark), 24).count() == 0


def test_one_shard_more_moves_its_share(spark):
    keys = spark.range(20000).selectExpr("id as doc_id", "'t' as text")
    rows = shard_documents(keys, 24).collect()
    moved = sum(r.shard != r.grown_shard for r in rows) / len(rows)
    assert abs(moved - 1 / 25) < 0.01
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += 1
    assert max(sizes.values()) < 1.2 * min(sizes.values())


def test_plan_is_native(spark):
    plan = shard_documents(table(spark, "documents", SF), 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
