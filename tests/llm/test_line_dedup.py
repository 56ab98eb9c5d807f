"""Line dedup against sets of lines, and the filters against plain sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from repliphase.llm.line_dedup import CuckooFilter, LineDedup

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, known):
    holders = defaultdict(set)
    for doc_id, text in known:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 20 and doc_id is not None:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = holders.get(line.strip(" \t\n\x0b\x0c\r").translate(LOWER), set())
            if doc_id not in docs or len(docs) < 3 or doc_id == max(docs):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lined(words):
    rng = random.Random(6)
    pool = [" ".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(40)] + ["é" * 19, "é" * 20, "ß" * 20]
    rows = []
    for k in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        rows.append((k, "\n".join(rng.choice([x, x.upper(), f" \t{x}\r"]) if x.isascii() else x for x in lines)))
    return [*rows, (60, None), (61, ""), (62, "\n\n"), (7, rows[7][1]), (None, rows[3][1]), (63, "\n".join(pool * 50))]


def test_insert_delete_and_insert_again(spark, lined):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame(lined, schema).repartition(3)
    state = LineDedup(spark, keys_per_shard=3).insert(docs.where("doc_id < 30 or doc_id is null")).insert(docs.where("doc_id >= 20"))
    found = sorted(map(tuple, state.resolve(docs).collect()), key=str)
    assert found == brute(lined, lined)
    assert any(r[2] for r in found)
    state.delete(docs.where("doc_id in (59, 63, 5, 200)"))
    left = [r for r in lined if r[0] not in (59, 63, 5)]
    assert sorted(map(tuple, state.resolve(docs).collect()), key=str) == brute(lined, left)
    state.insert(docs.where("doc_id in (59, 63, 5)"))
    assert sorted(map(tuple, state.resolve(docs).collect()), key=str) == brute(lined, lined)
    assert state.shards > 8  # they were outgrown
    # Every key with references is in its shard's filter.
    filters = {r.shard: CuckooFilter.read(bytes(r.filter)) for r in state.filters.collect()}
    from repliphase.llm import byte_words as bw

    for r in state.refs.select("k1", "k2").distinct().collect():
        h = np.array([r.k1]).view(np.uint64) ^ bw.mix(np.array([r.k2]).view(np.uint64))
        assert filters[r.k1 % state.shards].has(h).all()


def test_filters_decide_what_is_read_and_never_the_rows(spark, lined):
    docs = spark.createDataFrame(lined, "doc_id long, text string").repartition(3)
    want = brute(lined, lined)

    def made(spoil):
        state = LineDedup(spark).insert(docs.where("doc_id < 40"))
        if spoil:
            state.filters = state.filters.rdd.map(lambda r: (r.shard, bytes(len(r.filter)))).toDF("shard int, filter binary")
        state.insert(docs.where("doc_id >= 20"))
        return sorted(map(tuple, state.resolve(docs).collect()), key=str), state.looked.count(), state.refs.count()

    rows, looked, stored = made(False)
    assert rows == want and looked > 0
    again, none, doubled = made(True)
    assert again == want and none == 0 and doubled > stored


def test_new_keys_are_not_looked_up(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    line = lambda k: f"a line of its own, number {k:06d}"
    state = LineDedup(spark).insert(frame([(k, line(k)) for k in range(500)]))
    state.insert(frame([(1000 + k, line(k + 490)) for k in range(500)]))
    assert 10 <= state.looked.count() < 20
    assert state.n_keys == state.refs.select("k1", "k2").distinct().count() == 990


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert LineDedup(spark).insert(none).resolve(none).collect() == []


def test_filter_holds_and_forgets():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    made = CuckooFilter.holding(keys[:12_000])
    assert made.add(keys[12_000:12_500])
    assert made.has(keys[:12_500]).all()
    assert made.has(keys[12_500:]).mean() < 0.01
    made.remove(keys[:6_000])
    assert made.has(keys[6_000:12_500]).all()
    assert made.has(keys[:6_000]).mean() < 0.01
