"""Sharding, mixing and token counts against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from repliphase.llm import mixing, sharding, token_counts


def one_by_one(sizes, capacity):
    """Best-fit decreasing, a group at a time."""
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= size]
        if fits:
            room[min(fits)[1]] -= size
        else:
            room.append(capacity - size)
    return sorted(room)


def test_packing_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 60, rng.integers(1, 200)).tolist()
        capacity = int(rng.integers(max(sizes), 200))
        runs = sharding.best_fit_decreasing(Counter(sizes).items(), capacity)
        loads = defaultdict(int)
        for size, name, count in runs:
            loads[name] += size * count
        assert sorted(capacity - x for x in loads.values()) == one_by_one(sizes, capacity)
        assert Counter(s for s, _, n in runs for _ in range(n)) == Counter(sizes)


def test_even_shards_with_a_giant():
    classes = [(10, 300), (7, 200), (4000, 1), (900, 1)]
    loads = defaultdict(int)
    for size, name, count in sharding.pack_evenly(classes, 8):
        loads[name] += size * count
    assert len(loads) == 8 and max(loads.values()) == 4000
    rest = sorted(loads.values())[:-1]
    assert rest[-1] <= 1.4 * rest[0]


def test_shards(odd, odd_rows):
    found = sharding.shard(odd, shards=5).collect()
    assert len(found) == len(odd_rows)
    slots, groups = defaultdict(list), defaultdict(set)
    for r in found:
        raw = (r["text"] or "").encode()
        assert (r["sh_size"], r["sh_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        slots[r["sh_shard"]].append(r["sh_slot"])
        groups[raw].add(r["sh_shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in groups.values()) and set(slots) <= set(range(5))


def test_fixed_capacity(odd):
    found = sharding.shard(odd, capacity=200_000).groupBy("sh_shard").agg(F.sum("sh_size")).collect()
    assert all(r[1] <= 200_000 for r in found)


def test_empty_tables(empty):
    assert sharding.shard(empty).collect() == []
    mix = mixing.Mix(empty)
    assert mix.taken().collect() == [] and mix.texts(empty).collect() == []
    assert token_counts.length_histogram(empty).collect() == []


def test_size_classes():
    for s in (0, 1, 4095, 4096, 4097, 10**6 + 1, 2**40 + 3):
        assert s <= sharding._rounded(s) <= s * (1 + 2**-11) + 1
        assert sharding._rounded(s) == s or s >= 4096


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == pytest.approx([200.0, 83.3333333, 166.6666667])
    assert mixing.targets([10, 1000], [1, 1], 1515, 2) == [20.0, 1495.0]
    assert mixing.targets([0, 5], [3, 1], 7.5, 2) == [0.0, 7.5]


def test_permutations():
    for size in (1, 2, 3, 64, 1000, 4097):
        for key in (0, 12345):
            seen = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key))
            assert sorted(seen.tolist()) == list(range(size))


def test_mix(odd, odd_rows):
    mix = mixing.Mix(odd, block=8, shards=6)
    rows = mix.taken().collect()
    again = mixing.Mix(odd.repartition(5), block=8, shards=6).taken().collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    taken = Counter()
    for r in rows:
        assert r.taken <= 2 * r.size and (r.source_size, r.target) == (sizes[r.source], pytest.approx(want[r.source]))
        taken[r.source] += r.taken
    for s in order:
        assert taken[s] == pytest.approx(want[s], rel=0.05, abs=40)
    # The texts hold exactly the words taken.
    texts = mix.texts(odd)
    assert texts.columns == odd.columns
    count = Counter()
    for r in texts.collect():
        count[r.doc_id] += len(r.text.split())
    by_id = Counter()
    for r in rows:
        by_id[r.doc_id] += r.taken
    assert +count == +by_id


def test_whole_texts_keep_their_white_space(spark):
    text = " one\ttwo\n\nthree \n"
    docs = spark.createDataFrame([(1, text, "a"), (2, " ".join(map(str, range(300))), "b")], "doc_id long, text string, source string")
    out = mixing.Mix(docs, block=4, weights=(100, 1)).texts(docs).where("doc_id = 1").collect()
    assert {r.text for r in out} == {text} and len(out) == 2


def test_histogram(odd, odd_rows):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.array([len(encoder.encode_ordinary(r[1] or "")) for r in odd_rows])
    hist = token_counts.length_histogram(odd).cache()
    rows = {r.n_tokens: r for r in hist.collect()}
    assert {k: r.docs for k, r in rows.items()} == Counter(lengths.tolist())
    for n, r in rows.items():
        assert (r.docs_from, r.tokens_from) == ((lengths >= n).sum(), lengths[lengths >= n].sum())
        assert r.truncated_tokens == np.minimum(lengths, n).sum()
    said = token_counts.answers(hist, [0, 7, 64, 10**6], [0.0, 0.5, 0.9, 1.0])
    for limit, x in said["limits"].items():
        assert x == {"docs_within": (lengths <= limit).sum(), "tokens_within": lengths[lengths <= limit].sum(), "truncated_tokens": np.minimum(lengths, limit).sum()}
    assert said["quantiles"] == {q: int(np.quantile(lengths, q, method="inverted_cdf")) for q in (0.0, 0.5, 0.9, 1.0)}


@pytest.mark.parametrize("unit", [" ", "\n", "a", "1", "!", "\u3000", " \n"])
def test_histogram_of_very_long_runs(spark, unit):
    texts = [unit * 1_000_000, "x" + unit * 1_000_000 + "y", unit * 300]
    found = token_counts.length_histogram(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sum(r.docs for r in found) == 3
    # Tokens never cross these borders: a run of white space gives its last character to the word after it.
    encoder = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    if unit.isspace():
        piece = lambda t: len(encoder._encode_single_piece(t))
        last = piece(" y") if unit[-1] == " " else piece(unit[-1]) + piece("y")
        whole = [piece(texts[0]), piece("x") + piece(texts[0][:-1]) + last, len(encoder.encode_ordinary(texts[2]))]
        assert sorted(whole) == sorted(n for r in found for n in [r.n_tokens] * r.docs)


def test_both_splitters_agree(odd_rows):
    import regex

    encoder = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    rng = np.random.default_rng(2)
    drawn = ["".join(rng.choice(list(" \t\n\r\x0b\x1c\x85\xa0\u2003ab1!'sé\u4e00\U0001f600"), 60)) for _ in range(400)]
    for text in [*drawn, *[r[1] or "" for r in odd_rows]]:
        pieces = [m.group() for m in regex.finditer(token_counts.PATTERN, text)]
        assert [t for p in pieces for t in encoder._encode_single_piece(p)] == encoder.encode_ordinary(text)


def test_histogram_with_another_pattern(spark):
    docs = spark.createDataFrame([("hello world",)], "text string").coalesce(1)
    long = token_counts.length_histogram(docs).collect()[0].n_tokens
    assert token_counts.length_histogram(docs, pattern=r"\S|\s").collect()[0].n_tokens == 11
    assert token_counts.length_histogram(docs).collect()[0].n_tokens == long == 2
