"""Decontamination against edit distances worked out in full."""

import random

import numpy as np
import pytest

from repliphase.llm import decontaminate as dc


def least_edits(segment: bytes, text: bytes) -> int:
    """The least edits of the segment against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    ramp = np.arange(len(text) + 1)
    t = np.frombuffer(text, np.uint8)
    for k, c in enumerate(segment):
        new = np.minimum(np.r_[k + 1, row[:-1] + (t != c)], row + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


@pytest.fixture(scope="module")
def items(words):
    rng = random.Random(8)
    return [(k, " ".join(rng.choices(words, k=rng.randint(6, 60))).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "Ab c"), (53, "exactly sixteen!"), (54, "Être à l'ÉCOLE, où " + "naïve " * 12)]


def test_against_full_alignment(spark, odd, odd_rows, items, words):
    rng = random.Random(9)
    rows, planted = [], {}
    for k, text in items[:12]:
        edited = list(text)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(edited))
            edited[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [edited[at], "q"]])
        filler = [" ".join(rng.choices(words, k=40)) for _ in range(2)]
        rows.append((200 + k, f"{filler[0]}  {''.join(edited).upper()}\n{filler[1]}"))
        planted[200 + k] = k
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.leaks(docs, bench, block_bytes=900).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    index = dc.Index([i for i, t in items if t is not None], [t for _, t in items if t is not None], 80, 7.5)
    want = set()
    for doc_id, text in {*[(r[0], r[1]) for r in odd_rows], *rows}:
        code, begin = dc.normalised([text])
        plain = code[begin[0] : begin[1] - 1].tobytes()
        if len(plain) > 5000:
            continue
        for s, (item, _, size) in enumerate(index.segs):
            if least_edits(index.text[s, :size].tobytes(), plain) <= index.edits[s]:
                want.add((doc_id, index.items[item]))
    assert {p for p in got if p[0] != 107} == want
    # The others have more edits than their length allows.
    held = sorted(set(planted.items()) & set(got))
    assert len(held) >= 8
    row = got[held[0]]
    plain = dc.normalised([dict(rows)[held[0][0]]])
    assert all(0 <= s.start < s.stop <= plain[1][1] - plain[1][0] and s.edits <= 6 for s in row.spans)
    leaking = {x for d, _ in got for x in [*odd_rows, *rows] if x[0] == d}
    want = sorted(((r[0], r[1]) for r in [*odd_rows, *rows] if r not in leaking), key=str)
    for some in ({}, {"block_bytes": 900}):
        assert sorted(map(tuple, dc.decontaminate(docs, bench, **some).collect()), key=str) == want


def test_one_block_shuffles_nothing_and_rows_are_judged_by_their_own_text(spark, items, words):
    bench = spark.createDataFrame(items, "item_id long, text string")
    leak = " ".join([*words[:50], next(t for i, t in items if i == 3), *words[50:99]])
    rows = [(1, leak, 1.5), (1, "clean " * 30, 2.5), (None, leak, 3.5), (None, None, 4.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key double")
    for some in ({}, {"block_bytes": 900}):
        kept = dc.decontaminate(docs, bench, **some)
        assert kept.columns == docs.columns and sorted(r["__key"] for r in kept.collect()) == [2.5, 4.5]
    assert "Exchange" not in dc.decontaminate(docs, bench)._jdf.queryExecution().executedPlan().toString()


def test_long_texts_against_full_alignment(words):
    rng = random.Random(3)
    items = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    index = dc.Index([0, 1, 2], items, 80, 7.5)
    text = " ".join(rng.choices(words, k=20_000))
    at = text.index(" ", 60_000)
    part = items[1][:200].replace(items[1][50], "?", 3)
    for whole in (text, text[:at] + " " + part + text[at:], items[2] + text + items[0]):
        code, begin = dc.normalised([whole])
        plain = code[begin[0] : begin[1] - 1].tobytes()
        want = {s for s, (_, _, size) in enumerate(index.segs) if least_edits(index.text[s, :size].tobytes(), plain) <= index.edits[s]}
        assert {s for _, s, *_ in index.search([whole])} == want


def test_empty(spark, odd, empty, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.leaks(empty, bench).collect() == []
    assert dc.leaks(odd, bench.limit(0)).collect() == []


def test_random_segments_match_full_alignment():
    rng = random.Random(1)
    items = ["".join(rng.choices("abcd ", k=rng.randint(9, 120))) for _ in range(15)]
    index = dc.Index(list(range(15)), items, 40, 10)
    texts = []
    for _ in range(60):
        part = list(rng.choice(items))
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], ["z"], [part[at], "e"]])
        texts.append("".join(rng.choices("efgh ", k=30)) + "".join(part) + "".join(rng.choices("efgh ", k=30)))
    got = {(t, s) for t, s, *_ in index.search(texts)}
    want = set()
    for t, text in enumerate(texts):
        code, begin = dc.normalised([text])
        plain = code[begin[0] : begin[1] - 1].tobytes()
        want |= {(t, s) for s, (_, _, size) in enumerate(index.segs) if least_edits(index.text[s, :size].tobytes(), plain) <= index.edits[s]}
    assert got == want and want
