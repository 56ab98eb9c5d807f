import math

import numpy as np
import pytest

from repliphase.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, label int, key long, side int, p1 string"


def _near(rng, x, cosine):
    y = rng.standard_normal(len(x))
    x = x / np.linalg.norm(x)
    y -= (x @ y) * x
    return cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def _brute(rows, cosine=0.93):
    usable, ids = {}, {r[0] for r in rows}
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            x = np.array(x, float)
            usable.setdefault((label, len(x)), {})[i] = x / np.abs(x).max()
    links, top = dict.fromkeys(ids, 0), {i: i for i in ids}
    edges = []
    for group in usable.values():
        names = sorted(group)
        x = np.stack([group[i] / np.linalg.norm(group[i]) for i in names])
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        edges += [(names[p], names[q]) for p, q in zip(a, b)]
    for p, q in edges:
        links[p] += 1
        links[q] += 1
    changed = True
    while changed:
        changed = False
        for p, q in edges:
            low = min(top[p], top[q])
            changed |= top[p] != low or top[q] != low
            top[p] = top[q] = low
    return {(i, links[i], top[i], None if i is None else top[i] == i) for i in ids}


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies at, above and below the threshold, a large group, and every odd vector."""
    rng, rows = np.random.default_rng(3), []
    for k in range(60):
        x = rng.standard_normal(24)
        rows.append((len(rows), x.tolist(), k % 3))
        for cosine in (0.9301, 0.95, 0.99, 0.9299, 0.8):
            rows.append((len(rows), (_near(rng, x, cosine) * rng.uniform(0.1, 9)).tolist(), k % 3))
    x = rng.standard_normal(24)
    rows += [(len(rows) + k, _near(rng, x, 0.985).tolist(), 1) for k in range(700)]  # more than a block
    at, same = len(rows), rng.standard_normal(24).tolist()
    rows += [(at + k, same, 2) for k in range(300)] + [(at + 300, same, 1), (at + 301, same, None), (at + 302, None, 2), (at + 303, [], 2), (at + 304, [0.0] * 24, 2)]
    rows += [(at + 305, same[:-1] + [None], 2), (at + 306, same[:-1] + [float("nan")], 2), (at + 307, same[:-1] + [float("inf")], 2), (at + 308, same[:-1], 2), (at + 309, [c * 1e200 for c in same], 2)]
    rows += [(at + 310, [c * 1e-200 for c in same], 2), (at + 311, [-c for c in same], 2), (at + 312, [3.0], 2), (at + 313, [5.0], 2), (at + 314, [-5.0], 2), (None, same, 2), (None, None, None)]
    return [(*r, 1, 2, "x") for r in rows]


def test_links_equal_brute_force(spark, planted):
    got = ed.near_duplicates(spark.createDataFrame(planted, SCHEMA).repartition(6)).collect()
    assert len(got) == len(planted)
    assert {tuple(r) for r in got} == _brute(planted)


def test_small_blocks_give_the_same(spark, planted):
    some = [r for r in planted if r[2] == 1]
    got = ed.near_duplicates(spark.createDataFrame(some, SCHEMA), block=40).collect()
    assert {tuple(r) for r in got} == _brute(some)


def test_repeated_ids_are_one_vector(spark):
    x, y = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, x, 5, 0, 0, ""), (1, x, 5, 0, 0, ""), (1, y, 7, 0, 0, ""), (2, x, 5, 0, 0, ""), (3, y, 7, 0, 0, "")]
    got = {tuple(r) for r in ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


def test_no_rows_and_other_types(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, [1, 2], "a"), (2, [2, 4], "a"), (3, [2, 4], "b")], "id int, v array<int>, l string")
    assert {tuple(r) for r in ed.near_duplicates(df, "id", "v", "l").collect()} == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)}


@pytest.mark.parametrize("size,rows", [(16, 10**4), (64, 10**3), (64, 10**7), (256, 10**9)])
def test_pairs_at_the_threshold_share_a_bucket(size, rows):
    plan = ed.plan_for(size, rows, 0.93, 0.99999)
    a, b = (x[:1000] for x in ed.pairs_at(size, 0.93))
    met = (ed.buckets(a, plan)[:, :, :, None] == ed.buckets(b, plan)[:, :, None, :]).any((1, 2, 3))
    assert met.all()
    apart = np.bitwise_count((ed.sketch(a) ^ ed.sketch(b)).view(np.uint64)).astype(int).sum(1)
    assert apart.max() <= ed.signs_apart(0.93) < 50


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(1).standard_normal((5, 32))
    assert np.allclose(ed.hadamard(ed.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(ed.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
