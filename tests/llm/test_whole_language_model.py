"""A language's model keeps every n-gram, however many there are and wherever they are held."""

import inspect
import random

import numpy as np
import pytest

from repliphase.llm import language_id as li

LETTERS = {"aa": [chr(c) for c in range(0x4E00, 0x5600)], "bb": [chr(c) for c in range(0xAC00, 0xAC60)] + list("abcde"), "cc": list("abcdefgh") + ["𠀀"]}


def plain_counts(rows):
    out = {}
    for lang in LETTERS:
        code, begin = li.symbols([t for _, t, own in rows if own == lang])
        grams = li._grams(code, 4)
        out[lang] = np.unique(grams[li._valid(begin, len(grams))], return_counts=True)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [(k, "".join(rng.choices(LETTERS[lang], k=rng.randint(20, 200))) + " " + "".join(rng.choices("abc", k=9)), lang) for k, lang in enumerate(rng.choices(list(LETTERS), k=150))]


def test_more_ngrams_than_memory_holds_give_the_same_model(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = li.Model(plain_counts(rows))
    model = li.train(docs, most_in_memory=100)
    assert isinstance(model, li.StoredModel)
    assert model.sizes == {2 * o: len(whole.hashes[o - 1]) for o in range(1, 5)} | {2 * o + 1: len(whole.ctx[o - 1]) for o in range(1, 5)}
    texts = [t for _, t, _ in rows[:40]] + ["abc 丁가", "é", "", None]
    assert np.allclose(model.entropies(texts)[0], whole.entropies(texts)[0], atol=1e-5)
    for order in range(4):
        assert np.array_equal(model.hashes[order], whole.hashes[order]) and np.array_equal(model.ctx[order], whole.ctx[order])
        assert np.allclose(model.logs[order], whole.logs[order], atol=1e-5) and np.allclose(model.lam[order], whole.lam[order], atol=1e-5)


def test_both_places_give_the_same_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn, aside = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    found = [sorted(li.identify(docs, li.train(learn, calibration=aside, most_in_memory=most)).collect(), key=lambda r: r.doc_id) for most in (0, 1 << 30)]
    for a, b in zip(*found):
        assert (a.lang_pred, a.lang_accepted) == (b.lang_pred, b.lang_accepted)
        assert a.lang_score == pytest.approx(b.lang_score, abs=1e-4) and a.lang_entropy == pytest.approx(b.lang_entropy, abs=1e-4)


def test_every_calibration_row_counts(spark, rows):
    """The fit and the limits are NumPy's over all rows; no bound leaves any out."""
    assert not [name for name in inspect.signature(li.train).parameters if "calibration" in name and name != "calibration"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn, aside = [r for r in rows if r[0] % 3], [(k, t, lang if k % 9 else "xx") for k, t, lang in rows if k % 3 == 0]
    model = li.train(docs.where("doc_id % 3 > 0"), calibration=spark.createDataFrame(aside, "doc_id long, text string, lang string"), reject=0.1)
    h, sizes = model.entropies([t for _, t, _ in aside])
    best, x = h.argmin(1), li._margin(h, sizes)
    right = np.array([model.langs[b] == lang for b, (_, _, lang) in zip(best, aside)])
    x, y, w = np.r_[x, 0, 0], np.r_[right, 0, 1].astype(float), np.zeros(2)
    for _ in range(100):
        d = np.stack([x, np.ones_like(x)], 1)
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), d.T @ (y - p) - 1e-3 * w), -5, 5)
    assert (model.scale, model.shift) == pytest.approx((max(0, w[0]), w[1]), abs=1e-6)
    for k in range(len(model.langs)):
        own = h[(best == k) & right, k]
        assert model.most[k] == (pytest.approx(np.quantile(own, 0.9) + 0.5) if len(own) else np.inf)
