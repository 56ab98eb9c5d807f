"""Every registered query on the smallest tables: its columns and what a digest must satisfy."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from repliphase.llm import registry

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = registry.QUERIES[name](spark, FOLDER).collect()
        return made[name]

    return get


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", x)[1]) for x in registry.QUERIES] == list(range(1, 13))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_leaks_have_known_documents_and_items(spark, results, texts):
    items = {r[0] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id").collect()}
    rows = results("op2_decontaminate")
    assert all(r.doc_id in texts and r.item_id in items for r in rows)
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)


def test_every_document_has_a_quality(results, texts):
    rows = results("op3_co_trained_quality")
    assert sorted(r.doc_id for r in rows) == sorted(texts)


def test_shards_are_near_equal_and_gapless(results, texts):
    rows, slots, bytes_, of_text = results("op5_best_fit_sharding"), defaultdict(list), Counter(), {}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert of_text.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    copies = Counter((t or "").encode() for t in texts.values())
    largest = max((len(raw) + 16) * n for raw, n in copies.items())
    assert max(bytes_.values()) <= sum(bytes_.values()) / 40 + largest


def test_mix_takes_near_its_targets(results, texts):
    rows, taken, target = results("op6_mix_sources"), Counter(), {}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        assert r.target <= 2 * r.source_size + 1e-6
        key = (r.source_size, r.target)
        taken[key] += r.taken
        target.setdefault(key, r.target)
    assert abs(sum(taken.values()) - 1.5 * sum(r.size for r in rows)) <= 0.02 * 1.5 * sum(r.size for r in rows)


def test_languages_are_learned_ones(spark, results, texts):
    known = {r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang").distinct().collect()} - {None}
    rows = results("op7_kneser_ney_language_id")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        blank = not any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == blank and (blank or r.lang_pred in known)


def test_chats_read_back(results):
    by_id = {r.conv_id: r for r in results("op8_schema_chat_format")}
    assert by_id[-7].n_turns == 2 and by_id[-7].loss_chars == len(r"\### Assistant: </turn> ok")


def test_token_histogram_covers_every_document(results, texts):
    rows = sorted(results("op10_token_histogram"), key=lambda r: r.n_tokens)
    assert sum(r.docs for r in rows) == len(texts)
    docs, tokens = 0, 0
    for r in reversed(rows):
        docs, tokens = docs + r.docs, tokens + r.n_tokens * r.docs
        assert (r.tokens, r.docs_from, r.tokens_from) == (r.n_tokens * r.docs, docs, tokens)
    assert rows[-1].truncated_tokens == tokens
