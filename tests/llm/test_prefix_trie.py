import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from repliphase.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, node string, fam long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _brute(rows):
    turns = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), _digest(role, text), role, text))
    for own in turns.values():
        own.sort()
    whole = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (abs(conv) % 20) * (1 if conv > 0 else -1)
        whole[conv] = tuple((r, t) for _, _, r, t in turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for conv, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(conv)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(c for c in members if whole[c] == path))
        leaves = sum(not any(q[:-1] == p and q for q in nodes) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in under if p)
        up = min(nodes[path[:-1]]) if path else None
        children = sum(1 for p in nodes if p and p[:-1] == path)
        out.append((min(members), len(path), up, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _run(df):
    trie = pt.prefix_trie(df)
    rows = trie.nodes.join(pt.end_digests(trie.ends), "node", "left")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    got = rows.select(*names, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("e")).collect()
    return sorted((tuple(r) for r in got), key=str), trie


def _rows():
    rng = random.Random(5)
    openings = [[("user", f"opening {k} of words"), ("assistant", f"reply {k}"), ("user", f"more {k} " * k)] for k in range(4)]
    rows = []
    for conv in [*range(0, 130), 3000, 3007, -7, -20, -27, 19_999]:
        if conv == 40:
            continue  # a base that is absent
        for turn, (role, text) in enumerate(rng.choice(openings)[: rng.randint(1, 3)] + [("assistant", rng.choice("abc"))] * rng.randint(0, 3)):
            rows.append((conv, turn, role, text, "x", 1))
    rows += [(61, None, "system", "null turn first", "x", 1), (62, 0, None, None, "x", 1), (62, 0, None, None, "x", 1), (63, 1, "user", "", "x", 1), (63, 1, "user", " \t", "x", 1)]
    rows += [(64, 9, "user", "long " * 50_000, "x", 1), (None, 0, "user", "nobody", "x", 1), (None, None, None, None, None, None)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = _rows()
    got, trie = _run(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == _brute(rows)
    assert trie.ends.count() == len({r[0] for r in rows if r[0] is not None})


def test_one_conversation_many_times(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"same words in turn {t}", "x", 1) for c in range(0, 4000) for t in range(2)]
    got, _ = _run(spark.createDataFrame(rows, SCHEMA))
    assert [(r[0], r[1], r[3], r[6]) for r in got] == [(0, 0, 4000, 2 * 5 * 3999), (0, 1, 4000, 2 * 5 * 3999), (0, 2, 4000, 5 * 3999)]


def test_a_deep_conversation(spark):
    rows = [(c, t, "user", f"turn {t}", "x", 1) for c in (0, 1) for t in range(1500)]
    got, _ = _run(spark.createDataFrame(rows, SCHEMA))
    assert len(got) == 1501 and sum(r[4] == 0 for r in got) == 1


def test_no_rows(spark):
    assert _run(spark.createDataFrame([], SCHEMA))[0] == []


def test_rows_and_partitions_do_not_matter(spark):
    rows = _rows()
    random.Random(1).shuffle(rows)
    assert _run(spark.createDataFrame(rows, SCHEMA).repartition(2))[0] == _brute(_rows())
