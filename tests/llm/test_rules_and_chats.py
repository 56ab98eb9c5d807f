"""Quality rules and chat formatting against plain Python."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from repliphase.llm import chat_format as cf
from repliphase.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def repeated(words, width=8):
    n = Counter(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    inside = set()
    for k in range(len(words) - width + 1):
        if n[tuple(words[k : k + width])] > 1:
            inside.update(range(k, k + width))
    return len(inside)


def brute(rows, most_docs, copies_once=False):
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", x.translate(LOWER)).strip(" ")
    holders = defaultdict(set)
    for doc_id, text, host in rows:
        text = text or ""
        for line in text.split("\n"):
            if WORD.search(line):
                holders[host, norm(line)].add(text if copies_once else (doc_id, text))
    out = []
    for doc_id, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        gone = [x for x in lines if len(holders[host, norm(x)]) > most_docs]
        lost = sum(len(WORD.findall(x)) for x in gone)
        again = repeated(words)
        failed = len(words) < 20 or 100 * again > 30 * len(words)
        kept = "\n".join(x for x in text.split("\n") if x not in gone)
        out.append((doc_id, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, failed, len(gone), lost, not failed and 100 * lost <= 50 * len(words), kept))
    return sorted(out, key=str)


def test_rules(spark, odd_rows, words):
    common = "\n".join(" ".join(words[300 + 9 * k : 309 + 9 * k]) for k in range(3))
    rows = [(r[0], r[1], r[3]) for r in odd_rows]
    for k in range(40):
        own = " ".join(words[3 * k : 3 * k + 25 * (k % 3)])
        rows.append((300 + k, f"{own}\n{common.upper() if k % 2 else common} \n# {'x ' * (k % 5)}|\n{own}", "h" if k < 30 else "g"))
    rows += [(400, "Q r s t u v w x y z " * 6, None), (401, "x y\n" * 30, "h"), (402, common, "h"), rows[-3], rows[-3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("qr_kept", F.lit("clash")).repartition(3)
    found = qr.quality_rules(docs, most_docs=5)
    names = ["doc_id", "qr_words", "qr_word_chars", "qr_symbols", "qr_dup_lines", "qr_repeat_words", "qr_base_failed", "qr_removed_lines", "qr_removed_words", "qr_kept", "qr_text"]
    got = sorted((tuple(r[:-1]) + (r[-1] or "",) for r in found.select(*names).collect()), key=str)
    want = brute(rows, 5)
    assert got == want
    assert any(r[7] for r in want) and any(not r[6] and not r[9] for r in want)


def test_copies_count_as_documents_or_once(spark, words):
    text = "\n".join(" ".join(words[9 * k : 9 * k + 9]) for k in range(4))
    rows = [(k, text, "h") for k in range(8)] + [(8 + k, " ".join(words[200:230]) + f"\n{text} {k}", "h") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for once in (False, True):
        found = qr.judge(qr.measure(docs), most_docs=5, copies_once=once).select("qr_id", "qr_removed_lines", "qr_removed_words", "qr_kept").collect()
        assert sorted(map(tuple, found)) == sorted((r[0], r[7], r[8], r[9]) for r in brute(rows, 5, once))
    copies = [(once, r[9]) for once in (False, True) for r in brute(rows, 5, once) if r[0] < 8]
    assert copies == [(False, False)] * 8 + [(True, True)] * 8


def test_a_line_counts_alike_in_small_and_hot_hosts(spark):
    line, rows = "the same line at the foot of every page", []
    for host, size in (("small", 25), ("hot", 3000)):
        for held, name in ((21, "over"), (20, "at")):
            rows += [(len(rows) + k, f"{host} {name} {k} " + " ".join(f"{host}{name}{k}w{j}" for j in range(40)) + f"\n{line} {name}", host) for k in range(held)]
        rows += [(len(rows) + k, f"{host} page {k} " + " ".join(f"{host}{k}v{j}" for j in range(25)), host) for k in range(size)]
    found = qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "qr_removed_lines").count().collect()
    assert sorted(map(tuple, found)) == [("hot", 0, 3020), ("hot", 1, 21), ("small", 0, 45), ("small", 1, 21)]


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "h", 5, 6, 7)], "doc_id long, text string, source string, __doc long, qr_mine long, qr_id long")
    (found,) = qr.quality_rules(docs).collect()
    assert (found["__doc"], found["qr_mine"], found["qr_id"], found["qr_words"]) == (5, 6, 7, 1)


def test_rules_of_an_empty_table(empty):
    assert qr.quality_rules(empty).collect() == []


SAID = [r"\### Assistant: </turn> ok", "", None, "<turn:user>\nhi</turn>\n", "<\\turn and <\\\\/turn </\\turn", "a < b > c % 25 \\", "é\n\n ü", "<" , "</", "x" * 5000]


def brute_chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def digests(formatted):
    made = formatted.withColumns({"turns": cf.read_back(F.col("formatted")), "masked": cf.masked(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    rows = made.select("id", F.size("turns"), F.sha2(F.array_join(lines, "").cast("binary"), 256), F.char_length("masked"), F.sha2(F.col("masked").cast("binary"), 256)).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


def test_round_trip_of_turn_rows(spark):
    rows = [(k % 7, k // 7, ["system", "user", "assistant"][k % 3], SAID[k % len(SAID)]) for k in range(60)]
    rows += [(20, 1, None, "x"), (20, None, "a>b\n%<", "y"), (20, 1, "assistant", "tie b"), (20, 1, "assistant", "tie a"), (20, 1, "assistant", "tie a"), (None, 0, "assistant", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    records = table.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    formatted = cf.format_chats(cf.canonical_turns(records, "conv_id", "turn", "record"))
    assert digests(formatted) == brute_chats(rows)
    for r in formatted.collect():
        # Text under the mask, and only it, is unescaped assistant text; the template's marks lie outside.
        assert all(cf.CLOSE not in r.formatted[s.start : s.stop] for s in r.loss_spans)
        assert r.n_unknown == 0


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    records = table.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    assert cf.format_chats(cf.canonical_turns(records, "conv_id", "turn", "record")).collect() == []


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "weight": 1}], "extra": {"a": 1}}, [("user", "hi"), ("assistant", "yo")]),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, [("user", "hi"), ("assistant", "yo")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done", "system": "be"}, [("system", "be"), ("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "output": None, "system": ""}, [("user", "do"), ("assistant", "")]),
    ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "response": "b", "meta": [1]}, [("user", "a"), ("assistant", "b")]),
    ({"role": "user", "text": "t"}, [("user", "t")]),
    ({"messages": []}, []),
    ({"question": "a", "answer": "b"}, None),
    ({"prompt": "a"}, None),
]


U, A = {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}
HI = [("user", "hi"), ("assistant", "yo")]
ODD_LAYOUTS = [
    ({"messages": [{"role": "system"}, U, A]}, [("system", ""), *HI], 0),
    ({"messages": [{"content": "who?"}, U, A]}, [("", "who?"), *HI], 0),
    ({"messages": [{"from": "user", "value": "hi"}, {"role": "assistant", "text": "yo"}]}, HI, 0),
    ({"messages": [U, {"a": 1}, 7, None, A]}, HI, 3),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b"]}]}, [("user", "a\n\nb")], 0),
    ({"messages": [{"role": "user", "content": 5}, {"role": "user", "content": []}, {"role": None, "content": None}]}, [("user", "5"), ("user", ""), ("", "")], 0),
    ({"prompt": "hi", "messages": [U, A]}, HI, 0),
    ({"prompt": "a", "completion": "b", "response": "c"}, [("user", "a"), ("assistant", "b\n\nc")], 0),
    ({"messages": json.dumps([U, A])}, HI, 0),
    ({"messages": "said by no one"}, [("", "said by no one")], 0),
    ({"messages": "12"}, [("", "12")], 0),
    ({"messages": U}, [("user", "hi")], 0),
    ({"messages": None}, [], 0),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt"}], "role": "x", "text": "y"}, [("user", "hi"), ("assistant", "")], 0),
    ({"instruction": ["do", {"text": "it"}], "output": "done"}, [("user", "do\n\nit"), ("assistant", "done")], 0),
    ({"text": "no role"}, [], 1),
    ([U], [], 1),
    ({"messages": None, "prompt": "hi", "response": "yo"}, HI, 0),
    ({"messages": [], "instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")], 0),
    ({"messages": [], "conversations": None, "instruction": None, "input": None, "output": None, "system": None, "prompt": None, "completion": None, "response": None, "role": "user", "text": "hi"}, [("user", "hi")], 0),
    ({"messages": [], "prompt": None, "role": "user", "text": None}, [("user", "")], 0),
    ({"system": "be kind", "messages": [U, A]}, [("system", "be kind"), *HI], 0),
    ({"system": "", "conversations": [{"from": "human", "value": "hi"}]}, [("user", "hi")], 0),
    ({"prompt": [{"role": "system", "content": "s"}, U], "completion": [A]}, [("system", "s"), *HI], 0),
    ({"prompt": [U, {"x": 1}], "response": "yo"}, HI, 1),
    ({"messages": [{"role": None, "from": "human", "value": "x"}, {"role": "user", "content": None, "value": "y"}, {"role": "user", "content": "", "value": "z"}]}, [("human", "x"), ("user", "y"), ("user", "")], 0),
    ({"prompt": "hi", "completion": None, "response": "yo"}, HI, 0),
    ({"prompt": "hi", "completion": None}, [("user", "hi"), ("assistant", "")], 0),
    ({"prompt": "hi", "completion": [], "response": None}, [("user", "hi"), ("assistant", "")], 0),
]


def test_no_turn_of_an_odd_layout_is_lost(spark):
    table = spark.createDataFrame([(k, json.dumps(record)) for k, (record, _, _) in enumerate(ODD_LAYOUTS)], "id long, record string")
    made = cf.format_chats(cf.canonical_turns(table, "id", None, "record")).withColumn("turns", cf.read_back(F.col("formatted"))).collect()
    found = {r.id: ([(t.role, t.text) for t in r.turns], r.n_unknown) for r in made}
    for k, (_, want, unknown) in enumerate(ODD_LAYOUTS):
        assert found[k] == (want, unknown), k


def test_layouts(spark):
    rows = [(k, json.dumps(record)) for k, (record, _) in enumerate(LAYOUTS)] + [(90, "{broken"), (91, None)]
    table = spark.createDataFrame(rows, "id long, record string")
    turns = cf.canonical_turns(table, "id", None, "record").orderBy("id", "member").collect()
    got = defaultdict(list)
    for r in turns:
        if r.member is not None:
            got[r.id].append((r.role, r.text))
    for k, (_, want) in enumerate(LAYOUTS):
        assert got.get(k, []) == ([(None, "")] if want is None else want), k
    assert got[90] == got[91] == [(None, "")]


def test_layouts_must_differ(spark):
    table = spark.createDataFrame([(1, "{}")], "id long, record string")
    with pytest.raises(ValueError):
        cf.canonical_turns(table, "id", None, "record", (*cf.MAPPINGS, cf.Mapping("again", row=("$.role", "$.text"))))
