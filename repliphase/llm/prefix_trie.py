"""Conversation prefix trie, family first.

Conversations share openings: those whose base is conversation b take the first turns of b and go
on with their own. Each distinct sequence of turns that a rebuilt conversation starts with is a
node of one trie over all conversations. Steps:

1. every turn becomes a digest of role and text and a word count, so that no text is shuffled;
2. conversations are brought together by base id, rebuilt, and each family's small trie is built in
   one task: a node carries its family's members, its words and the members that end there;
3. family nodes, already combined within their family, are merged by their key, a digest of the
   whole sequence: members add up, the smallest member decides which family owns the node;
4. the merged figures go back to the families, where they are summed up along the branches, each
   node counted by its owner alone, and those partial sums are added up over families.

A node of a single family, which is most of them, keeps the figures of its family. No step goes
through the trie level by level, so its depth costs no rounds, and a node that all families share
meets in one row per family, combined before the shuffle.

Defined cases: rows with a null id are of no conversation and are left out; a null place comes
first, and rows of one place are ordered by their digest, repeated ones stay; null role or text is
empty; a conversation without turns, once rebuilt, ends at the root; a base that is absent lends no
turns; an empty table has no nodes. Columns of the input other than the four named are not read. A
family, 20 conversations of digests and counts without texts, is held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repliphase.llm import spark_tools as st

ROOT = bytes(16)
_NODE = pa.schema([
    ("fam", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()),
    ("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("ends", pa.list_(pa.int64())),
])
_NODE_DDL = "fam long, node binary, parent binary, depth long, words long, n long, low long, kids long, ends array<long>"
_PART = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
])
_PART_DDL = "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


class Trie(NamedTuple):
    """``nodes``: one row per node, by ``node`` and ``parent`` keys. ``ends``: (node, conv_id), one row per conversation, the node that it ends at."""

    nodes: DataFrame
    ends: DataFrame


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn; the length of the role keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def lent_turns(conv_id: Column, heads: int = 4) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % heads


def rebuild(turns: dict[int, list], heads: dict[int, int], base: int) -> dict[int, list]:
    """Each conversation of a family: the first turns of its base, then its own from there on."""
    lent = turns.get(base, [])
    return {conv: lent[: heads[conv]] + own[heads[conv] :] for conv, own in turns.items()}


def _family_trie(rows: pa.Table) -> pa.Table:
    """The trie of one family, from rows (fam, conv, place, digest, words, head)."""
    fam, turns, heads = rows["fam"][0].as_py(), {}, {}
    for conv, place, digest, words, head in zip(*(rows[c].to_pylist() for c in ("conv", "place", "digest", "words", "head"))):
        heads[conv] = head
        turns.setdefault(conv, []).append((place is not None, place or 0, digest, words))
    for own in turns.values():
        own.sort()
    key, parent, depth, words, n, low, kids, ends = [ROOT], [None], [0], [0], [0], [min(turns)], [0], [[]]
    below: dict[tuple[int, bytes], int] = {}
    for conv, sequence in sorted(rebuild(turns, heads, fam).items()):
        at = 0
        n[0] += 1
        for _, _, digest, count in sequence:
            step = below.get((at, digest))
            if step is None:
                step = below[at, digest] = len(key)
                kids[at] += 1
                key.append(hashlib.sha256(key[at] + digest).digest()[:16])
                parent.append(key[at])
                depth.append(depth[at] + 1)
                words.append(count)
                n.append(0)
                low.append(conv)
                kids.append(0)
                ends.append([])
            n[step] += 1
            at = step
        ends[at].append(conv)
    return pa.table([pa.array([fam] * len(key), pa.int64()), *(pa.array(x, f.type) for x, f in zip((key, parent, depth, words, n, low, kids, ends), list(_NODE)[1:]))], schema=_NODE)


def _family_sums(rows: pa.Table) -> pa.Table:
    """A family's share in the sums of its nodes; a node counts for its owner's family alone."""
    fam = rows["fam"][0].as_py()
    cols = {c: rows[c].to_pylist() for c in ("node", "parent", "depth", "words", "n", "low", "kids", "all_n", "all_low", "all_kids", "owner")}
    at = {k: i for i, k in enumerate(cols["node"])}
    own = [o is None or o == fam for o in cols["owner"]]
    conv = [a if a is not None else b for a, b in zip(cols["all_low"], cols["low"])]
    leaves = [int(mine and not (k if a is None else a)) for mine, k, a in zip(own, cols["kids"], cols["all_kids"])]
    saved = [w * (n - mine) for w, n, mine in zip(cols["words"], cols["n"], own)]
    children, over = [0] * len(own), [None] * len(own)
    for i in sorted(range(len(own)), key=cols["depth"].__getitem__, reverse=True):
        if cols["parent"][i] is not None:
            p = at[cols["parent"][i]]
            over[i] = conv[p]
            children[p] += own[i]
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    members = [b if a is None else a for a, b in zip(cols["all_n"], cols["n"])]
    return pa.table([pa.array(x, f.type) for x, f in zip((cols["node"], cols["parent"], conv, cols["depth"], over, members, children, leaves, saved), _PART)], schema=_PART)


def prefix_trie(turns: DataFrame, id_col: str = "conv_id", place_col: str = "turn", role_col: str = "role", text_col: str = "text", *, family: int = 20, heads: int = 4) -> Trie:
    """The trie of all conversations, of which ``c - c % family`` is the base of c and lends it fewer than ``heads`` turns.

    A node has its smallest member (conv_id), depth, its parent's smallest member, members
    (n_convs), children, childless nodes of its subtree (n_leaves), and the words that storing
    its subtree once instead of once per member saves (saved_tokens). Its last turn is turn
    ``depth`` of the rebuilt conversation conv_id.
    """
    conv = F.col(id_col).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(
        (conv - conv % family).alias("fam"),
        conv.alias("conv"),
        F.col(place_col).cast("long").alias("place"),
        turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(st.WORD)), F.lit(0)).cast("long").alias("words"),
        lent_turns(conv, heads).alias("head"),
    )
    small = st.written(rows.groupBy("fam").applyInArrow(_family_trie, _NODE_DDL), "families")
    merged = small.groupBy("node").agg(
        F.count("*").alias("families"),
        F.sum("n").alias("all_n"),
        F.min(F.struct("low", "fam")).alias("first"),
        (F.max("kids") > 0).alias("all_kids"),
    )
    shared = merged.where("families > 1").selectExpr("node", "all_n", "first.low as all_low", "all_kids", "first.fam as owner")
    back = small.drop("ends").join(shared, "node", "left")
    parts = back.groupBy("fam").applyInArrow(_family_sums, _PART_DDL)
    sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    nodes = parts.groupBy("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs").agg(*sums)
    return Trie(nodes, small.select("node", F.explode("ends").alias("conv_id")))


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) in order to rows (node, ends_sha256); a node's ids are hashed as they stream by and never gathered."""
    now, digest = None, None
    for batch in batches:
        done = []
        for node, conv in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
            if node != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(now, digest.hexdigest())])


def _digest_rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256): SHA-256 of the ids that end at a node, ascending and joined by commas."""
    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_id_digests, "node binary, ends_sha256 string")


ORACLE = r"""
WITH RECURSIVE bytes AS (
  SELECT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT) AS b
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(b, lambda crc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, x)), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM bytes),
turns AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT h.conv_id, t.d, t.x, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.d <= h.h
  UNION ALL SELECT h.conv_id, t.d, t.x, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.d > h.h),
placed AS (SELECT conv_id, text, x, row_number() OVER (PARTITION BY conv_id ORDER BY d) AS d FROM rebuilt),
paths AS (
  SELECT conv_id, d, sha256(string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM placed
  UNION ALL SELECT conv_id, 0, 'root', 0 FROM heads),
steps AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, lead(k) OVER (PARTITION BY conv_id ORDER BY d) AS down FROM paths),
nodes AS (
  SELECT k, d, up, words, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT down) AS n_children,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (down IS NULL), '')) AS ends_sha256
  FROM steps GROUP BY k, d, up, words),
within AS (SELECT DISTINCT a.k AS top, b.k AS k FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (
  SELECT w.top, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
  FROM within w JOIN nodes n ON n.k = w.k GROUP BY w.top)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.k LEFT JOIN nodes p ON p.k = n.up
"""
