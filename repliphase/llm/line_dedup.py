r"""Line dedup that can be undone: sharded cuckoo filters over exact reference tables.

A line's key is the line with white space ``[\x20\x09-\x0D]`` stripped and A-Z in lower case,
kept as a 128-bit hash. Keys of at least ``min_chars`` code points are referred to by the
documents that hold them: ``refs`` has one row per key and document. A key in at least
``min_docs`` documents loses its lines in all of them but the largest doc_id.

Keys are dealt over shards, each with a cuckoo filter of the keys that have references; the
shards double as the keys outgrow them, so that a filter stays a matter of one small task. Stored
references lie in a folder per shard. A batch asks the filters first. Keys that they don't know
are new: their references are stored without a look at the others. Only shards with a key that a
filter may hold are read, and of them only those keys, to leave out references that are stored
already. Deleting documents takes their references away, and keys without any leave their filter,
so that inserting and deleting in any order ends in the same state. Reference counts are of
distinct documents, so that a filter decides what is read and stored, never what comes out.

Defined cases: null or empty text is one empty line; rows that repeat a doc_id are one document,
each row cleaned by itself; a null doc_id refers to nothing and its row stays whole; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repliphase.llm import byte_words as bw
from repliphase.llm import spark_tools as st

_SPACES = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLOTS = 4
_U = np.uint64


class CuckooFilter:
    """A set of 64-bit hashes by 16-bit marks, four to a bucket, each in one of two buckets.

    Adding takes distinct hashes that are not in yet, removing takes hashes that are in; the
    exact tables see to both. ``has`` may say yes for a hash that is not in, never no for one
    that is.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, _SLOTS), np.uint16)

    @classmethod
    def holding(cls, hashes: np.ndarray) -> CuckooFilter:
        """A new filter of these hashes, at most four fifths full."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(hashes)) / (_SLOTS * 0.8)))))
        while True:
            made = cls(buckets)
            if made.add(hashes):
                return made
            buckets *= 2

    @classmethod
    def read(cls, raw: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(raw, np.uint16).reshape(-1, _SLOTS).copy()
        return made

    def bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = bw.mix(hashes.astype(_U))
        mark = (hashes >> _U(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (hashes & _U(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (bw.mix(mark.astype(_U)) & _U(len(self.table) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        mark, one = self._places(hashes)
        return ((self.table[one] == mark[:, None]) | (self.table[self._other(mark, one)] == mark[:, None])).any(1)

    def add(self, hashes: np.ndarray) -> bool:
        """False if there was no room; the filter then has to be built anew."""
        if not len(hashes):
            return True
        mark, bucket = self._places(hashes)
        rng = np.random.default_rng(len(hashes))
        for turn in range(400):
            if not len(mark):
                return True
            by = np.argsort(bucket, kind="stable")
            mark, bucket = mark[by], bucket[by]
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rank = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.r_[begin, len(bucket)]))
            # The free slots of each bucket first: entry r goes to the r-th of them.
            slots = np.argsort(self.table[bucket] != 0, axis=1, kind="stable")
            free = (self.table[bucket] == 0).sum(1)
            fits = rank < free
            self.table[bucket[fits], slots[fits, rank[fits]]] = mark[fits]
            mark, bucket, rank = mark[~fits], bucket[~fits], rank[~fits]
            if turn % 2 == 0:
                bucket = self._other(mark, bucket)
                continue
            # One entry of each full bucket takes a random slot; the mark there moves on.
            begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            slot = rng.integers(0, _SLOTS, len(begin))
            mark[begin], self.table[bucket[begin], slot] = self.table[bucket[begin], slot], mark[begin]
            bucket = self._other(mark, bucket)
        return not len(mark)

    def remove(self, hashes: np.ndarray) -> None:
        mark, one = self._places(hashes)
        for m, a, b in zip(mark.tolist(), one.tolist(), self._other(mark, one).tolist()):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


def _line_keys(text: bytes, min_chars: int) -> list[tuple[int, int] | None]:
    """The key of each line, None where it is too short."""
    import xxhash

    out: list[tuple[int, int] | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_SPACES).translate(_LOWER)
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
            out.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(key)
            out.append(((h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)))
    return out


def _references(min_chars: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, docs = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                for key in {k for k in _line_keys(text.as_py() or b"", min_chars) if k}:
                    k1.append(key[0])
                    k2.append(key[1])
                    docs.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(docs, pa.int64())], names=["k1", "k2", "doc_id"])

    return work


def _clean(min_chars: int):
    """Rows (rest..., text, drop) to (rest..., n_lines, n_dropped, kept)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, drop in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                lines = raw.split(b"\n")
                n.append(len(lines))
                if drop.is_valid and len(drop):
                    out = {(x["k1"], x["k2"]) for x in drop.as_py()}
                    lines = [x for x, key in zip(lines, _line_keys(raw, min_chars)) if key not in out]
                gone.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return work


def _hashes(table: pa.Table) -> np.ndarray:
    return table["k1"].to_numpy().view(_U) ^ bw.mix(table["k2"].to_numpy().view(_U))


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """Which keys of one shard its filter may hold."""
    known = [CuckooFilter.read(x) for x in filters["filter"].to_pylist()]
    hashes = _hashes(keys)
    maybe = reduce(np.logical_or, [f.has(hashes) for f in known], np.zeros(len(hashes), bool))
    return pa.table({"k1": keys["k1"], "k2": keys["k2"], "maybe": maybe})


def _grow(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard's filter after adding (n > 0) and removing (n < 0) keys; ``all`` has all its keys if it must be built anew."""
    shard = (keys if keys.num_rows else filters)["shard"][0].as_py()
    if not filters.num_rows:
        made = CuckooFilter.holding(_hashes(keys.filter(pc.greater(keys["n"], 0))))
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.bytes()], pa.binary()), "full": [False]})
    if not keys.num_rows:
        return pa.table({"shard": pa.array([shard], pa.int32()), "filter": filters["filter"], "full": [False]})
    made = CuckooFilter.read(filters["filter"][0].as_py())
    n, hashes = keys["n"].to_numpy(), _hashes(keys)
    made.remove(hashes[n < 0])
    fits = made.add(hashes[n > 0])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.bytes()], pa.binary()), "full": [not fits]})


class LineDedup:
    """The state of an incremental line dedup: ``refs`` (k1, k2, doc_id, shard) and ``filters`` (shard, filter).

    ``looked`` has the (k1, k2) that the last insertion looked up among the stored references.
    """

    def __init__(self, spark: SparkSession, *, min_chars: int = 20, min_docs: int = 3, keys_per_shard: int = 1 << 18):
        self.spark, self.min_chars, self.min_docs, self.keys_per_shard, self.shards = spark, min_chars, min_docs, keys_per_shard, 8
        self.refs = spark.createDataFrame([], "k1 long, k2 long, doc_id long, shard int")
        self.filters = spark.createDataFrame([], "shard int, filter binary")
        self.looked, self.n_keys = spark.createDataFrame([], "k1 long, k2 long"), 0

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))

    def _stored(self, refs: DataFrame) -> DataFrame:
        """The references, written with a folder per shard, so that a query of some shards reads only those."""
        # By document as well, so that a line of very many documents is no hot task; a shard has at most 16 files.
        refs = refs.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
        return st.written(refs, "references", by="shard").select("k1", "k2", "doc_id", "shard")

    def _make_room(self, more: int) -> None:
        """Doubles the shards until they fit ``more`` keys; stored references and filters are then dealt anew."""
        before = self.shards
        while self.n_keys + more > self.shards * self.keys_per_shard:
            self.shards *= 2
        if self.n_keys and self.shards > before:
            self.refs = self._stored(self._sharded(self.refs.drop("shard")))
            self.filters = self.filters.limit(0)
            self._update(self.refs.select("k1", "k2").distinct().withColumn("n", F.lit(1)))

    def _references_of(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
        # By key and document, so that a line of very many documents is no hot task.
        return rows.mapInArrow(_references(self.min_chars), "k1 long, k2 long, doc_id long").distinct()

    def _known(self, keys: DataFrame) -> DataFrame:
        """``keys`` with whether a filter may hold them."""
        both = keys.groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return both.applyInArrow(_probe, "k1 long, k2 long, maybe boolean")

    def _update(self, changed: DataFrame) -> None:
        """Adds keys with n = 1 to their filters and removes those with n = -1."""
        made = self._sharded(changed).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_grow, "shard int, filter binary, full boolean")
        made = st.written(made, "filters")
        full = [r.shard for r in made.where("full").select("shard").collect()]  # at most a row per shard
        self.filters = made.where("not full").select("shard", "filter")
        if full:
            # A filter without room is built anew, larger, from its shard's keys.
            keys = self.refs.where(F.col("shard").isin(full)).select("k1", "k2", "shard").distinct().withColumn("n", F.lit(1))
            again = keys.groupBy("shard").cogroup(self.filters.limit(0).groupBy("shard")).applyInArrow(_grow, "shard int, filter binary, full boolean")
            self.filters = self.filters.union(again.select("shard", "filter"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineDedup:
        """Adds the references of these documents; those that are in already stay as they are."""
        more = st.written(self._references_of(docs, id_col, text_col), "batch")
        keys = st.written(more.select("k1", "k2").distinct(), "keys")
        self._make_room(keys.count())
        asked = st.written(self._known(self._sharded(keys)), "asked") if self.n_keys else keys.withColumn("maybe", F.lit(False))
        maybe = asked.where("maybe").select("k1", "k2")
        touched = [r.shard for r in self._sharded(maybe).select("shard").distinct().collect()]  # at most a row per shard
        self.looked, new = maybe, keys
        if touched:
            stored = self.refs.where(F.col("shard").isin(touched)).join(maybe, ["k1", "k2"], "left_semi")
            stored = st.written(stored.select("k1", "k2", "doc_id"), "stored")
            # A key that a filter holds only seemingly has no stored reference and is new all the same.
            new = keys.join(stored.select("k1", "k2").distinct(), ["k1", "k2"], "left_anti")
            more = more.join(stored, ["k1", "k2", "doc_id"], "left_anti")
        new = st.written(new.withColumn("n", F.lit(1)), "new")
        self.refs = self.refs.union(self._stored(self._sharded(more)))
        self._update(new)
        self.n_keys += new.count()
        return self

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineDedup:
        """Takes the references of these documents away, as if they had never been inserted."""
        ids = ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        gone = st.written(self.refs.join(ids, "doc_id", "left_semi"), "gone")
        left = self._stored(self.refs.join(ids, "doc_id", "left_anti"))
        keys = gone.select("k1", "k2").distinct()
        # Of the stored keys only those that lost a reference are looked at.
        # One row per key before the join, so that a line of very many documents is no hot task.
        held = left.select("k1", "k2").distinct().join(keys, ["k1", "k2"], "left_semi")
        dead = st.written(keys.join(held, ["k1", "k2"], "left_anti").withColumn("n", F.lit(-1)), "dead")
        self.refs = left
        self._update(dead)
        self.n_keys -= dead.count()
        return self

    def counts(self) -> DataFrame:
        """Rows (k1, k2, n_docs, last_doc): the exact reference counts."""
        # First by document, which also deals a line of very many documents over many tasks.
        return self.refs.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def resolve(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows (doc_id, n_lines, n_dropped, kept): the documents without the lines they lose now; those not inserted stay whole."""
        # Written first, so that a line of very many documents can be split when it is joined.
        often = st.written(self.counts().where(F.col("n_docs") >= self.min_docs).select("k1", "k2", "last_doc"), "often")
        drop = self.refs.join(often, ["k1", "k2"]).where("doc_id <> last_doc").groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        rows = rows.join(drop, "doc_id", "left").select("doc_id", "text", "drop")
        return rows.mapInArrow(_clean(self.min_chars), "doc_id long, n_lines long, n_dropped long, kept string")


ORACLE = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM t),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, (o.key IS NOT NULL AND k.doc_id <> o.last) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
