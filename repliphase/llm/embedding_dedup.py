"""Near duplicates of embeddings by cross-polytope hashing.

Vectors link when their labels are equal and their cosine, in double precision, reaches the
threshold. Steps, each over all vectors:

1. equal vectors of one label become one class, which one of them stands for;
2. each class is rotated, pseudo-randomly, by three rounds of sign flips and a fast Hadamard
   transform, and hashed to the nearest vertex of the cross-polytope: the coordinate with the
   largest absolute value and its sign. A bucket is named by the vertices of ``k`` rotations; the
   next-nearest vertices give further buckets to probe. ``k`` follows from the largest label, so
   that unlike vectors do not crowd a bucket; the number of tables follows from the recall that a
   pair exactly at the threshold must have, measured on such pairs when the query is planned;
3. in each bucket a class stays if the signs of 128 further projections are near enough to those of
   another: a semi-join, which never makes pairs. A pair at the threshold differs in too many signs
   once in 10^8;
4. what stays is compared with whole vectors, bucket by bucket; small buckets share a task, larger
   ones are cut into blocks, and each pair of blocks is a unit of work. A pair that shares several
   buckets counts in the first of them alone. A unit returns link counts and the spanning ties of
   what it linked, never the pairs;
5. components of the ties are the result.

Defined cases: a vector that is null, empty, all zero, or holds a null or non-finite component, and
one without a label, links with nothing, and neither do vectors of different lengths; any scale of
components is fine; rows that repeat an id are one vector, of them the one with the smallest label,
then print (a null label is the smallest); a row with a null id has no links, a null component and a
null ``kept``; an empty table gives no rows. Other columns of the input are not read. No bucket,
probe or partner is capped.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.llm import byte_words as bw
from repliphase.llm import spark_tools as st

_U = np.uint64
_SKETCH = 128


class Plan(NamedTuple):
    """How vectors of one padded size are hashed: rotations per bucket, tables, and buckets probed in each."""

    size: int
    rotations: int
    tables: int
    probes: int


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; their length is a power of two."""
    rows, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x / math.sqrt(size)


@functools.lru_cache(maxsize=512)
def _signs(size: int, number: int) -> np.ndarray:
    """The sign flips of the three rounds of a numbered rotation."""
    return np.random.default_rng([size, number]).choice((-1.0, 1.0), (3, size))


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    for flips in _signs(x.shape[1], number):
        x = hadamard(x * flips)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    size = max(2, 1 << (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1])))


def buckets(x: np.ndarray, plan: Plan) -> np.ndarray:
    """The buckets of unit rows of the padded size: (rows, tables, probes), as vertex numbers mixed into one number, nearest first."""
    rows = len(x)
    out = np.zeros((rows, plan.tables, plan.probes), _U)
    deep = min(plan.probes, 2 * plan.size)
    for table in range(plan.tables):
        # Ways to choose one vertex in each rotation so far, with what they fall short of the nearest.
        codes, short = np.full((rows, 1), table, _U), np.zeros((rows, 1))
        for k in range(plan.rotations):
            y = rotate(x, table * plan.rotations + k)
            y = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-y, deep - 1, axis=1)[:, :deep]
            value = np.take_along_axis(y, top, 1)
            order = np.argsort(-value, axis=1, kind="stable")
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            gap = value[:, :1] ** 2 - np.sign(value) * value**2
            short = (short[:, :, None] + gap[:, None, :]).reshape(rows, -1)
            codes = bw.mix(codes[:, :, None] * _U(2 * plan.size) + top[:, None, :].astype(_U)).reshape(rows, -1)
            best = np.argsort(short, axis=1, kind="stable")[:, : plan.probes]
            codes, short = np.take_along_axis(codes, best, 1), np.take_along_axis(short, best, 1)
        out[:, table, : codes.shape[1]] = codes
        out[:, table, codes.shape[1] :] = codes[:, :1]
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """Two numbers of 64 signs of each row."""
    count, bits = -(-_SKETCH // x.shape[1]), []
    for k in range(count):
        bits.append(rotate(x, 1_000_000 + k) > 0)
    bits = np.concatenate(bits, axis=1)[:, :_SKETCH]
    return np.packbits(bits, axis=1).view(np.int64)


def pairs_at(size: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows at exactly this cosine, the same each time; fewer of long rows."""
    rng, count = np.random.default_rng(size), min(4000, max(400, (1 << 21) // size))
    a, b = rng.standard_normal((2, count, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


def plan_for(size: int, rows: int, cosine: float, recall: float, crowd: int = 256, probes: int = 4) -> Plan:
    """The plan for labels of up to so many rows: about ``crowd`` unlike rows at most share a bucket by chance."""
    rotations = max(1, math.ceil(math.log(max(1, rows * probes / crowd)) / math.log(2 * size)))
    one = Plan(size, rotations, 1, min(probes, 2 * size))
    a, b = pairs_at(size, cosine)
    met = (buckets(a, one)[:, 0, :, None] == buckets(b, one)[:, 0, None, :]).any((1, 2)).mean()
    met = min(max(met - 2 * math.sqrt(met * (1 - met) / len(a)), 1e-3), 1 - 1e-6)
    return one._replace(tables=math.ceil(math.log(1 - recall) / math.log(1 - met)))


def signs_apart(cosine: float) -> int:
    """In how many signs of a sketch a pair at this cosine may differ: seven standard deviations above the mean."""
    share = math.acos(cosine) / math.pi
    return math.ceil(_SKETCH * share + 7 * math.sqrt(_SKETCH * share * (1 - share)))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit rows in double precision) by length of vector, of those vectors that can link, a bounded number at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number
    begin = np.r_[0, np.cumsum(lengths)]
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        step = max(1, (1 << 20) // int(length))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            x = values[begin[some][:, None] + np.arange(length)]
            most = np.abs(x).max(axis=1)
            ok = np.isfinite(most) & (most > 0)
            some, x = some[ok], x[ok] / most[ok, None]
            if len(some):
                yield some, x / np.linalg.norm(x, axis=1, keepdims=True)


def _prints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each row."""
    place = np.arange(x.shape[1], dtype=_U)
    bits = (x + 0.0).view(_U)
    return tuple(bw.mix(bits + bw.mix(place + _U(seed))).sum(axis=1, dtype=_U).view(np.int64) for seed in (0x51ED270B, 0x2545F491))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, vector) to (vec_id, label, size, p1, p2); the size is null where the vector links with nothing.

    Prints are of unit rows: a vector and its multiple by a power of two are one class.
    """
    for batch in batches:
        size, p1, p2 = (np.zeros(len(batch), np.int64) for _ in range(3))
        for rows, x in _vectors(batch.column(2)):
            size[rows] = x.shape[1]
            p1[rows], p2[rows] = _prints(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, mask=size == 0), pa.array(p1), pa.array(p2)], names=["vec_id", "label", "size", "p1", "p2"])


def _keys(x: np.ndarray, label: np.ndarray, plans: dict[int, Plan]) -> np.ndarray:
    """The buckets of unit rows, for each label its own."""
    wide = padded(x)
    found = buckets(wide, plans[wide.shape[1]])
    return bw.mix(found ^ bw.mix(label.view(_U) + _U(x.shape[1]))[:, None, None]).view(np.int64)


def _entries(plans: dict[int, Plan]):
    """Rows (vec_id, vector, label_hash, p1) to (key, vec_id, s1, s2), one for each bucket of a class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label, p1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            for rows, x in _vectors(batch.column(1)):
                mine = _prints(x)[0] == p1[rows]  # else another row of a repeated id
                rows, x = rows[mine], x[mine]
                if not len(rows):
                    continue
                keys = np.sort(_keys(x, label[rows], plans).reshape(len(rows), -1), axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                row, signs = np.nonzero(new)[0], sketch(padded(x))
                yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(ids[rows][row]), pa.array(signs[row, 0]), pa.array(signs[row, 1])], names=["key", "vec_id", "s1", "s2"])

    return work


def _uncounted(keys: np.ndarray, a: np.ndarray, b: np.ndarray, now: int) -> np.ndarray:
    """Which pairs of rows meet in bucket ``now`` first: in no earlier table, and in no smaller bucket of its table."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    table = int(np.flatnonzero((keys[a[0]] == now).any(axis=1))[0])
    step = max(1, (1 << 22) // keys[0, : table + 1].size // keys.shape[2])
    for k in range(0, len(a), step):
        x, y = keys[a[k : k + step], : table + 1], keys[b[k : k + step], : table + 1]
        same = x[:, :, :, None] == y[:, :, None, :]
        same[:, table] &= (x[:, table] < now)[:, :, None]
        out[k : k + step] = ~same.any(axis=(1, 2, 3))
    return out


def _lowest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the rows the smallest row that pairs connect it with."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(cosine: float, plans: dict[int, Plan]):
    """One unit of work: rows (key, vec_id, side, vector, times, label_hash, p1) to rows (vec_id, root, links)."""

    def linked(x: np.ndarray, label: np.ndarray, key: np.ndarray, side: np.ndarray) -> tuple[list, list]:
        keys, left, right = _keys(x, label, plans), [], []
        by = np.lexsort((label, key))
        cuts = np.flatnonzero(np.r_[True, (np.diff(key[by]) != 0) | (np.diff(label[by]) != 0), True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = by[lo:hi]
            if len(rows) < 2:
                continue
            ok = np.triu(x[rows] @ x[rows].T >= cosine, 1)
            if len(np.unique(side[rows])) > 1:
                ok &= side[rows][:, None] != side[rows][None, :]
            a, b = np.nonzero(ok)
            a, b = rows[a], rows[b]
            first = _uncounted(keys, a, b, key[rows[0]])
            left.append(a[first])
            right.append(b[first])
        return left, right

    def work(rows: pa.Table) -> pa.Table:
        key, ids, side, times, label, p1 = (rows[c].to_numpy() for c in ("key", "vec_id", "side", "times", "label_hash", "p1"))
        found: dict[int, list] = {}
        for some, x in _vectors(rows["vector"]):
            mine = _prints(x)[0] == p1[some]
            found.setdefault(x.shape[1], []).append((some[mine], x[mine]))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for parts in found.values():
            at, x = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            _, first = np.unique(np.stack([key[at], ids[at]]), axis=1, return_index=True)  # equal rows of one id
            at, x = at[first], x[first]
            if len(at):
                a, b = linked(x, label[at], key[at], side[at])
                left += [at[r] for r in a]
                right += [at[r] for r in b]
        names, place = np.unique(ids, return_inverse=True)
        a, b = np.concatenate(left), np.concatenate(right)
        links = np.zeros(len(names), np.int64)
        np.add.at(links, place[a], times[b])
        np.add.at(links, place[b], times[a])
        root, some = _lowest(len(names), place[a], place[b]), links > 0
        return pa.table({"vec_id": names[some], "root": names[root[some]], "links": links[some]})

    return work


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    *, cosine: float = 0.93, recall: float = 0.99999, probes: int = 4, block: int = 512,
) -> DataFrame:
    """Links of all vectors: rows (vec_id, n_links, component_id, kept), one per vector.

    n_links counts the other vectors at or above ``cosine`` that share a bucket. ``recall`` is what share of pairs at exactly ``cosine`` must share one (pairs
    above meet more often), ``probes`` the buckets of a vector in each table, ``block`` the most
    classes on one side of a unit of work.
    """
    kind = dict(vectors.dtypes)[vector_col]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"))
    named_as = f"vec_id long, label {dict(source.dtypes)['label']}, size long, p1 long, p2 long"
    passed = st.written(source.mapInArrow(_first_pass, named_as), "prints")

    named = passed.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "size", "p1", "p2")).alias("s")).select("vec_id", "s.*")
    able = named.where("size is not null and label is not null")
    classes = able.groupBy("label", "size", "p1", "p2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    classes = st.written(classes.withColumn("label_hash", F.xxhash64("label")), "classes")
    # A padded size and the rows of its largest label; there are few sizes.
    most = classes.groupBy("label", F.expr("shiftleft(2L, greatest(0, cast(ceil(log2(size)) as int) - 1))").alias("wide")).count().groupBy("wide").agg(F.max("count").alias("rows"), F.sum("count").alias("all"))
    sizes = most.collect()
    plans = {r["wide"]: plan_for(r["wide"], r["rows"], cosine, recall, probes=probes) for r in sizes}
    shares = 1 + sum(r["all"] * plans[r["wide"]].tables * plans[r["wide"]].probes for r in sizes) // 8192

    own = source.select("vec_id", "vector").join(classes.select(F.col("rep").alias("vec_id"), "times", "label_hash", "p1"), "vec_id")
    entries = own.select("vec_id", "vector", "label_hash", "p1").mapInArrow(_entries(plans), "key long, vec_id long, s1 long, s2 long")
    near = f"a.key = b.key and a.vec_id <> b.vec_id and bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= {signs_apart(cosine)}"
    stay = st.written(entries.alias("a").join(entries.alias("b"), F.expr(near), "left_semi").select("key", "vec_id"), "met")

    work = _units(stay, block, shares).join(own, "vec_id")
    linked = st.written(work.groupBy("unit", "i", "j").applyInArrow(_verify(cosine, plans), "vec_id long, root long, links long"), "links")
    joined = st.components(linked.select(F.col("vec_id").alias("u"), F.col("root").alias("v")).where("u <> v"))
    per = linked.groupBy("vec_id").agg(F.sum("links").alias("links"))

    same = ["label", "size", "p1", "p2"]
    member = able.join(classes.select(*same, "rep", "times"), same).select("vec_id", "rep", "times")
    tops = joined.select(F.col("node").alias("rep"), F.col("component").alias("top"))
    found = member.join(tops, "rep", "left").join(per.withColumnRenamed("vec_id", "rep"), "rep", "left")
    found = found.select(
        "vec_id",
        F.coalesce("top", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
    )
    rest = named.where("size is null or label is null").select("vec_id").union(passed.where("vec_id is null").select("vec_id"))
    zero = F.lit(0).cast("long")
    rows = found.unionByName(rest.select("vec_id", F.col("vec_id").alias("component_id"), zero.alias("n_links")))
    return rows.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _units(stay: DataFrame, block: int, shares: int) -> DataFrame:
    """Rows (key, vec_id) to (key, vec_id, unit, i, j, side): which units of work a vector of a bucket takes part in."""
    hot = stay.groupBy("key").count().where(f"count > {block}").select("key", F.expr(f"cast(ceil(count / {block}) as int)").alias("n"))
    rows = stay.join(hot, "key", "left").withColumn("side", F.expr("cast(pmod(xxhash64(vec_id), coalesce(n, 1)) as int)"))
    small = rows.where("n is null").select("key", "vec_id", "side", F.pmod(F.xxhash64("key"), F.lit(shares)).alias("unit"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    large = rows.where("n is not null").select("key", "vec_id", "side", F.col("key").alias("unit"), F.explode(F.expr("sequence(0, n - 1)")).alias("o"))
    return small.union(large.select("key", "vec_id", "side", "unit", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j")))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, top) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.j, r.top FROM r JOIN e ON e.i = r.vec_id WHERE r.top < e.j),
c AS (SELECT vec_id, min(top) AS component_id FROM r GROUP BY vec_id),
d AS (SELECT i, count(*) AS n_links FROM e GROUP BY i)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN d ON d.i = c.vec_id
"""
