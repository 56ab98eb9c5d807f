"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters, with every run of other characters as one space; characters
beyond 16 bits are one class. Counts of the longest n-grams come from all labelled training
rows; shorter orders use Kneser-Ney continuation counts. For each order, the n-grams of all
languages are one sorted array of hashes with a row of log probabilities, a column per language,
so that scoring looks each position up once. A text goes to the language of the lowest
cross-entropy per character. Calibration rows, kept out of the counts, give a logistic
confidence from the margin and, per language, the entropy above which a text is rejected.

Defined cases: text that is null or has no letter is ``und`` with score 0 and rejected; rows
without a language or an id don't train; without any training rows everything is ``und``;
repeated rows count each time. No n-gram is left out: as long as n-grams times languages are at
most ``most_in_memory`` the model is built on the driver and broadcast; beyond, Spark works out the
same tables and writes them, sorted, in the shared folder. Executors fetch those files, a new one
again, lay the tables out beside them once and map them into memory; none passes through the
driver's memory.
"""

from __future__ import annotations

import fcntl
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repliphase.functions import ranks
from repliphase.llm import byte_words as bw
from repliphase.llm import spark_tools as st

_U = np.uint64
_ORDER = 4
_CHUNK = 1 << 20
_tables: dict[str, np.ndarray] = {}


def _codes() -> np.ndarray:
    """For each character its class: 0 for what is no letter."""
    if "codes" not in _tables:
        codes = np.zeros(0x110000, np.uint16)
        for c in range(0x110000):
            if chr(c).isalpha():
                codes[c] = min(c, 0xFFFF)
        _tables["codes"] = codes
    return _tables["codes"]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts in one array, and where each begins (one more at the end).

    Each text begins with ``_ORDER - 1`` spaces, which only serve as context.
    """
    joined = ("\0" * (_ORDER - 1)).join(["", *[(t or "").lower() for t in texts]])
    sizes = np.array([len((t or "").lower()) for t in texts], np.int64)
    code = _codes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    begin = np.concatenate([[0], np.cumsum(sizes + _ORDER - 1)])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    for k in range(_ORDER - 1):
        keep[begin[:-1] + k] = True
    # The first space of a text itself is one too many after its context.
    first = begin[:-1] + _ORDER - 1
    inside = first < begin[1:]
    keep[first[inside]] = code[first[inside]] != 0
    return code[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def _grams(code: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each position from ``_ORDER - 1`` on."""
    n = len(code) - _ORDER + 1
    out = np.zeros(max(0, n), _U)
    for k in range(_ORDER - order, _ORDER):
        out = (out << _U(16)) | code[k : k + max(0, n)].astype(_U)
    return out


def _groups(texts: list) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a million characters."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total > _CHUNK:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _valid(begin: np.ndarray, size: int) -> np.ndarray:
    """Which n-gram positions end inside a text, not in its leading context."""
    ok = np.ones(size, bool)
    for b in begin[1:-1]:
        ok[max(0, b - _ORDER + 1) : b] = False
    return ok


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, gram, n)."""
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            mine = [texts[k] for k in np.flatnonzero(langs == lang)]
            values, counts = [], []
            for a, b in _groups(mine):
                code, begin = symbols(mine[a:b])
                grams = _grams(code, _ORDER)
                v, n = np.unique(grams[_valid(begin, len(grams))], return_counts=True)
                values.append(v)
                counts.append(n)
            v, back = np.unique(np.concatenate(values), return_inverse=True)
            n = np.bincount(back, np.concatenate(counts), len(v)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(v.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Model:
    """The tables of all languages; built from (gram, count) arrays by language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.scale, self.shift, self.most = 1.0, 0.0, np.full(len(self.langs), np.inf)
        levels: list[list] = []  # by language: from order 1 up, (grams, P of seen grams, contexts, lambda)
        alphabet = max(2, len(np.unique(np.concatenate([g & _U(0xFFFF) for g, _ in counts.values()])))) + 1
        self.floor = float(np.log(1 / alphabet))
        for lang in self.langs:
            grams, n = counts[lang]
            orders = {_ORDER: (grams, n.astype(float))}
            for order in range(_ORDER - 1, 0, -1):
                # How many different characters come before: one for each distinct longer n-gram.
                mask = _U((1 << (16 * order)) - 1)
                g, c = np.unique(orders[order + 1][0] & mask, return_counts=True)
                orders[order] = (g, c.astype(float))
            mine, lower = [], None
            for order in range(1, _ORDER + 1):
                g, c = orders[order]
                one, two = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.05, one / max(1, one + 2 * two)))
                ctx, back = np.unique(g >> _U(16), return_inverse=True)
                total, types = np.bincount(back, c), np.bincount(back)
                lam = d * types / total
                below = np.full(len(g), 1 / alphabet) if lower is None else self._seen(lower, g & _U((1 << (16 * (order - 1))) - 1))
                p = np.maximum(c - d, 0) / total[back] + lam[back] * below
                lower = (g, p)
                mine.append((g, p, ctx, lam))
            levels.append(mine)
        self.hashes, self.logs, self.ctx, self.lam = [], [], [], []
        below = None
        for order in range(1, _ORDER + 1):
            union = np.unique(np.concatenate([m[order - 1][0] for m in levels]))
            contexts = np.unique(np.concatenate([m[order - 1][2] for m in levels]))
            lam = np.zeros((len(contexts), len(levels)))
            for k, m in enumerate(levels):
                lam[np.searchsorted(contexts, m[order - 1][2]), k] = np.log(m[order - 1][3])
            # Where a language has not seen an n-gram, its context's weight goes to the shorter one.
            rest = np.full((len(union), len(levels)), self.floor) if below is None else below[1][np.searchsorted(below[0], union & _U((1 << (16 * (order - 1))) - 1))]
            logp = rest + lam[np.searchsorted(contexts, union >> _U(16))]
            for k, m in enumerate(levels):
                logp[np.searchsorted(union, m[order - 1][0]), k] = np.log(m[order - 1][1])
            below = (union, logp)
            for values, rows, to_h, to_v in ((union, logp, self.hashes, self.logs), (contexts, lam, self.ctx, self.lam)):
                h = bw.mix(values + _U(order))
                by = np.argsort(h)
                to_h.append(h[by])
                to_v.append(np.ascontiguousarray(rows[by], np.float32))

    @staticmethod
    def _seen(level: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
        return level[1][np.searchsorted(level[0], grams)]

    def _look(self, code: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities, a column per language, of the characters at ``at``."""
        gram = np.zeros(len(at), _U)
        for k in range(order - 1, -1, -1):
            gram = (gram << _U(16)) | code[at - k].astype(_U)
        out = np.empty((len(at), len(self.langs)), np.float32)
        h = bw.mix(gram + _U(order))
        place = np.minimum(np.searchsorted(self.hashes[order - 1], h), len(self.hashes[order - 1]) - 1)
        hit = self.hashes[order - 1][place] == h
        out[hit] = self.logs[order - 1][place[hit]]
        if not hit.all():
            miss = ~hit
            rest = self._look(code, at[miss], order - 1) if order > 1 else np.full((miss.sum(), len(self.langs)), self.floor, np.float32)
            h = bw.mix((gram[miss] >> _U(16)) + _U(order))
            place = np.minimum(np.searchsorted(self.ctx[order - 1], h), len(self.ctx[order - 1]) - 1)
            known = self.ctx[order - 1][place] == h
            rest[known] += self.lam[order - 1][place[known]]
            out[miss] = rest
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text, a column per language; the numbers of characters."""
        total, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in _groups(texts):
            code, begin = symbols(texts[a:b])
            for k in range(b - a):
                lo, hi = begin[k] + _ORDER - 1, begin[k + 1]
                sizes[a + k] = hi - lo
            at = np.flatnonzero(np.concatenate([[False] * (_ORDER - 1), _valid(begin, max(0, len(code) - _ORDER + 1))])) if len(code) >= _ORDER else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(a, b), sizes[a:b])
            for k in range(0, len(at), 1 << 18):
                rows = self._look(code, at[k : k + (1 << 18)], _ORDER)
                own = owner[k : k + (1 << 18)]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[first]] += np.add.reduceat(rows, first, axis=0, dtype=np.float64)
        return -total / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, confidences, whether accepted, and the entropies of the chosen languages."""
        h, sizes = self.entropies(texts)
        best = h.argmin(1) if len(h) else np.zeros(0, np.int64)
        low = h[np.arange(len(h)), best]
        score = 1 / (1 + np.exp(-np.clip(self.scale * _margin(h, sizes) + self.shift, -50, 50)))
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        names = [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)]
        return names, np.where(lettered, score, 0.0), lettered & (low <= self.most[best]), low

    def calibrate(self, found: DataFrame, reject: float) -> None:
        """Fits the confidence and the entropy limits on rows (best, right, low, margin) of labelled texts outside the counts.

        Spark sums over all rows in each step of the fit, and numbers the entropies of a language for their quantile.
        """
        if not found.take(1):
            return
        w = np.zeros(2)
        for _ in range(50):
            z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("margin") * float(w[0]) + float(w[1])))
            rows = found.select("margin", "right", (1 / (1 + F.exp(-z))).alias("p"))
            r, e, x = F.col("p") * (1 - F.col("p")), F.col("right") - F.col("p"), F.col("margin")
            xx, x1, one, gx, g1 = rows.agg(F.sum(r * x * x), F.sum(r * x), F.sum(r), F.sum(e * x), F.sum(e)).first()
            # One wrong and one right pseudo-row of margin 0 keep the logistic fit finite.
            p = 1 / (1 + np.exp(-np.clip(w[1], -30, 30)))
            hessian = np.array([[xx, x1], [x1, one + 2 * p * (1 - p)]]) + 1e-3 * np.eye(2)
            step = np.clip(np.linalg.solve(hessian, np.array([gx, g1 + 1 - 2 * p]) - 1e-3 * w), -5, 5)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        self.scale, self.shift = max(0.0, float(w[0])), float(w[1])
        own = ranks.running_total(found.where("right = 1").select("best", "low"), ["best", "low"], None, "before")
        held = own.groupBy("best").agg(F.min("before").alias("first"), F.count("*").alias("n")).collect()  # a row per language
        places = {r.best: r.first + (r.n - 1) * (1 - reject) for r in held}
        wanted = sorted({int(f(x)) for x in places.values() for f in (np.floor, np.ceil)})
        value = {r.before: r.low for r in own.where(F.col("before").isin(wanted)).collect()}  # two rows per language
        for k, x in places.items():
            a, b = int(np.floor(x)), int(np.ceil(x))
            self.most[k] = value[a] + (x - a) * (value[b] - value[a]) + 0.5


def _margin(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far the second-best language lies behind, in nats, over the root of the length."""
    if h.shape[1] < 2:
        return np.sqrt(sizes.astype(float))
    two = np.partition(h, 1, axis=1)
    return (two[:, 1] - two[:, 0]) * np.sqrt(np.maximum(sizes, 1))


class StoredModel(Model):
    """A model whose tables are files that every executor fetches from the shared folder.

    ``files`` are their names in order. ``sizes`` has the rows of each table by its number: the n-grams of order o
    are 2 o, their contexts 2 o + 1.
    """

    def __init__(self, langs: list[str], alphabet: int, files: list[str], sizes: dict[int, int]):
        self.langs, self.name, self.files, self.sizes = langs, f"language-model-{uuid.uuid4().hex}", files, sizes
        self.scale, self.shift, self.most = 1.0, 0.0, np.full(len(langs), np.inf)
        self.floor = float(np.log(1 / alphabet))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("hashes", "logs", "ctx", "lam")}

    def _laid_out(self) -> str:
        """The hashes (.h) and the rows of log probabilities (.v) of all tables, one after the other.

        They lie in the folder of files that Spark gives each executor, made by the first worker that needs them.
        """
        path = os.path.join(SparkFiles.getRootDirectory(), self.name)
        with open(f"{path}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            if not os.path.exists(f"{path}.v"):
                with open(f"{path}.h", "wb") as h, open(f"{path}.new", "wb") as v:
                    for name in self.files:
                        for batch in pq.ParquetFile(SparkFiles.get(name)).iter_batches(64, columns=["h", "v"]):
                            h.writelines(batch.column(0).to_pylist())
                            v.writelines(batch.column(1).to_pylist())
                os.replace(f"{path}.new", f"{path}.v")
        return path

    def _look(self, code: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        if "hashes" not in self.__dict__:
            path = self._laid_out()
            h = np.memmap(f"{path}.h", _U, "r")
            v = np.memmap(f"{path}.v", np.float32, "r").reshape(len(h), len(self.langs))
            ends = np.cumsum([self.sizes[k] for k in sorted(self.sizes)])
            parts = [(h[e - self.sizes[k] : e], v[e - self.sizes[k] : e]) for k, e in zip(sorted(self.sizes), ends)]
            self.logs, self.lam, self.ctx = [x[1] for x in parts[::2]], [x[1] for x in parts[1::2]], [x[0] for x in parts[1::2]]
            self.hashes = [x[0] for x in parts[::2]]
        return super()._look(code, at, order)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, gram, p) to (part, h, v): the hash, turned so that signed values sort as unsigned ones, and the logarithms as bytes."""
    for batch in batches:
        part, gram = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(_U)
        h = bw.mix(gram + (part // 2).astype(_U)) ^ _U(1 << 63)
        rows = np.log(batch.column(2).flatten().to_numpy()).astype(np.float32).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "h", "v"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, h, v) to one row (h, v) of joined bytes per batch."""
    for batch in batches:
        h = batch.column(1).to_numpy().view(_U) ^ _U(1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()]), pa.array([b"".join(batch.column(2).to_pylist())])], names=["h", "v"])


def _stored(counted: DataFrame, langs: list[str]) -> StoredModel:
    """The model of the counts (lang, gram, n), worked out and written by Spark; the driver sees the names of its files.

    Tables have an array with a place per language. An unseen n-gram gets its context's weight times
    the probability of the shorter one, which is what the formula of a seen one gives with a count of 0.
    """
    spark = counted.sparkSession
    ids = spark.createDataFrame(list(enumerate(langs)), "k int, lang string")
    alphabet = max(2, counted.select(F.expr("gram & 65535")).distinct().count()) + 1
    counts = {_ORDER: counted.join(F.broadcast(ids), "lang").select("k", "gram", "n")}
    for order in range(_ORDER - 1, 0, -1):
        mask = (1 << (16 * order)) - 1
        counts[order] = st.written(counts[order + 1].groupBy("k", F.expr(f"gram & {mask}L").alias("gram")).agg(F.count("*").alias("n")), f"grams{order}")

    def by_lang(name: str) -> str:
        return f"map_from_entries(collect_list(struct(k, {name})))"

    def each(body: str) -> str:
        return f"transform(sequence(0, {len(langs) - 1}), k -> {body})"

    below, tables, sizes = None, [], {}
    for order in range(1, _ORDER + 1):
        few = {r.k: (r.one, r.two) for r in counts[order].groupBy("k").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}  # a row per language
        d = "array(" + ", ".join(f"{min(0.95, max(0.05, few[k][0] / max(1, few[k][0] + 2 * few[k][1])))!r}D" for k in range(len(langs))) + ")"
        wide = counts[order].groupBy("gram").agg(F.expr(by_lang("n")).alias("c"))
        ctx = counts[order].groupBy(F.expr("shiftrightunsigned(gram, 16)").alias("ctx"), "k").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        ctx = ctx.groupBy("ctx").agg(F.expr(by_lang("total")).alias("totals"), F.expr(by_lang("types")).alias("types"))
        # Totals are null, and the weight is 1, where a language has not seen the context.
        ctx = ctx.select("ctx", F.expr(each("totals[k]")).alias("totals"), F.expr(each(f"coalesce({d}[k] * types[k] / totals[k], 1D)")).alias("lam"))
        ctx = st.written(ctx, f"contexts{order}")
        rows = wide.withColumn("ctx", F.expr("shiftrightunsigned(gram, 16)")).join(F.broadcast(ctx) if order == 1 else ctx, "ctx")
        if below is None:
            rows = rows.withColumn("below", F.expr(each(f"1D / {alphabet}")))
        else:
            shorter = below.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.expr(f"gram & {(1 << (16 * (order - 1))) - 1}L")).join(shorter, "suffix")
        p = each(f"coalesce(greatest(coalesce(c[k], 0) - {d}[k], 0D) / totals[k], 0D) + lam[k] * below[k]")
        below = st.written(rows.select("gram", F.expr(p).alias("p")), f"logs{order}")
        for part, table in ((2 * order, below), (2 * order + 1, ctx.select(F.col("ctx").alias("gram"), F.col("lam").alias("p")))):
            tables.append(table.select(F.lit(part).alias("part"), "gram", "p"))
            sizes[part] = table.count()
    together = tables[0]
    for table in tables[1:]:
        together = together.union(table)
    rows = together.mapInArrow(_hashed, "part int, h long, v binary").orderBy("part", "h").mapInArrow(_packed, "h binary, v binary")
    files = sorted(st.written(rows, "model").inputFiles())
    for file in files:
        spark.sparkContext.addFile(file)
    return StoredModel(langs, alphabet, [file.rsplit("/", 1)[1] for file in files], sizes)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, calibration: DataFrame | None = None, most_in_memory: int = 8_000_000, reject: float = 0.001) -> Model | None:
    """A model from all rows and n-grams of ``docs``; None without any. All ``calibration`` rows fit confidence and
    rejection. ``most_in_memory`` (n-grams times languages) decides where the
    tables are held, not what is in them."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = st.written(counted, "grams")
    held = {r.lang: r["count"] for r in counted.groupBy("lang").count().collect()}  # a row per language
    if not held:
        return None
    if sum(held.values()) * len(held) > most_in_memory:
        model = _stored(counted, sorted(held))
    else:
        table = counted.toArrow()
        by, grams, n = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().view(_U), table["n"].to_numpy()
        counts = {}
        for lang in sorted(held):
            mine = by == lang
            order = np.argsort(grams[mine])
            counts[lang] = (grams[mine][order], n[mine][order])
        model = Model(counts)
    if calibration is not None:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, sizes = sent.value.entropies(batch.column(1).to_pylist())
                best = h.argmin(1)
                right = np.array([sent.value.langs[k] == lang for k, lang in zip(best, batch.column(0).to_pylist())], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), pa.array(right), pa.array(h[np.arange(len(h)), best]), pa.array(_margin(h, sizes))], names=["best", "right", "low", "margin"])

        some = calibration.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
        model.calibrate(st.written(some.mapInArrow(work, "best int, right int, low double, margin double"), "calibration"), reject)
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_accepted and lang_entropy."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            if sent.value is None:
                n = len(texts)
                found = (["und"] * n, np.zeros(n), np.zeros(n, bool), np.zeros(n))
            else:
                found = sent.value.predict(texts)
            columns = [*batch.columns[:-1], pa.array(found[0], pa.string()), *map(pa.array, found[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_accepted", "lang_entropy")]
    names = [*kept, "lang_pred", "lang_score", "lang_accepted", "lang_entropy"]
    schema = docs.select(*kept).schema
    for name, kind in (("lang_pred", "string"), ("lang_score", "double"), ("lang_accepted", "boolean"), ("lang_entropy", "double")):
        schema = schema.add(name, kind)
    return docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(work, schema)
