"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are encoded once; each task sends one row per distinct encoded length of a batch.
The histogram (one row per distinct length) carries suffix sums, from which every question
about a context limit is one lookup.

Defined cases: null and empty text have length 0; repeated rows count each time; an empty table
gives an empty histogram, totals of 0 and null quantiles. Texts of any length are encoded whole:
the encoder's own splitter gives up on runs of some hundred thousand spaces or line ends, and such
a text is split by another matcher of the same pattern and encoded piece by piece, which gives the
same tokens. Only the text column is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repliphase.llm import spark_tools as st

# Fixed value: the public pre-tokenisation pattern of the 50k byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_MOST_VOCABULARY = 64 << 20
_SPAN = 64
_encoders: dict[tuple[str, str], object] = {}


def _encoder(raw: bytes, pattern: str):
    """The encoder of a vocabulary and pattern, kept by the content of both."""
    import tiktoken

    key = hashlib.sha256(raw).hexdigest(), pattern
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_length(encoder, pattern: str, text: str) -> int:
    """How many tokens a text has."""
    try:
        return len(encoder.encode_ordinary(text))
    except BaseException as error:
        # The splitter panics where its backtracking outgrows its stack; its exception has no importable name.
        if type(error).__name__ != "PanicException":
            raise
    return sum(len(encoder._encode_single_piece(m.group())) for m in regex.finditer(pattern, text))


def _counts(vocabulary, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, pattern)
        for batch in batches:
            lengths = [encoded_length(encoder, pattern, text.as_py() or "") for text in batch.column(0)]
            values, docs = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(docs)], names=["n_tokens", "docs"])

    return work


def length_histogram(docs: DataFrame, text_col: str = "text", *, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Rows (n_tokens, docs, tokens, docs_from, tokens_from, truncated_tokens), one per encoded length.

    docs_from and tokens_from are suffix sums over documents of at least that length;
    truncated_tokens is what all documents come to when each is cut at n_tokens. The vocabulary
    is a file of base64 tokens and ranks that the driver reads and broadcasts (64 MB at most).
    """
    path = Path(vocabulary)
    if path.stat().st_size > _MOST_VOCABULARY:
        raise ValueError(f"the vocabulary is larger than {_MOST_VOCABULARY} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(path.read_bytes())
    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts(sent, pattern), "n_tokens long, docs long")
    # Written, as the suffix sums read it more than once and the texts are to be encoded once.
    return with_suffix_sums(st.written(found.groupBy("n_tokens").agg(F.sum("docs").alias("docs")), "lengths"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds the suffix sums to (n_tokens, docs), by spans of lengths so that no task holds all of them."""
    hist = hist.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("_s", F.expr(f"n_tokens div {_SPAN}"))
    spans = hist.groupBy("_s").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    # One row for each run of lengths that occurs: bounded by the longest document.
    later = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_s", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c + "_later") for c in ("_d", "_t")], F.sum("_t").over(Window.partitionBy()).alias("_all"))
    down = Window.partitionBy("_s").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.join(spans, "_s")
    hist = hist.withColumn("docs_from", F.sum("docs").over(down) + F.col("_d_later")).withColumn("tokens_from", F.sum("tokens").over(down) + F.col("_t_later"))
    cut = F.col("_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return hist.select("n_tokens", "docs", "tokens", "docs_from", "tokens_from", cut.alias("truncated_tokens"))


def answers(hist: DataFrame, limits: list[int], quantiles: list[float]) -> dict:
    """Totals, truncated totals and fitting documents for each limit, and length quantiles.

    The quantile q is the least length that at least q of the documents do not exceed. Each
    answer is one filtered row of the histogram.
    """
    total = hist.agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).first()
    docs, tokens = total["d"] or 0, total["t"] or 0
    out: dict = {"docs": docs, "tokens": tokens, "limits": {}, "quantiles": {}}
    for limit in limits:
        row = hist.where(F.col("n_tokens") > limit).agg(F.max("docs_from").alias("d"), F.max("tokens_from").alias("t")).first()
        over, of = row["d"] or 0, row["t"] or 0
        out["limits"][limit] = {"docs_within": docs - over, "tokens_within": tokens - of, "truncated_tokens": tokens - of + limit * over}
    for q in quantiles:
        row = hist.where(F.lit(docs) - F.col("docs_from") + F.col("docs") >= F.lit(float(q)) * docs).agg(F.min("n_tokens").alias("n")).first()
        out["quantiles"][q] = row["n"]
    return out
