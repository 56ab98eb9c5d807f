r"""Quality rules: cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z in lower case, runs of white space as one space, ends stripped) and
hashed; for each host the distinct documents that hold a line are counted, or if asked their
distinct texts, so that copies count once. Lines in more than ``most_docs`` documents of a host are removed, and a document that loses
more than a share of its words, or failed the basic rules, is rejected. The limit is the same for
a host of fifty documents and for one with a third of all.

Defined cases: null text is empty, has no words and fails the basic rules; a null host is a host
of its own; rows that repeat id, host and text have the same verdict; lines without a word are
neither counted nor removed. Columns named like the new ones are replaced, all others stay; new
ones are prefixed qr_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repliphase.llm import spark_tools as st

_WS = r"[\x20\x09-\x0D]+"
_WS_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array."""
    return F.filter(F.split(text, _WS), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), _WS, " "))


def repeat_words(tokens: Column, width: int) -> Column:
    """How many words stand in windows of ``width`` words that occur twice or more in the array."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.when(k + 1 < F.size(starts), F.least(F.lit(width), F.get(starts, k + 1) - p)).otherwise(width))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        # Equal windows are neighbours once sorted; a window counts if either neighbour is equal.
        starts = _let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h)),
                    lambda x: x.k,
                )
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(starts, covered))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda k: F.xxhash64(F.slice(w, k, width)))

    # Words are hashed once, windows then as numbers.
    return _let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(_let(hashed(w), repeated)))


#: The columns that ``quality_rules`` adds.
MADE = ("qr_words", "qr_word_chars", "qr_symbols", "qr_repeat_words", "qr_dup_lines", "qr_base_failed", "qr_removed_lines", "qr_removed_words", "qr_kept", "qr_text")


def _print(text: Column) -> Column:
    return F.xxhash64(text)


def _same(a: str, b: str) -> Column:
    """Two sides' rows stand for the same document."""
    match = F.col(f"{a}.qr_print") == F.col(f"{b}.qr_print")
    for c in ("qr_id", "qr_host"):
        match = match & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return match


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, repeat_width: int = 8) -> DataFrame:
    """One row per document, without its text, written once: qr_id, qr_host, qr_print (a hash of
    the text), the measures of the basic rules, and qr_lines (hash and words of each line with a word)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_words = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    with_words = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    line = lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), n_words(x).cast("int").alias("w"))
    rows = docs.select(
        F.col(id_col).alias("qr_id"),
        F.col(host_col).cast("string").alias("qr_host"),
        _print(text).alias("qr_print"),
        n_words(text).alias("qr_words"),
        F.char_length(F.translate(text, _WS_CHARS, "")).cast("long").alias("qr_word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("qr_symbols"),
        repeat_words(words(text), repeat_width).cast("long").alias("qr_repeat_words"),
        _let(with_words, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.transform(x, line).alias("lines"))).alias("_l"),
    )
    rows = rows.select("*", F.col("_l.dup").alias("qr_dup_lines"), F.col("_l.lines").alias("qr_lines")).drop("_l")
    return st.written(rows, "measures")


def judge(
    measured: DataFrame, *, min_words: int = 20, repeat_percent: int = 30, most_docs: int = 20, lost_percent: int = 50, copies_once: bool = False,
) -> DataFrame:
    """The measured rows with qr_base_failed, qr_removed_lines, qr_removed_words, qr_removed (their hashes) and qr_kept."""
    key = ["qr_id", "qr_host", "qr_print"]
    # Rows that repeat a document count once.
    seen = measured.groupBy(*key).agg(F.first("qr_lines").alias("l")).select(*key, F.explode("l").alias("l")).select(*key, "l.h", "l.w")
    # A line that a document repeats counts once, before the shuffle for the line.
    held = seen.select("qr_host", "h", *(["qr_print"] if copies_once else ["qr_id", "qr_print"])).distinct()
    often = held.groupBy("qr_host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_docs)
    often = often.select(F.col("qr_host").alias("_lh"), F.col("h").alias("_lk"))
    hit = seen.join(often, F.col("qr_host").eqNullSafe(F.col("_lh")) & (F.col("h") == F.col("_lk")))
    lost = hit.groupBy(*key).agg(F.sum("w").alias("words"), F.count("*").alias("lines"), F.collect_set("h").alias("hashes"))
    out = measured.alias("a").join(lost.alias("b"), _same("a", "b"), "left")
    gone = F.coalesce("b.words", F.lit(0)).cast("long")
    failed = (F.col("a.qr_words") < min_words) | (100 * F.col("a.qr_repeat_words") > repeat_percent * F.col("a.qr_words"))
    return out.select(
        *[F.col(f"a.{c}") for c in measured.columns if c != "qr_lines"],
        failed.alias("qr_base_failed"),
        F.coalesce("b.lines", F.lit(0)).cast("long").alias("qr_removed_lines"),
        gone.alias("qr_removed_words"),
        F.col("b.hashes").alias("qr_removed"),
        (~failed & (100 * gone <= lost_percent * F.col("a.qr_words"))).alias("qr_kept"),
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, repeat_width: int = 8, **limits) -> DataFrame:
    """``docs`` with its measures, verdict and cleaned text: the columns of ``judge`` and qr_text.

    qr_text is the text without the removed lines.
    """
    docs = docs.drop(*MADE)
    judged = judge(measure(docs, id_col, text_col, host_col, repeat_width=repeat_width), **limits)
    doc, host, mark, removed = st.unused(docs.columns, "doc", "host", "print", "removed")
    judged = judged.dropDuplicates(["qr_id", "qr_host", "qr_print"]).withColumnsRenamed({"qr_id": doc, "qr_host": host, "qr_print": mark, "qr_removed": removed})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & F.col(host_col).cast("string").eqNullSafe(F.col(host)) & (_print(text) == F.col(mark))
    left = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col(removed), F.xxhash64(normal_line(x))))
    out = docs.join(judged, same).withColumn("qr_text", F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n")))
    return out.select(*docs.columns, *MADE)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
w AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS k, ws FROM m WHERE len(ws) >= 8),
h AS (SELECT doc_id, k, array_to_string(ws[k:k+7], ' ') AS g FROM w),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p
        FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1)
  GROUP BY doc_id),
l AS (
  SELECT doc_id, source, t, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS nw
  FROM (SELECT doc_id, source, t, unnest(ls) AS x FROM m)),
often AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT doc_id) > 20),
lost AS (
  SELECT l.doc_id, sum(l.nw) AS gone, count(*) AS lines FROM l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY l.doc_id),
f AS (
  SELECT m.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost.gone, 0)::BIGINT AS gone, coalesce(lost.lines, 0)::BIGINT AS lines
  FROM m LEFT JOIN r ON m.doc_id = r.doc_id LEFT JOIN lost ON m.doc_id = lost.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * gone <= 50 * n_words) AS kept,
  lines AS n_removed_lines, gone AS n_removed_words
FROM f
"""
