"""The corpus queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repliphase.llm import chat_format, decontaminate, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, prefix_trie, quality_classifier, quality_rules, sharding, token_counts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_docs(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(_docs(spark, sf_dir), benchmark)


def op3_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model)


def op4_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("words", "word_chars", "symbols", "dup_lines", "repeat_words", "base_failed", "kept", "removed_lines", "removed_words")
    rows = quality_rules.judge(quality_rules.measure(_docs(spark, sf_dir)))
    return rows.select(F.col("qr_id").alias("doc_id"), *[F.col(f"qr_{x}").alias(f"n_{x}" if x not in ("word_chars", "base_failed", "kept") else x) for x in names])


def op5_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_docs(spark, sf_dir), shards=40)
    return rows.select(
        "doc_id",
        F.col("sh_size").alias("size"),
        F.col("sh_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("sh_shard").alias("shard"),
        F.col("sh_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_docs(spark, sf_dir)).taken().drop("source")


def op7_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    crc = F.crc32(F.col("doc_id").cast("string"))
    learn = docs.where(crc % 4 != 2)
    # One training row in 64 calibrates instead of being counted.
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0
    model = language_id.train(learn.where(~aside), calibration=learn.where(aside))
    rows = language_id.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(crc % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_accepted")


def _as_layouts(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records (conv_id, place, record) in all six layouts, a conversation in one of them.

    A conversation is laid out by its id, where the layout can say it: prompts and answers need
    user and assistant by turns, renamed roles must not occur already. Otherwise it stays turn rows.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("r"), F.col("text").alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("s"))
    pairs = (F.size("s") % 2 == 0) & F.forall(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.element_at("s", k + 1).r.eqNullSafe(F.when(k % 2 == 0, "user").otherwise("assistant")) & F.element_at("s", k + 1).t.isNotNull())
    plain = ~F.exists("s", lambda x: x.role.isin("human", "gpt"))
    kind = F.pmod(F.col("conv_id"), F.lit(6))
    convs = convs.withColumn("kind", F.when((kind == 1) | (kind == 2) & plain | (kind > 2) & pairs, kind).otherwise(0))
    at = lambda k: F.element_at("s", k)

    def each(make) -> Column:
        """A record for each pair of turns."""
        return F.transform(F.sequence(F.lit(1), F.size("s") - 1, F.lit(2)), lambda k: F.to_variant_object(make(at(k).t, at(k + 1).t)))

    none = F.lit(None).cast("string")
    renamed = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    records = (
        F.when(F.col("kind") == 1, F.array(F.to_variant_object(F.struct(F.transform("s", lambda x: F.struct(x.r.alias("role"), x.t.alias("content"))).alias("messages"), none.alias("prompt")))))
        .when(F.col("kind") == 2, F.array(F.to_variant_object(F.struct(F.transform("s", lambda x: F.struct(renamed(x.r).alias("from"), x.t.alias("value"))).alias("conversations"), none.alias("messages")))))
        .when(F.col("kind") == 3, each(lambda a, b: F.struct(a.alias("instruction"), F.lit("").alias("input"), b.alias("output"), none.alias("messages"))))
        .when(F.col("kind") == 4, each(lambda a, b: F.struct(a.alias("prompt"), b.alias("completion"), none.alias("response"))))
        .when(F.col("kind") == 5, each(lambda a, b: F.struct(a.alias("prompt"), b.alias("response"), none.alias("completion"))))
        .otherwise(F.transform("s", lambda x: F.to_variant_object(F.struct(x.r.alias("role"), x.t.alias("text")))))
    )
    return convs.select("conv_id", F.posexplode(records).alias("place", "record"))


def op8_schema_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema))
    made = chat_format.format_chats(chat_format.canonical_turns(_as_layouts(rows), "conv_id", "place", "record"))
    made = made.withColumns({"turns": chat_format.read_back(F.col("formatted")), "masked": chat_format.masked(F.col("formatted"), F.col("loss_spans"))})
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return made.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are inserted, then the other half; a quarter is deleted again and inserted once more."""
    docs = _docs(spark, sf_dir)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    state = line_dedup.LineDedup(spark).insert(docs.where(part < 2)).insert(docs.where(part >= 2))
    last = docs.where(part == 3)
    rows = state.delete(last.select("doc_id")).insert(last).resolve(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(_docs(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = trie.nodes.join(prefix_trie.end_digests(trie.ends), "node", "left")
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return rows.select(*names, F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def op12_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_co_trained_quality": op3_co_trained_quality,
    "op4_line_frequency_rules": op4_line_frequency_rules,
    "op5_best_fit_sharding": op5_best_fit_sharding,
    "op6_mix_sources": op6_mix_sources,
    "op7_kneser_ney_language_id": op7_kneser_ney_language_id,
    "op8_schema_chat_format": op8_schema_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_histogram": op10_token_histogram,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_cross_polytope_dedup": op12_cross_polytope_dedup,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.ORACLE,
    "op4_line_frequency_rules": quality_rules.ORACLE,
    "op8_schema_chat_format": chat_format.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_cross_polytope_dedup": embedding_dedup.ORACLE,
}
