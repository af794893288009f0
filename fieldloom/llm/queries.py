"""The registered queries of this package, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.language_id import predict

    return predict(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fieldloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from fieldloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.suffix_tree import score

    return score(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.line_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("row_key")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from their segments."""
    from pyspark.sql import functions as F

    from fieldloom.llm.chat import HARD_ID, HARD_TEXT, canonical_turns, format_turns, read_back

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(HARD_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text")
    )
    records = given.unionByName(hard).select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = canonical_turns(records, ["conv_id", "turn"])
    return read_back(format_turns(turns, ["turn", "place"], "conv_id"), ["turn", "place"], "conv_id")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.repair import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> dict[str, str]:
    from fieldloom.llm import chat, phrases, pii, repair, secrets

    return {"op7_secrets": secrets.report_sql(), "op8_chat_format": chat.format_sql(), "op11_personal_data": pii.report_sql(), "op12_collocations": phrases.collocations_sql(), "op13_conversation_repair": repair.report_sql()}


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_quality_rules": (op2_quality_rules, None),
    "op3_simhash": (op3_simhash, None),
    "op4_suffix_tree": (op4_suffix_tree, None),
    "op5_line_dedup": (op5_line_dedup, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_secrets": (op7_secrets, _sql()["op7_secrets"]),
    "op8_chat_format": (op8_chat_format, _sql()["op8_chat_format"]),
    "op9_packing": (op9_packing, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_personal_data": (op11_personal_data, _sql()["op11_personal_data"]),
    "op12_collocations": (op12_collocations, _sql()["op12_collocations"]),
    "op13_conversation_repair": (op13_conversation_repair, _sql()["op13_conversation_repair"]),
}
