"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import chat, decontaminate, fim, hmm, langid, license_scan, near_dup, packing, quality, repair, token_files, toxicity, wrapper
from tracefold.llm.common import materialise, new_path, read_table

#: A conversation that holds the template's own control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    written, _ = materialise(chat.format_conversations(turns.unionByName(extra)), "chat")
    return chat.digest(chat.read_back(written))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _ = materialise(token_files.write_token_files(read_table(spark, sf_dir, "documents"), new_path(spark, "tokens")), "manifest")
    return token_files.read_token_files(manifest)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_language(read_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_main_text(read_table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return repair.with_all(repair.repair_conversations(repair.damage(turns), keep_edits=False).drop("place", "edit", "role", "text"), turns)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(read_table(spark, sf_dir, "documents")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = [op1_chat_format, op2_token_files, op3_toxicity, op4_license_scan, op5_language_model, op6_near_duplicates, op7_main_text, op8_best_fit_packing, op9_decontamination, op10_quality_rules, op11_structure_repair, op12_fill_in_middle, op13_language_id, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op1_chat_format": chat.ORACLE_SQL, "op6_near_duplicates": near_dup.ORACLE_SQL, "op11_structure_repair": repair.ORACLE_SQL, "op12_fill_in_middle": fim.ORACLE_SQL}
