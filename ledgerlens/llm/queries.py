"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, divergence, exact_dedup, language_model, minhash, packing, quality_classifier, quality_rules, simhash, token_files, turn_repair, url_filter, warc
from .common import read_table, spread
from .oracles import ORACLES


#: Vocabulary files; their place is a parameter of every operator.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(spread(read_table(spark, sf_dir, "documents")))


def op2_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip(spread(read_table(spark, sf_dir, "documents")), vocabulary(BYTE_BPE))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(spread(read_table(spark, sf_dir, "documents")), vocabulary(WORD_BPE), end_id=1)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(spread(read_table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_documents(spread(read_table(spark, sf_dir, "documents")), words=4, radius=4)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(spread(read_table(spark, sf_dir, "pages")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spread(read_table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(read_table(spark, sf_dir, "documents")), vocabulary(WORD_BPE), end_id=0)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact(read_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spread(read_table(spark, sf_dir, "documents")))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audit_damaged(read_table(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link_documents(spread(read_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_bpe_stream,
        op3_token_files,
        op4_language_model,
        op5_simhash,
        op6_warc,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_url_filter,
        op10_exact_dedup,
        op11_divergence,
        op12_turn_repair,
        op13_minhash,
    )
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
