"""The text operators as queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import chat_format, decontaminate, exact_dedup, line_dedup, near_dedup, periodic_runs, pieces, pii, quality, ranked_search, suffix_dedup, token_files, toxicity
from barloom.llm.shared import documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": lambda s, d: line_dedup.op1(documents(s, d)),
    "op2_decontaminate": lambda s, d: decontaminate.op2(documents(s, d), table(s, d, "benchmark")),
    "op3_chat_format": lambda s, d: chat_format.op3(table(s, d, "conversations")),
    "op4_token_files": lambda s, d: token_files.op4(documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
    "op5_quality": lambda s, d: quality.op5(documents(s, d), table(s, d, "labels")),
    "op6_toxicity": lambda s, d: toxicity.op6(documents(s, d), table(s, d, "labels")),
    "op7_pieces": lambda s, d: pieces.op7(documents(s, d), public_tokenizers.path("piece_bpe_32k.model")),
    "op8_near_dedup": lambda s, d: near_dedup.op8(documents(s, d)),
    "op9_exact_dedup": lambda s, d: exact_dedup.op9(documents(s, d)),
    "op10_pii": lambda s, d: pii.op10(documents(s, d)),
    "op11_periodic_runs": lambda s, d: periodic_runs.op11(documents(s, d)),
    "op12_ranked_search": lambda s, d: ranked_search.op12(documents(s, d), table(s, d, "benchmark")),
    "op13_suffix_dedup": lambda s, d: suffix_dedup.op13(documents(s, d)),
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_decontaminate": decontaminate.SQL,
    "op3_chat_format": chat_format.SQL,
    "op8_near_dedup": near_dedup.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op12_ranked_search": ranked_search.SQL,
}
