"""The queries of this subpackage and their SQL; ``__spark_entry__`` adds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import bpe, capfilters, chat, flac, merkle, mixing, quality, sharding, simhash, spelling, substrings, tokenfiles, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_sharding": sharding.op6_sharding,
    "op7_chat": chat.op7_chat,
    "op8_flac": flac.op8_flac,
    "op9_capfilters": capfilters.op9_capfilters,
    "op10_substrings": substrings.op10_substrings,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle": merkle.op12_merkle,
    "op13_spelling": spelling.op13_spelling,
    "pipeline": pipeline,
}

#: The others' results depend on learned weights, vocabularies, hashes or bit streams that SQL can't make;
#: tests/llm hold them against brute force, round trips or held-out accuracy.
SQL = {"op7_chat": chat.OP7_SQL, "op12_merkle": merkle.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
