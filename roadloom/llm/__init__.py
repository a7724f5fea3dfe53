"""Operators for training data: scoring, sharding, filters, tokens, chats, search, packing, duplicates, media, personal data and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    from roadloom.llm.bpe_words import op4_bpe_words
    from roadloom.llm.chat_snapshots import op6_chat_snapshots
    from roadloom.llm.external_shuffle import op2_external_shuffle
    from roadloom.llm.language_bitmask import op5_language_bitmask
    from roadloom.llm.masked_lm import op1_masked_lm
    from roadloom.llm.media_wav import op10_media_wav
    from roadloom.llm.packing import op8_vector_packing
    from roadloom.llm.personal_data import op11_personal_data
    from roadloom.llm.segment_topk import op7_segment_topk
    from roadloom.llm.simhash_dedup import op9_simhash_dedup
    from roadloom.llm.toxicity_pu import op3_toxicity_nnpu
    from roadloom.llm.vector_codes import op12_yinyang_codes
    from roadloom.llm.whitening import op13_whitening

    found = (
        op1_masked_lm,
        op2_external_shuffle,
        op3_toxicity_nnpu,
        op4_bpe_words,
        op5_language_bitmask,
        op6_chat_snapshots,
        op7_segment_topk,
        op8_vector_packing,
        op9_simhash_dedup,
        op10_media_wav,
        op11_personal_data,
        op12_yinyang_codes,
        op13_whitening,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from roadloom.llm import chat_snapshots, personal_data, segment_topk, vector_codes

    return {
        "op6_chat_snapshots": chat_snapshots.ORACLE,
        "op7_segment_topk": segment_topk.ORACLE,
        "op11_personal_data": personal_data.ORACLE,
        "op12_yinyang_codes": vector_codes.ORACLE,
    }
