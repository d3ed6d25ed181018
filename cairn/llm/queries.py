"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import chat, mixing, sharding, suffix
from cairn.llm.audio import op1_audio_features
from cairn.llm.bpe import op5_bpe_codec
from cairn.llm.chat import op9_chat_format
from cairn.llm.minhash import op4_minhash
from cairn.llm.mixing import op8_source_mix
from cairn.llm.quality import op6_quality_fm
from cairn.llm.sharding import op7_sharding
from cairn.llm.simhash import op3_simhash
from cairn.llm.suffix import op10_suffix_dedup
from cairn.llm.token_codes import op2_token_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_audio_features, op2_token_codes, op3_simhash, op4_minhash, op5_bpe_codec, op6_quality_fm, op7_sharding, op8_source_mix, op9_chat_format, op10_suffix_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For the others, which rest on XXH64, media, tokenizers or models, tests/llm has brute force."""
    return {"op7_sharding": sharding.SQL, "op8_source_mix": mixing.SQL, "op9_chat_format": chat.SQL, "op10_suffix_dedup": suffix.SQL}
