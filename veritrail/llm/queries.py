"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, sharding, substring_dedup, suffix_dedup
from .ann_search import op1_ann_search
from .bpe import op10_bpe_encode_decode
from .exact_dedup import op8_exact_dedup
from .language_id import op4_language_id
from .mixing import op7_mix_to_targets
from .sharding import op3_sharding
from .simhash_dedup import op9_simhash_near_dedup
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann_search, op2_substring_dedup, op3_sharding, op4_language_id, op5_toxicity, op6_suffix_dedup, op7_mix_to_targets, op8_exact_dedup, op9_simhash_near_dedup,
        op10_bpe_encode_decode, sharding.shard_balance, mixing.mix_targets,
    )
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op8_exact_dedup": exact_dedup.SQL, "shard_balance": sharding.BALANCE_SQL, "mix_targets": mixing.TARGETS_SQL,
}
