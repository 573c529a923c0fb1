"""The registered query of each operator in this subpackage, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .decontamination import op8_suffix_arrays
from .html_text import op2_text_tag_ratio
from .importance import op11_crc_resampling
from .jaccard_join import op12_jaccard_join
from .license_scan import op9_license_automaton
from .lm_scoring import op6_bloom_language_model
from .mixing import op3_pivotal_mixing
from .near_dedup import op1_near_duplicates
from .oracle import CONTAMINATION, JACCARD_JOIN, NEAR_DUPLICATES, RESAMPLING
from .periodic import op13_periodic_runs
from .quality_classifier import op4_fourier_ridge
from .quality_rules import op7_perplexity_rules
from .sharding import op10_sampled_splitters
from .token_files import op5_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_text_tag_ratio": op2_text_tag_ratio,
    "op3_pivotal_mixing": op3_pivotal_mixing,
    "op4_fourier_ridge": op4_fourier_ridge,
    "op5_token_files": op5_token_files,
    "op6_bloom_language_model": op6_bloom_language_model,
    "op7_perplexity_rules": op7_perplexity_rules,
    "op8_suffix_arrays": op8_suffix_arrays,
    "op9_license_automaton": op9_license_automaton,
    "op10_sampled_splitters": op10_sampled_splitters,
    "op11_crc_resampling": op11_crc_resampling,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

#: The others draw at random, train, tokenize or parse; tests/llm hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_near_duplicates": NEAR_DUPLICATES, "op8_suffix_arrays": CONTAMINATION, "op11_crc_resampling": RESAMPLING, "op12_jaccard_join": JACCARD_JOIN}
