"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .mixing import op9_mix_sources
from .perplexity import op4_kneser_ney
from .pieces import op7_sentencepiece
from .preferences import OP3_SQL, op3_preferences
from .ranking import OP13_SQL, op13_lexical_search
from .repair import OP12_SQL, op12_conversation_repair
from .repetition import op8_repetition_rules
from .secrets import op5_secrets
from .simhash import op10_simhash
from .substring_dedup import op1_substring_dedup
from .token_files import op6_token_files
from .toxicity import op11_toxicity
from .vectors import OP2_SQL, op2_near_vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_near_vectors, op3_preferences, op4_kneser_ney, op5_secrets, op6_token_files, op7_sentencepiece, op8_repetition_rules, op9_mix_sources, op10_simhash, op11_toxicity, op12_conversation_repair, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_vectors": OP2_SQL, "op3_preferences": OP3_SQL, "op12_conversation_repair": OP12_SQL, "op13_lexical_search": OP13_SQL}
