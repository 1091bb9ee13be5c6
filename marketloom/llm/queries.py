"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from marketloom.llm import oracles
from marketloom.llm.chat import OP7_SQL, op7_chat_formatting
from marketloom.llm.decontaminate import op2_benchmark_decontamination
from marketloom.llm.divergence import op11_source_divergence
from marketloom.llm.jaccard import op5_ngram_jaccard_join
from marketloom.llm.langid import op3_language_id
from marketloom.llm.mixing import op8_mixing_sources
from marketloom.llm.quality import op6_quality_classifier
from marketloom.llm.resampling import op13_importance_resampling
from marketloom.llm.search import op9_exact_top_k
from marketloom.llm.secrets import op1_secret_scan
from marketloom.llm.sharding import op4_hypergeometric_sharding
from marketloom.llm.tokenfile import op12_token_files
from marketloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op4_hypergeometric_sharding": op4_hypergeometric_sharding,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_language_id": op3_language_id,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_files": op12_token_files,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op1_secret_scan": oracles.OP1,
    "op5_ngram_jaccard_join": oracles.OP5,
    "op6_quality_classifier": oracles.OP6,
    "op7_chat_formatting": OP7_SQL,
    "op8_mixing_sources": oracles.OP8,
    "op9_exact_top_k": oracles.OP9,
    "op11_source_divergence": oracles.OP11,
    "op13_importance_resampling": oracles.OP13,
}
