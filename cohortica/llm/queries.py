"""Registered queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

import corpus_pipeline
from cohortica.llm.chat_format import OP11_SQL, op11_typed_chat_format
from cohortica.llm.divergence import OP12_SQL, op12_source_divergence
from cohortica.llm.fingerprints import OP3_SQL, op3_merkle_fingerprints
from cohortica.llm.language import op10_hyperdimensional_language
from cohortica.llm.mixing import OP9_SQL, op9_hierarchical_mixture
from cohortica.llm.ngram_join import op4_ngram_jaccard_join
from cohortica.llm.packing import op2_best_fit_packing
from cohortica.llm.pii import op1_boosted_pii
from cohortica.llm.pitman_yor import op8_pitman_yor_scores
from cohortica.llm.quality import OP5_SQL, op5_line_frequency_quality
from cohortica.llm.sharding import op6_sampled_splitter_shards
from cohortica.llm.toxicity import op7_toxic_segments
from cohortica.llm.whitening import op13_jacobi_davidson_whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op8_pitman_yor_scores": op8_pitman_yor_scores,
    "op1_boosted_pii": op1_boosted_pii,
    "op7_toxic_segments": op7_toxic_segments,
    "op10_hyperdimensional_language": op10_hyperdimensional_language,
    "op9_hierarchical_mixture": op9_hierarchical_mixture,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op5_line_frequency_quality": op5_line_frequency_quality,
    "op6_sampled_splitter_shards": op6_sampled_splitter_shards,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op11_typed_chat_format": op11_typed_chat_format,
    "op12_source_divergence": op12_source_divergence,
    "op13_jacobi_davidson_whitening": op13_jacobi_davidson_whitening,
}
ORACLES: dict[str, str] = {
    "op9_hierarchical_mixture": OP9_SQL,
    "op3_merkle_fingerprints": OP3_SQL,
    "op5_line_frequency_quality": OP5_SQL,
    "op11_typed_chat_format": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
