"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

from . import embeddings, huffman, licences, manifest, mixing, packing, pii, quality, similarity_join, substrings, token_counts, toxicity, whitening

QUERIES = {
    "op1_ngram_jaccard_join": similarity_join.op1_ngram_jaccard_join,
    "op2_pack_documents": packing.op2_pack_documents,
    "op3_suffix_dedup": substrings.op3_suffix_dedup,
    "op4_licence_scan": licences.op4_licence_scan,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_files": huffman.op7_token_files,
    "op8_embedding_neardup": embeddings.op8_embedding_neardup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_pii": pii.op11_pii,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}
ORACLES = {
    "op9_quality_rules": quality.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
