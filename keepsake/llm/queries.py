"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from . import clusters, divergence, hnsw, jaccard, mixing, packing, pii, quality, secrets, sstable, tokencount, toxicity, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_shards": sstable.op3_token_shards,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_embedding_near_dedup": hnsw.op7_embedding_near_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_centroid_clusters": clusters.op11_centroid_clusters,
    "op12_url_filter": urls.op12_url_filter,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES: dict[str, str] = {"op5_mix_sources": mixing.OP5_SQL, "op11_centroid_clusters": clusters.OP11_SQL, "op13_source_divergence": divergence.OP13_SQL}
