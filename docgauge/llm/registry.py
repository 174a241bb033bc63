"""Queries and oracle SQL of the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docgauge.llm import centroid_clusters, embedding_dedup, jaccard_join, prefix_trie
from docgauge.llm.centroid_clusters import op11_centroid_clusters
from docgauge.llm.decontamination import op1_decontamination
from docgauge.llm.embedding_dedup import op10_embedding_dedup
from docgauge.llm.html_text import op2_html_extraction
from docgauge.llm.jaccard_join import op5_jaccard_join
from docgauge.llm.language_id import op12_language_id
from docgauge.llm.packing import op7_packing
from docgauge.llm.pii import op8_pii
from docgauge.llm.prefix_trie import op13_prefix_trie
from docgauge.llm.quality import op6_quality_classifier
from docgauge.llm.secret_scan import op4_secret_scan
from docgauge.llm.sharding import op9_hilbert_sharding
from docgauge.llm.toxicity import op3_toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_hilbert_sharding": op9_hilbert_sharding,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The others need a trained model, a tokenizer, an alignment, a curve over quantiles or a checksum that DuckDB lacks;
#: tests/llm holds them against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op11_centroid_clusters": centroid_clusters.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
