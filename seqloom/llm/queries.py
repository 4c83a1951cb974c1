"""The queries of this package, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from seqloom.llm import bm25, prefix_trie, winnowing
from seqloom.llm.ann import op5_learned_partitions
from seqloom.llm.html_text import op10_html_ratio
from seqloom.llm.lm import op7_elias_fano_ngrams
from seqloom.llm.mixing import op9_mix_blocks
from seqloom.llm.packing import op6_pack_differencing
from seqloom.llm.periodic_runs import op13_periodic_runs
from seqloom.llm.quality import op8_quality_neighbours
from seqloom.llm.sharding import op4_shard_propagation
from seqloom.llm.simhash import op2_simhash_segments
from seqloom.llm.token_store import op1_token_huffman
from seqloom.session import table


def _over(name, operator):
    """A query that applies an operator to one whole table."""
    return lambda spark, sf_dir: operator(spark, table(spark, sf_dir, name))


QUERIES = {
    "op1_token_huffman": _over("documents", op1_token_huffman),
    "op2_simhash_segments": _over("documents", op2_simhash_segments),
    "op3_bm25_block_max": lambda spark, sf_dir: bm25.op3_bm25_block_max(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op4_shard_propagation": _over("documents", op4_shard_propagation),
    "op5_learned_partitions": _over("embeddings", op5_learned_partitions),
    "op6_pack_differencing": _over("documents", op6_pack_differencing),
    "op7_elias_fano_ngrams": _over("documents", op7_elias_fano_ngrams),
    "op8_quality_neighbours": lambda spark, sf_dir: op8_quality_neighbours(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_mix_blocks": _over("documents", op9_mix_blocks),
    "op10_html_ratio": _over("pages", op10_html_ratio),
    "op11_prefix_trie": _over("conversations", prefix_trie.op11_prefix_trie),
    "op12_winnowed_passages": lambda spark, sf_dir: winnowing.op12_winnowed_passages(
        spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_periodic_runs": _over("documents", op13_periodic_runs),
}
SQL = {"op3_bm25_block_max": bm25.SQL, "op11_prefix_trie": prefix_trie.SQL,
       "op12_winnowed_passages": winnowing.SQL}
