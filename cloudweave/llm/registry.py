"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from cloudweave.llm import bpe, chat, clusters, language, media, packing, prefix_trie, quality, rules, sharding, simhash, toxicity, warc


def queries() -> dict:
    return {"op1_packing": packing.op1_packing, "op2_warc": warc.op2_warc, "op3_quality": quality.op3_quality, "op4_simhash": simhash.op4_simhash, "op5_media": media.op5_media, "op6_toxicity": toxicity.op6_toxicity, "op7_bpe": bpe.op7_bpe, "op8_sharding": sharding.op8_sharding, "op9_rules": rules.op9_rules, "op10_language": language.op10_language, "op11_chat": chat.op11_chat, "op12_exponion": clusters.op12_exponion, "op13_prefix_trie": prefix_trie.op13_prefix_trie, "pipeline": corpus_pipeline.run, "pipeline_near": corpus_pipeline.run_near}


def oracle_sql() -> dict[str, str]:
    return {"op9_rules": rules.OP9_SQL, "op11_chat": chat.OP11_SQL, "op12_exponion": clusters.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
