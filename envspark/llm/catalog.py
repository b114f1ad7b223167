"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from envspark.llm import bpe, lcp, lexical, licenses, packing, quality, secrets, simhash, tokencounts, topk, toxicity, trie, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_licenses": licenses.op2_licenses,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_secrets": secrets.op5_secrets,
    "op6_topk": topk.op6_topk,
    "op7_simhash": simhash.op7_simhash,
    "op8_lcp": lcp.op8_lcp,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_lexical": lexical.op11_lexical,
    "op12_trie": trie.op12_trie,
    "op13_tokencounts": tokencounts.op13_tokencounts,
}

ORACLE = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_licenses": licenses.ORACLE_SQL,
    "op6_topk": topk.ORACLE_SQL,
    "op11_lexical": lexical.ORACLE_SQL,
    "op12_trie": trie.ORACLE_SQL,
}
