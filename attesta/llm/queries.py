"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from attesta.llm import graph, jaccard, langid, mixing, packing, pii, quality, secrets, topk, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_pii": pii.op2_pii,
    "op3_topk": topk.op3_topk,
    "op4_neighbours": graph.op4_neighbours,
    "op5_secrets": secrets.op5_secrets,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES = {
    "op3_topk": topk.SQL,
    "op8_jaccard": jaccard.SQL,
    "op9_warc": warc.SQL,
    "op10_mixing": mixing.SQL,
}
