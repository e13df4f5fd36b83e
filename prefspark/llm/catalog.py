"""The registered queries of the subpackage and the SQL of those that have one."""

from __future__ import annotations

from prefspark.llm import decontam, hardneg, jaccardjoin, licenses, merkle, neardup, quality, secrets, sharding, sqltext, subword, toxicity, urlfilter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sentencepiece": subword.op2_sentencepiece,
    "op3_warc": warc.op3_warc,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_url_filters": urlfilter.op5_url_filters,
    "op6_secrets": secrets.op6_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontam.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_licenses": licenses.op10_licenses,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_merkle": merkle.op12_merkle,
    "op13_jaccard_join": jaccardjoin.op13_jaccard_join,
}
ORACLES = sqltext.ORACLES
