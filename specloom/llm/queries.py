"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import collocations, html_text, media, mixing, negatives, packing, pieces, quality, secrets, simhash, toxicity, warc, winnow

QUERIES = {
    "op1_sentencepiece": pieces.op1,
    "op2_warc": warc.op2,
    "op3_mixing": mixing.op3,
    "op4_fingerprints": winnow.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_quality": quality.op6,
    "op7_toxicity": toxicity.op7,
    "op8_secrets": secrets.op8,
    "op9_html_text": html_text.op9,
    "op10_media": media.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_collocations": collocations.op12,
    "op13_packing": packing.op13,
}

ORACLES: dict[str, str] = {"op2_warc": warc.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_collocations": collocations.ORACLE}
