"""Queries of the corpus operators and, where SQL can express one, its oracle."""

from __future__ import annotations

from . import bpe, masked, media, mixing, neardup, nra, pii, quality, spans, toxicity

QUERIES = {
    "op1_cotrain_quality": quality.query,
    "op2_probminhash": neardup.query,
    "op3_nra_topk": nra.query,
    "op4_sentence_spans": spans.query,
    "op5_bpe": bpe.query,
    "op6_masked_lm": masked.query,
    "op7_mix": mixing.query,
    "op8_pii": pii.query,
    "op9_media": media.query,
    "op10_toxicity": toxicity.query,
}
ORACLES: dict[str, str] = {"op3_nra_topk": nra.ORACLE}
