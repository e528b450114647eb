"""Queries of this package and their SQL, for the driver's entry."""
from __future__ import annotations

from . import alignment, audio, bpe, chat, neardup, oracles, packing, pii, quality, quality_model, secrets, token_counts, toxicity, trie

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        bpe.op2_byte_bpe,
        pii.op3_personal_data,
        secrets.op4_secret_scan,
        chat.op5_chat_formatting,
        packing.op6_packing,
        audio.op7_media_columns,
        token_counts.op8_token_counts,
        quality.op9_quality_rules,
        neardup.op10_near_duplicates,
        trie.op11_prefix_trie,
        quality_model.op12_quality_classifier,
        alignment.op13_alignment,
    )
}
ORACLES: dict[str, str] = oracles.ORACLES
