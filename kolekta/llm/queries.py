"""The registered queries of the package and their SQL."""

from __future__ import annotations

from kolekta.llm import (
    decontaminate,
    langmodel,
    lengths,
    licences,
    minhash,
    neighbours,
    phrases,
    pieces,
    prefixtrie,
    quality,
    sequences,
    simhash,
    toxicity,
)

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_licences": licences.query,
    "op3_language_model": langmodel.query,
    "op4_neighbours": neighbours.query,
    "op5_sequences": sequences.query,
    "op6_quality": quality.query,
    "op7_decontamination": decontaminate.query,
    "op8_simhash": simhash.query,
    "op9_lengths": lengths.query,
    "op10_toxicity": toxicity.query,
    "op11_minhash": minhash.query,
    "op12_phrases": phrases.query,
    "op13_prefix_trie": prefixtrie.query,
}

ORACLE: dict[str, str] = {
    "op11_minhash": minhash.SQL,
    "op12_phrases": phrases.SQL,
    "op13_prefix_trie": prefixtrie.SQL,
}
