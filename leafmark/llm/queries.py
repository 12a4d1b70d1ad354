"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from leafmark.llm import bloom_lm, compression, fingerprints, hash_ring, lines, media_ogg, merkle, mixing, perplexity, pieces, spelling, toxicity, weighted_minhash

QUERIES = {
    "op1_perplexity": perplexity.op1_perplexity,
    "op2_weighted_minhash": weighted_minhash.op2_weighted_minhash,
    "op3_compression": compression.op3_compression,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_ogg": media_ogg.op5_ogg,
    "op6_mixing": mixing.op6_mixing,
    "op7_bloom_lm": bloom_lm.op7_bloom_lm,
    "op8_lines": lines.op8_lines,
    "op9_ring": hash_ring.op9_ring,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling": spelling.op11_spelling,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {"op6_mixing": mixing.OP6_SQL, "op11_spelling": spelling.OP11_SQL, "op13_merkle": merkle.OP13_SQL}
