"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from wardspan.llm import bpe, collocations, exact, langid, licenses, matroska, minhash, packing, pii, secrets, sharding, suffixes, whitening

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_matroska": matroska.op2_matroska,
    "op3_pii": pii.op3_pii,
    "op4_licenses": licenses.op4_licenses,
    "op5_extendible_hashing": sharding.op5_extendible_hashing,
    "op6_minhash": minhash.op6_minhash,
    "op7_language": langid.op7_language,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op6_minhash": minhash.OP6_SQL,
    "op5_extendible_hashing": sharding.OP5_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
}
