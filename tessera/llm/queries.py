"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm.bpe import op3_bpe
from tessera.llm.decontamination import op2_decontamination
from tessera.llm.media import op7_media
from tessera.llm.near_dedup import op10_near_dedup
from tessera.llm.packing import op11_packing
from tessera.llm.pii import op9_pii
from tessera.llm.sharding import op5_sharding
from tessera.llm.suffix_dedup import op1_suffix_dedup
from tessera.llm.token_counts import op6_token_counts
from tessera.llm.token_files import op4_token_files
from tessera.llm.toxicity import op8_toxicity
from tessera.llm.vector_codes import op13_vector_codes
from tessera.llm.whitening import op12_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_bpe": op3_bpe,
    "op4_token_files": op4_token_files,
    "op5_sharding": op5_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_media": op7_media,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_near_dedup": op10_near_dedup,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}

#: None of these can be written in DuckDB's SQL (it has no crc32, tokenizer,
#: PNG or signature functions); tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {}
