"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe import op2_bpe
from .chat_format import op3_chat_format
from .license_scan import op5_license_scan
from .lz_fingerprint import op10_lz_fingerprint
from .minhash_dedup import op4_minhash_dedup
from .mixing import op8_mixing
from .ngram_join import op13_ngram_join
from .oracles import oracle_sql
from .quality import op7_quality
from .resampling import op12_resampling
from .substring_dedup import op6_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .vector_codes import op11_vector_codes
from .vector_search import op1_vector_search

QUERIES = (op1_vector_search, op2_bpe, op3_chat_format, op4_minhash_dedup, op5_license_scan, op6_substring_dedup, op7_quality, op8_mixing, op9_suffix_dedup, op10_lz_fingerprint, op11_vector_codes, op12_resampling, op13_ngram_join)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


__all__ = ["oracle_sql", "queries"]
