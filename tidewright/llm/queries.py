"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .langid import op2_language_id
from .licenses import op7_license_scan
from .order_minhash import op6_order_minhash
from .packing import op9_best_fit_packing
from .quality import op8_quality_classifier
from .simhash import op5_simhash_near_dedup
from .toxicity import op3_toxicity
from .url_filter import op1_url_filter

QUERIES = {
    "op7_license_scan": op7_license_scan,
    "op1_url_filter": op1_url_filter,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op6_order_minhash": op6_order_minhash,
    "op8_quality_classifier": op8_quality_classifier,
    "op10_byte_bpe": op10_byte_bpe,
    "op2_language_id": op2_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
}

SQL = {
    "op4_exact_dedup": OP4_SQL,
}
