"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .centroids import OP11_SQL, op11_centroids
from .decontaminate import op6_decontaminate
from .divergence import OP12_SQL, op12_divergence
from .fingerprints import op13_fingerprints
from .licences import op7_licences
from .near_dup import OP1_SQL, op1_near_dup
from .quality import op4_quality
from .quote_links import OP5_ORDER_SQL, OP5_SQL, op5_quote_links, op5_reply_order
from .secrets import op8_secrets
from .substring_dedup import OP9_SQL, op9_substring_dedup
from .token_files import op10_token_files
from .top_k import OP2_SQL, op2_top_k

QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_top_k": op2_top_k,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_quote_links": op5_quote_links,
    "op5_reply_order": op5_reply_order,
    "op6_decontaminate": op6_decontaminate,
    "op7_licences": op7_licences,
    "op8_secrets": op8_secrets,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_centroids": op11_centroids,
    "op12_divergence": op12_divergence,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES = {
    "op1_near_dup": OP1_SQL,
    "op2_top_k": OP2_SQL,
    "op5_quote_links": OP5_SQL,
    "op5_reply_order": OP5_ORDER_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_centroids": OP11_SQL,
    "op12_divergence": OP12_SQL,
}
