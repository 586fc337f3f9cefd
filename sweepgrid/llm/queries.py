"""The registered queries of this subpackage, with SQL where SQL can state them."""

from __future__ import annotations

from .common import ship_package
from .ctxmix import op3_context_mixing
from .decontam import ORACLE_OP9, op9_decontaminate
from .fertility import op5_tokeniser_fertility
from .fim import ORACLE_OP12, op12_lookaround_fim
from .metricjoin import ORACLE_OP11, op11_jaccard_join
from .mixing import op7_hypergeometric_mix
from .probminhash import op4_near_duplicates
from .shards import op8_feistel_shards
from .sql import ORACLE_OP2, ORACLE_OP4, ORACLE_OP6, ORACLE_OP10
from .substr_tree import op2_substring_dedup
from .suffixsort import op10_suffix_array_dedup
from .tokens import op1_token_counts
from .warc import op6_arc_to_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_substring_dedup,
        op3_context_mixing,
        op4_near_duplicates,
        op5_tokeniser_fertility,
        op6_arc_to_warc,
        op7_hypergeometric_mix,
        op8_feistel_shards,
        op9_decontaminate,
        op10_suffix_array_dedup,
        op11_jaccard_join,
        op12_lookaround_fim,
    )
}
ORACLE: dict[str, str] = {
    "op2_substring_dedup": ORACLE_OP2,
    "op4_near_duplicates": ORACLE_OP4,
    "op6_arc_to_warc": ORACLE_OP6,
    "op9_decontaminate": ORACLE_OP9,
    "op10_suffix_array_dedup": ORACLE_OP10,
    "op11_jaccard_join": ORACLE_OP11,
    "op12_lookaround_fim": ORACLE_OP12,
}

ship_package()
