"""The registered queries of this subpackage, and their DuckDB SQL where there is one."""

from __future__ import annotations

from segmill.llm.byte_bpe import op12_bpe_coding
from segmill.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from segmill.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from segmill.llm.language_id import op5_language_id
from segmill.llm.licenses import op10_license_scans
from segmill.llm.merkle import OP11_SQL, op11_merkle_manifest
from segmill.llm.mixing import OP1_SQL, op1_mixing
from segmill.llm.packing import op9_packing
from segmill.llm.quality import OP8_SQL, op8_quality_rules
from segmill.llm.secrets import op3_secret_scans
from segmill.llm.sharding import op2_sharding
from segmill.llm.simhash import op6_simhash_near_dedup
from segmill.llm.substring_dedup import OP4_SQL, op4_substring_dedup

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sharding": op2_sharding,
    "op3_secret_scans": op3_secret_scans,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_license_scans": op10_license_scans,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bpe_coding": op12_bpe_coding,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_mixing": OP1_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
