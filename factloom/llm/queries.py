"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from factloom.llm.collocations import OP11_SQL, op11_collocations
from factloom.llm.decontaminate import op6_decontaminate
from factloom.llm.hash_ring import op4_sharding
from factloom.llm.image_copies import op3_image_copies
from factloom.llm.language_id import op5_language_id
from factloom.llm.license_scan import op8_licenses
from factloom.llm.line_dedup import op10_line_dedup
from factloom.llm.mixing import op9_mixing
from factloom.llm.pii import op7_pii
from factloom.llm.quality_rules import op13_quality_rules
from factloom.llm.secret_scan import op2_secrets
from factloom.llm.simhash import op1_simhash
from factloom.llm.whitening import op12_whitening

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_secrets": op2_secrets,
    "op3_image_copies": op3_image_copies,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_pii": op7_pii,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {"op11_collocations": OP11_SQL}
