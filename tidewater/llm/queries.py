"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewater.llm.fingerprints import op4_fingerprints
from tidewater.llm.license_scan import op1_license_scan
from tidewater.llm.line_dedup import op6_line_dedup
from tidewater.llm.mixing import OP2_SQL, op2_mixing
from tidewater.llm.packing import op9_packing
from tidewater.llm.quality_classifier import op3_quality_classifier
from tidewater.llm.quality_rules import OP7_SQL, op7_quality_rules
from tidewater.llm.simhash import op5_simhash
from tidewater.llm.suffix_dedup import op10_suffix_dedup
from tidewater.llm.warc import op8_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL = {
    "op2_mixing": OP2_SQL,
    "op7_quality_rules": OP7_SQL,
}
