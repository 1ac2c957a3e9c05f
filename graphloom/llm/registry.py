"""The training-data queries, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .exact_dedup import OP5_SQL, op5_exact_dedup
from .language_id import op7_language_id
from .license_scan import op6_license_scan
from .mixing import op8_mixing
from .packing import op2_packing
from .quality_classifier import op1_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .secret_scan import op9_secret_scan
from .simhash import op10_simhash
from .warc import OP4_SQL, op4_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_packing, op3_quality_rules, op4_warc, op5_exact_dedup,
        op6_license_scan, op7_language_id, op8_mixing, op9_secret_scan, op10_simhash,
    )
}
ORACLE_SQL = {"op3_quality_rules": OP3_SQL, "op4_warc": OP4_SQL, "op5_exact_dedup": OP5_SQL}
