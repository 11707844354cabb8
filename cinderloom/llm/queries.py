"""The queries of this subpackage, by name, and their SQL for DuckDB."""

from __future__ import annotations

from .fingerprints import op8_fingerprints
from .html_extraction import op3_html_extraction
from .line_templates import op6_line_templates
from .near_duplicates import op2_near_duplicates
from .packing import op5_packing
from .personal_data import op10_personal_data
from .quality_classifier import op9_quality_classifier
from .quality_rules import op4_quality_rules
from .sentencepieces import op1_sentencepieces
from .token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (op1_sentencepieces, op2_near_duplicates, op3_html_extraction, op4_quality_rules, op5_packing, op6_line_templates, op7_token_counts, op8_fingerprints, op9_quality_classifier, op10_personal_data)}
ORACLE: dict[str, str] = {}
