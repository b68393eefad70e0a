"""Registered queries of this subpackage, and SQL where it can express one."""

from __future__ import annotations

from .alignment import op11_alignment
from .embeddings import op2_embeddings
from .fingerprints import op3_fingerprints
from . import mixing, rules, sql, warc
from .licenses import op8_licenses
from .mixing import op9_mixing
from .neardup import op1_neardup
from .packing import op4_packing
from .quality import op10_quality
from .rules import op13_rules
from .secrets import op6_secrets
from .toxicity import op7_toxicity
from .warc import op5_warc, op5_warc_all
from .whitening import op12_whitening

QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_embeddings": op2_embeddings,
    "op3_fingerprints": op3_fingerprints,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op5_warc_all": op5_warc_all,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_rules": op13_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op1_neardup": sql.NEARDUP,
    "op2_embeddings": sql.EMBEDDINGS,
    "op5_warc": warc.SQL,
    "op8_licenses": sql.LICENSES,
    "op9_mixing": mixing.SQL,
    "op13_rules": rules.SQL,
}
