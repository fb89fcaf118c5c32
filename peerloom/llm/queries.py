"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from .chroma import op5_query
from .decontam import op8_query
from .langid import op7_query
from .lines import OP10_SQL, op10_query
from .lm_scoring import op1_query
from .mixture import op2_query
from .ordinal import op9_query
from .quotes import op6_query
from .sharding import OP3_SQL, op3_query
from .simhash import op4_query

QUERIES = {
    "op1_lm_scoring": op1_query,
    "op2_source_mixing": op2_query,
    "op3_sharding": op3_query,
    "op4_simhash": op4_query,
    "op5_chroma": op5_query,
    "op6_quote_threads": op6_query,
    "op7_language_id": op7_query,
    "op8_decontamination": op8_query,
    "op9_ordinal_quality": op9_query,
    "op10_line_dedup": op10_query,
}

SQL = {"op3_sharding": OP3_SQL, "op10_line_dedup": OP10_SQL}
