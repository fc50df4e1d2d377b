"""The subpackage's queries and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from .bpe import op1_bpe
from .langid import op2_language
from .line_dedup import op3_line_dedup
from .lm import op7_lm
from .near_docs import op8_near_docs
from .near_vectors import op6_near_vectors
from .packing import op4_packing
from .quality import op5_quality
from .warc import OP9_SQL, op9_warc
from .exact_dedup import OP10_SQL, op10_exact_dedup

QUERIES = (op1_bpe, op2_language, op3_line_dedup, op4_packing, op5_quality, op6_near_vectors, op7_lm, op8_near_docs, op9_warc, op10_exact_dedup)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9_SQL, "op10_exact_dedup": OP10_SQL}
