"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from .bpe import op1_bpe
from .chat_format import OP2_SQL, op2_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .jaccard_join import OP4_LINKS_SQL, OP4_SQL, op4_jaccard_join, op4_jaccard_links
from .language_id import op8_language_id
from .sharding import op7_sharding
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_counts import op6_token_counts
from .token_output import op3_token_output


def queries() -> dict:
    """One query per operator; each takes (spark, sf_dir) and returns a DataFrame over the whole table."""
    return {
        "op1_bpe": op1_bpe,
        "op2_chat_format": op2_chat_format,
        "op3_token_output": op3_token_output,
        "op4_jaccard_join": op4_jaccard_join,
        "op4_jaccard_links": op4_jaccard_links,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_sharding": op7_sharding,
        "op8_language_id": op8_language_id,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_decontaminate": op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the operator."""
    return {
        "op2_chat_format": OP2_SQL,
        "op4_jaccard_join": OP4_SQL,
        "op4_jaccard_links": OP4_LINKS_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op9_exact_dedup": OP9_SQL,
        "op10_decontaminate": OP10_SQL,
    }
