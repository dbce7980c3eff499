"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op4_decontaminate
from .fixity import OP8_SQL, op8_fixity
from .language import op6_language
from .lines import op9_line_dedup
from .near import op3_near_dedup
from .packing import op1_packing
from .passages import op5_passages
from .quality import op2_quality
from .simhash import op10_simhash
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_passages": op5_passages,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_fixity": op8_fixity,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {"op8_fixity": OP8_SQL}
