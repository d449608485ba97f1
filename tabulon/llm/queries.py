"""The corpus queries that __spark_entry__ registers, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .byterepeats import op3_byte_repeats
from .embeddings import op7_embeddings
from .lines import op6_lines
from .media import op10_media
from .mix import ORACLE as MIX_SQL
from .mix import op1_mix
from .quality import op4_quality
from .repair import op11_repair
from .runs import op12_runs
from .simhash import op8_simhash
from .tokenfiles import op13_tokens
from .toxicity import op9_toxicity
from .wordrepeats import op2_word_repeats

QUERIES = {"op1_mix": op1_mix, "op2_word_repeats": op2_word_repeats, "op3_byte_repeats": op3_byte_repeats, "op4_quality": op4_quality, "op5_bpe": op5_bpe, "op6_lines": op6_lines, "op7_embeddings": op7_embeddings, "op8_simhash": op8_simhash, "op9_toxicity": op9_toxicity, "op10_media": op10_media, "op11_repair": op11_repair, "op12_runs": op12_runs, "op13_tokens": op13_tokens}
ORACLE_SQLS = {"op1_mix": MIX_SQL}
