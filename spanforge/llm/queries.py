"""The queries of this subpackage by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from spanforge.llm.ann import OP7_SQL, op7_nearest
from spanforge.llm.binary import op9_token_files
from spanforge.llm.bpe import op1_byte_bpe
from spanforge.llm.chat import OP8_SQL, op8_chat_format
from spanforge.llm.decontam import op2_decontaminate
from spanforge.llm.divergence import OP13_SQL, op13_source_divergence
from spanforge.llm.langid import op6_language
from spanforge.llm.periodic import op12_periodic_runs
from spanforge.llm.quality import op11_quality
from spanforge.llm.secrets import op3_secret_scan
from spanforge.llm.simhash import op5_simhash
from spanforge.llm.substrings import op4_substring_dedup
from spanforge.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_nearest": op7_nearest,
    "op8_chat_format": op8_chat_format,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
    "op11_quality": op11_quality,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}

#: The others have no SQL (tokenizer merges, alignment, suffixes, models) or none that ends on whole tables; tests hold them
#: against brute force, exact round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op7_nearest": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op13_source_divergence": OP13_SQL,
}
