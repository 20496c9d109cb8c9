"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from geoloom.llm.jaccard import OP5_SQL, op5_jaccard_join
from geoloom.llm.langid import op3_language_id
from geoloom.llm.media import op9_media
from geoloom.llm.mixing import OP1_SQL, op1_mixing
from geoloom.llm.packing import op8_packing
from geoloom.llm.pii import op7_pii
from geoloom.llm.quality import op6_quality
from geoloom.llm.rules import op4_quality_rules
from geoloom.llm.secrets import op10_secrets
from geoloom.llm.tokens import op2_token_counts

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_secrets": op10_secrets,
}
SQL = {"op1_mixing": OP1_SQL, "op5_jaccard_join": OP5_SQL}
