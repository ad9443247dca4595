"""The queries of this subpackage, and SQL for those which SQL can express."""

from __future__ import annotations

from timberline.llm.chat import OP6_SQL, op6_chat
from timberline.llm.embeddings import OP10_SQL, op10_embeddings
from timberline.llm.langid import op4_langid
from timberline.llm.licenses import op5_licenses
from timberline.llm.mixing import OP1_SQL, op1_mix
from timberline.llm.packing import op9_packing
from timberline.llm.pii import op3_pii
from timberline.llm.quality import op2_quality
from timberline.llm.simhash import op7_simhash
from timberline.llm.sketch import op8_fingerprint

QUERIES = {
    "op1_mix": op1_mix,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_langid": op4_langid,
    "op5_licenses": op5_licenses,
    "op6_chat": op6_chat,
    "op7_simhash": op7_simhash,
    "op8_fingerprint": op8_fingerprint,
    "op9_packing": op9_packing,
    "op10_embeddings": op10_embeddings,
}
SQL = {"op1_mix": OP1_SQL, "op6_chat": OP6_SQL, "op10_embeddings": OP10_SQL}
