"""The queries of this package, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from tidemark.llm.audit import OP13_SQL, op13_audit
from tidemark.llm.bpe import op6_bpe
from tidemark.llm.chat import op9_chat
from tidemark.llm.html import op4_html
from tidemark.llm.langid import op2_langid
from tidemark.llm.linededup import op5_linededup
from tidemark.llm.mtree import op3_mtree
from tidemark.llm.ngramjoin import op7_ngramjoin
from tidemark.llm.packing import op1_packing
from tidemark.llm.pii import op8_pii
from tidemark.llm.pulearn import op11_pulearn
from tidemark.llm.quality import op10_quality
from tidemark.llm.runs import op12_runs

QUERIES = {"op1_packing": op1_packing, "op2_langid": op2_langid, "op3_mtree": op3_mtree, "op4_html": op4_html, "op5_linededup": op5_linededup, "op6_bpe": op6_bpe, "op7_ngramjoin": op7_ngramjoin, "op8_pii": op8_pii, "op9_chat": op9_chat, "op10_quality": op10_quality, "op11_pulearn": op11_pulearn, "op12_runs": op12_runs, "op13_audit": op13_audit}

ORACLE_SQL: dict[str, str] = {"op13_audit": OP13_SQL}
