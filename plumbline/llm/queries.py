"""The registered queries of the numbered operators (two of operator 1), and their SQL where SQL can state them."""

from __future__ import annotations

from plumbline.llm.bitsliced import OP5_SQL, op5_bitsliced
from plumbline.llm.bpe import op10_bpe
from plumbline.llm.conversationrepair import OP12_SQL, op12_conversations
from plumbline.llm.decontamination import OP13_SQL, op13_decontamination
from plumbline.llm.filteraudit import OP11_SQL, op11_filteraudit
from plumbline.llm.licenses import op6_licenses, op6_sql
from plumbline.llm.linededup import OP8_SQL, op8_linededup
from plumbline.llm.packing import op9_packing
from plumbline.llm.sharding import OP4_SQL, op4_sharding
from plumbline.llm.simhash import op3_simhash
from plumbline.llm.spotsigs import op1_spotsigs, spotsigs_links
from plumbline.llm.textdensity import op2_textdensity
from plumbline.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_spotsigs": op1_spotsigs,
    "op2_textdensity": op2_textdensity,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_bitsliced": op5_bitsliced,
    "op6_licenses": op6_licenses,
    "op7_toxicity": op7_toxicity,
    "op8_linededup": op8_linededup,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_filteraudit": op11_filteraudit,
    "op12_conversations": op12_conversations,
    "op13_decontamination": op13_decontamination,
    "spotsigs_links": spotsigs_links,
}
ORACLE_SQL = {"op4_sharding": OP4_SQL, "op5_bitsliced": OP5_SQL, "op6_licenses": op6_sql(), "op8_linededup": OP8_SQL, "op11_filteraudit": OP11_SQL, "op12_conversations": OP12_SQL, "op13_decontamination": OP13_SQL}
