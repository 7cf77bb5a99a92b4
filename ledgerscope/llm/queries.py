"""The registered queries of this package and their DuckDB statements."""
from ledgerscope.llm.op10_decontaminate import op10_decontaminate
from ledgerscope.llm.op12_secrets import op12_secrets
from ledgerscope.llm.op1_pfor import op1_pfor
from ledgerscope.llm import op2_url_filter as op2, op9_topk as op9, op11_phrases as op11, op13_merkle as op13
from ledgerscope.llm.op3_pii import op3_pii
from ledgerscope.llm.op4_simhash import op4_simhash
from ledgerscope.llm.op5_html import op5_html
from ledgerscope.llm.op6_packing import op6_packing
from ledgerscope.llm.op7_toxicity import op7_toxicity
from ledgerscope.llm.op8_quality import op8_quality

QUERIES = {f.__name__: f for f in (op1_pfor, op2.op2_url_filter, op3_pii, op4_simhash, op5_html, op6_packing, op7_toxicity, op8_quality, op9.op9_topk,
                                op10_decontaminate, op11.op11_phrases, op12_secrets, op13.op13_merkle)}
SQL = {"op2_url_filter": op2.SQL, "op9_topk": op9.SQL, "op11_phrases": op11.SQL, "op13_merkle": op13.SQL}
