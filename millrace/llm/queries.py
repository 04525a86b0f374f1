"""The queries of this subpackage, by the names under which the entry module registers them."""

from __future__ import annotations

from .count import op7_count
from .decontaminate import op3_decontaminate
from .hamerly import SQL as HAMERLY_SQL
from .hamerly import op12_hamerly
from .imatch import op6_imatch
from .langid import op8_langid
from .lines import PASSAGES_SQL
from .lines import SQL as LINES_SQL
from .lines import op10_lines, op10_passages
from .neardup import op4_neardup
from .negatives import SQL as NEGATIVES_SQL
from .negatives import op11_negatives
from .packing import op1_pack
from .repair import op9_repair
from .substrings import op5_substrings
from .surrogates import op2_surrogates
from .topk import SQL as TOPK_SQL
from .topk import op13_topk

QUERIES = {
    "op1_pack": op1_pack,
    "op2_surrogates": op2_surrogates,
    "op3_decontaminate": op3_decontaminate,
    "op4_neardup": op4_neardup,
    "op5_substrings": op5_substrings,
    "op6_imatch": op6_imatch,
    "op7_count": op7_count,
    "op8_langid": op8_langid,
    "op9_repair": op9_repair,
    "op10_lines": op10_lines,
    "op10_passages": op10_passages,
    "op11_negatives": op11_negatives,
    "op12_hamerly": op12_hamerly,
    "op13_topk": op13_topk,
}
ORACLE: dict[str, str] = {
    "op10_lines": LINES_SQL,
    "op10_passages": PASSAGES_SQL,
    "op11_negatives": NEGATIVES_SQL,
    "op12_hamerly": HAMERLY_SQL,
    "op13_topk": TOPK_SQL,
}
