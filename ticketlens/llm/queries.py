"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from ticketlens.llm.counts import op6_counts
from ticketlens.llm.decontam import op5_decontamination
from ticketlens.llm.lexical import OP11_SQL, op11_lexical
from ticketlens.llm.minhash import op13_minhash
from ticketlens.llm.mixing import op8_mixing
from ticketlens.llm.negatives import OP12_SQL, op12_negatives
from ticketlens.llm.pii import op4_pii
from ticketlens.llm.quality import op3_quality
from ticketlens.llm.repeats import op10_repeats
from ticketlens.llm.rules import OP7_SQL, op7_rules
from ticketlens.llm.sharding import op9_sharding
from ticketlens.llm.simhash import op2_simhash
from ticketlens.llm.tokens import op1_tokens

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_counts": op6_counts,
    "op7_rules": op7_rules,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_repeats": op10_repeats,
    "op11_lexical": op11_lexical,
    "op12_negatives": op12_negatives,
    "op13_minhash": op13_minhash,
}

SQL: dict[str, str] = {"op7_rules": OP7_SQL, "op11_lexical": OP11_SQL, "op12_negatives": OP12_SQL}
