"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from stepweave.llm.bpe import op9_bpe
from stepweave.llm.decontamination import OP1_SQL, op1_decontamination
from stepweave.llm.jaccard import op10_jaccard
from stepweave.llm.licenses import OP5_SQL, op5_licenses
from stepweave.llm.media import op6_media
from stepweave.llm.passages import op4_passages
from stepweave.llm.personal import op13_personal
from stepweave.llm.phrases import OP12_SQL, op12_phrases
from stepweave.llm.quality import op2_quality
from stepweave.llm.sharding import op8_hilbert
from stepweave.llm.suffixes import op3_suffixes
from stepweave.llm.toxicity import op7_toxicity
from stepweave.llm.turns import op11_turns

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_suffixes": op3_suffixes,
    "op4_passages": op4_passages,
    "op5_licenses": op5_licenses,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_hilbert": op8_hilbert,
    "op9_bpe": op9_bpe,
    "op10_jaccard": op10_jaccard,
    "op11_turns": op11_turns,
    "op12_phrases": op12_phrases,
    "op13_personal": op13_personal,
}

ORACLE: dict[str, str] = {"op1_decontamination": OP1_SQL, "op5_licenses": OP5_SQL, "op12_phrases": OP12_SQL}
