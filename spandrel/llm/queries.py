"""The numbered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from spandrel.llm import chat, contentsort, decontamination, hardnegatives, interaction, topk
from spandrel.llm.brown import op1_brown_class_lm
from spandrel.llm.chat import op5_grammar_round_trip
from spandrel.llm.contentsort import op12_content_sort_dedup
from spandrel.llm.decontamination import op8_decontamination
from spandrel.llm.extraction import op10_text_density
from spandrel.llm.hardnegatives import op11_ball_tree_negatives
from spandrel.llm.interaction import op13_filter_interactions
from spandrel.llm.langid import op2_hierarchical_langid
from spandrel.llm.neardup import op6_setsketch_neardup
from spandrel.llm.packing import op7_harmonic_packing
from spandrel.llm.pii import op9_weak_supervision_pii
from spandrel.llm.topk import op3_pivot_topk
from spandrel.llm.toxicity import op4_weak_supervision_toxicity

QUERIES = {
    "op1_brown_class_lm": op1_brown_class_lm,
    "op2_hierarchical_langid": op2_hierarchical_langid,
    "op3_pivot_topk": op3_pivot_topk,
    "op4_weak_supervision_toxicity": op4_weak_supervision_toxicity,
    "op5_grammar_round_trip": op5_grammar_round_trip,
    "op6_setsketch_neardup": op6_setsketch_neardup,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_decontamination": op8_decontamination,
    "op9_weak_supervision_pii": op9_weak_supervision_pii,
    "op10_text_density": op10_text_density,
    "op11_ball_tree_negatives": op11_ball_tree_negatives,
    "op12_content_sort_dedup": op12_content_sort_dedup,
    "op13_filter_interactions": op13_filter_interactions,
}

ORACLE_SQL = {
    "op3_pivot_topk": topk.ORACLE_SQL,
    "op5_grammar_round_trip": chat.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
    "op11_ball_tree_negatives": hardnegatives.ORACLE_SQL,
    "op12_content_sort_dedup": contentsort.ORACLE_SQL,
    "op13_filter_interactions": interaction.ORACLE_SQL,
}
