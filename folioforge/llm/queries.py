"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from folioforge.llm.decontaminate import op10_decontamination
from folioforge.llm.html_text import op1_html_text
from folioforge.llm.language_model import op7_language_model
from folioforge.llm.line_dedup import op6_line_dedup
from folioforge.llm.near_duplicates import op2_near_duplicates
from folioforge.llm.oracles import OP2_SQL, OP6_SQL, OP10_SQL
from folioforge.llm.packing import op4_packing
from folioforge.llm.personal_data import op8_personal_data
from folioforge.llm.quality_classifier import op5_quality_classifier
from folioforge.llm.quality_rules import op3_quality_rules
from folioforge.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_model": op7_language_model,
    "op8_personal_data": op8_personal_data,
    "op9_toxicity": op9_toxicity,
    "op10_decontamination": op10_decontamination,
}
SQL = {"op2_near_duplicates": OP2_SQL, "op6_line_dedup": OP6_SQL, "op10_decontamination": OP10_SQL}
