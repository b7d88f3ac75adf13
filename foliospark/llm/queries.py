"""The registered queries of the training-data operators."""

from foliospark.llm.op1_mixing import op1_mixing
from foliospark.llm.op10_privacy import op10_privacy
from foliospark.llm.op11_repair import SQL as op11_sql
from foliospark.llm.op11_repair import op11_repair
from foliospark.llm.op12_lexicon import op12_lexicon
from foliospark.llm.op13_runs import op13_runs
from foliospark.llm.op2_tokens import op2_token_counts
from foliospark.llm.op3_repeats import SQL as op3_sql
from foliospark.llm.op3_repeats import op3_repeats
from foliospark.llm.op4_quality import op4_quality_scores
from foliospark.llm.op5_language import op5_language
from foliospark.llm.op6_preference import SQL as op6_sql
from foliospark.llm.op6_preference import op6_preference
from foliospark.llm.op7_jaccard import SQL as op7_sql
from foliospark.llm.op7_jaccard import op7_jaccard_join
from foliospark.llm.op8_decontamination import SQL as op8_sql
from foliospark.llm.op8_decontamination import op8_decontamination
from foliospark.llm.op9_rules import op9_quality_rules

QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_repeats, op4_quality_scores, op5_language, op6_preference, op7_jaccard_join, op8_decontamination, op9_quality_rules, op10_privacy, op11_repair, op12_lexicon, op13_runs)}
SQL: dict[str, str] = {"op3_repeats": op3_sql, "op6_preference": op6_sql, "op7_jaccard_join": op7_sql, "op8_decontamination": op8_sql, "op11_repair": op11_sql}
