"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP8_SQL, op8_role_machine_format
from .jaccard import op1_chosen_path_join
from .licenses import OP7_SQL, op7_template_automata
from .media import op3_interleaved_sequences
from .mixing import op10_multinomial_block_mix
from .packing import op9_exact_complement_packing
from .pii import op2_feistel_pseudonyms
from .quality import OP6_SQL, op6_distribution_divergence
from .substrings import op5_run_length_index
from .toxicity import op4_counterfactual_classifier

QUERIES = {f.__name__: f for f in (op1_chosen_path_join, op2_feistel_pseudonyms, op3_interleaved_sequences, op4_counterfactual_classifier, op5_run_length_index, op6_distribution_divergence, op7_template_automata, op8_role_machine_format, op9_exact_complement_packing, op10_multinomial_block_mix)}
ORACLES: dict[str, str] = {"op6_distribution_divergence": OP6_SQL, "op7_template_automata": OP7_SQL, "op8_role_machine_format": OP8_SQL}
