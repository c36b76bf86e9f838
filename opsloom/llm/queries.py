"""Named queries of the corpus operators: name -> (function of session and folder, SQL text or None)."""

from __future__ import annotations

from opsloom.llm.binary_output import op10_token_shards
from opsloom.llm.language import op3_language_id
from opsloom.llm.licenses import OP4_SQL, op4_license_scan
from opsloom.llm.linequality import op12_line_field
from opsloom.llm.maxscore import OP8_SQL, op8_maxscore
from opsloom.llm.mixing import op6_cube_mix
from opsloom.llm.negatives import OP11_SQL, op11_bond_negatives
from opsloom.llm.neighbours import op1_learned_partitions
from opsloom.llm.packing import op5_mixture_packing
from opsloom.llm.simhash import op2_simhash_pivots
from opsloom.llm.suffixes import op7_suffix_dedup
from opsloom.llm.toxicity import op9_toxicity
from opsloom.llm.variants import OP13_SQL, op13_pivotal_variants

QUERIES = {
    "op1_learned_partitions": (op1_learned_partitions, None),
    "op2_simhash_pivots": (op2_simhash_pivots, None),
    "op3_language_id": (op3_language_id, None),
    "op4_license_scan": (op4_license_scan, OP4_SQL),
    "op5_mixture_packing": (op5_mixture_packing, None),
    "op6_cube_mix": (op6_cube_mix, None),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_maxscore": (op8_maxscore, OP8_SQL),
    "op9_toxicity": (op9_toxicity, None),
    "op10_token_shards": (op10_token_shards, None),
    "op11_bond_negatives": (op11_bond_negatives, OP11_SQL),
    "op12_line_field": (op12_line_field, None),
    "op13_pivotal_variants": (op13_pivotal_variants, OP13_SQL),
}
