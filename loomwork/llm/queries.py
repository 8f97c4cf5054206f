"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op2_decontaminate
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import op11_divergence
from .epsilon_join import ORACLE as EPSILON_SQL
from .epsilon_join import op12_epsilon_grid
from .fingerprints import op3_order_minhash
from .html_text import op5_html_extract
from .language_id import op6_langid
from .language_model import op10_kneser_ney
from .lexical import ORACLE as LEXICAL_SQL
from .lexical import op13_fp_tree
from .mixing import ORACLE as MIXING_SQL
from .mixing import op7_mix
from .neardup import op8_probminhash
from .sharding import op9_shard
from .substrings import ORACLE as SUBSTRING_SQL
from .substrings import op4_substring_dedup
from .toxicity import op1_toxicity


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontaminate": op2_decontaminate,
        "op3_order_minhash": op3_order_minhash,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_html_extract": op5_html_extract,
        "op6_langid": op6_langid,
        "op7_mix": op7_mix,
        "op8_probminhash": op8_probminhash,
        "op9_shard": op9_shard,
        "op10_kneser_ney": op10_kneser_ney,
        "op11_divergence": op11_divergence,
        "op12_epsilon_grid": op12_epsilon_grid,
        "op13_fp_tree": op13_fp_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": SUBSTRING_SQL, "op7_mix": MIXING_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_epsilon_grid": EPSILON_SQL, "op13_fp_tree": LEXICAL_SQL}
