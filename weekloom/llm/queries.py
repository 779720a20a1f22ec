"""The registered queries of this subpackage and their SQL."""
from .decontaminate import DECONTAMINATE_SQL, decontaminate_query
from .interactions import INTERACTION_SQL, interaction_query
from .linedup import LINE_DEDUP_SQL, line_dedup_query
from .neardup import NEAR_DUP_SQL, near_dup_query
from .packing import packing_query
from .pieces import piece_query
from .ppm import lm_query
from .quality import QUALITY_SQL, quality_query
from .repeats import REPEATS_SQL, repeats_query
from .secrets import SECRETS_SQL, secrets_query
from .tokencounts import token_count_query
from .warc import WARC_SQL, warc_query
from .whitening import whitening_query

QUERIES = {
    "op1_warc": warc_query,
    "op2_secrets": secrets_query,
    "op3_substring_dedup": repeats_query,
    "op4_token_counts": token_count_query,
    "op5_decontaminate": decontaminate_query,
    "op6_lm_scores": lm_query,
    "op7_quality": quality_query,
    "op8_packing": packing_query,
    "op9_near_dup": near_dup_query,
    "op10_line_dedup": line_dedup_query,
    "op11_interactions": interaction_query,
    "op12_whitening": whitening_query,
    "op13_pieces": piece_query,
}
ORACLES = {
    "op1_warc": WARC_SQL,
    "op2_secrets": SECRETS_SQL,
    "op3_substring_dedup": REPEATS_SQL,
    "op5_decontaminate": DECONTAMINATE_SQL,
    "op7_quality": QUALITY_SQL,
    "op9_near_dup": NEAR_DUP_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
    "op11_interactions": INTERACTION_SQL,
}
