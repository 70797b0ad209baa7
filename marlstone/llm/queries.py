"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from . import branches, periodic, repeats, topk, warc
from .fingerprint import op3_fingerprints
from .mixing import op9_mixing
from .neardup import op4_neardup
from .packing import op6_packing
from .personal import op7_personal
from .quality import op1_quality
from .secrets import op10_secrets
from .toxicity import op2_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_neardup": op4_neardup,
    "op5_topk": topk.op5_topk,
    "op6_packing": op6_packing,
    "op7_personal": op7_personal,
    "op8_warc": warc.op8_warc,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
    "op11_merge": branches.op11_merge,
    "op12_runs": periodic.op12_runs,
    "op13_repeats": repeats.op13_repeats,
}
ORACLE_SQL = {"op5_topk": topk.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op11_merge": branches.ORACLE_SQL, "op12_runs": periodic.ORACLE_SQL, "op13_repeats": repeats.ORACLE_SQL}
