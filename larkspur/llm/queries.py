"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .bpe_codec import op8_bpe_codec
from .decontaminate import OP3_SQL, op3_decontamination
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .line_dedup import OP10_SQL, op10_line_dedup
from .merkle_manifest import OP13_SQL, op13_merkle_manifest
from .repetition import op4_repetition
from .sharding import op12_sharding
from .suffix_dedup import OP9_SQL, op9_suffix_dedup
from .token_count import op7_token_counts
from .token_files import op1_token_files
from .toxicity import op5_toxicity
from .warc import OP2_SQL, op2_warc


def queries() -> dict:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_token_files, op2_warc, op3_decontamination, op4_repetition, op5_toxicity, op6_jaccard_join, op7_token_counts, op8_bpe_codec, op9_suffix_dedup, op10_line_dedup, op11_hard_negatives, op12_sharding, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_decontamination": OP3_SQL, "op6_jaccard_join": OP6_SQL, "op9_suffix_dedup": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
