"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from lodeworks.llm import bpe, embeddings, maxscore, minhash, mixture, negatives, pii, quality, runs, secrets, toxicity, warc, wavelet

QUERIES = {
    "op1_bpe": bpe.op1,
    "op2_warc": warc.op2,
    "op3_secrets": secrets.op3,
    "op4_toxicity": toxicity.op4,
    "op5_quality": quality.op5,
    "op6_mixture": mixture.op6,
    "op7_wavelet": wavelet.op7,
    "op8_minhash": minhash.op8,
    "op9_embeddings": embeddings.op9,
    "op10_pii": pii.op10,
    "op11_maxscore": maxscore.op11,
    "op12_runs": runs.op12,
    "op13_negatives": negatives.op13,
    "pipeline": corpus_pipeline.run,
    "quality_ablations": quality.quality_ablations,
}

#: DuckDB SQL where SQL can express the whole result.
ORACLE: dict[str, str] = {"op2_warc": warc.OP2_SQL, "op11_maxscore": maxscore.OP11_SQL, "op13_negatives": negatives.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
