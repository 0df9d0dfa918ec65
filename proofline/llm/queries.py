"""The queries of this subpackage, each over its whole table with production parameters."""

from . import decontaminate, line_dedup, near_dedup, packing, pii, secrets, sharding, topk, toxicity, warc

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_secret_ledger": secrets.op3_secret_ledger,
    "op4_warc_salvage": warc.op4_warc_salvage,
    "op5_pii_disclosure": pii.op5_pii_disclosure,
    "op6_complement_packing": packing.op6_complement_packing,
    "op7_kdtree_sharding": sharding.op7_kdtree_sharding,
    "op8_counterfactual_toxicity": toxicity.op8_counterfactual_toxicity,
    "op9_latent_decontamination": decontaminate.op9_latent_decontamination,
    "op10_template_line_dedup": line_dedup.op10_template_line_dedup,
}

ORACLE_SQL = {
    "op1_exact_topk": topk.ORACLE_SQL,
    "op2_minhash_near_dedup": near_dedup.ORACLE_SQL,
    "op3_secret_ledger": secrets.ORACLE_SQL,
    "op4_warc_salvage": warc.ORACLE_SQL,
}
