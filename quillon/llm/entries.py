"""The subpackage's queries and their SQL, for the driver's registry."""

from __future__ import annotations

from . import decontaminate, jaccard, maincontent, mixing, pii, quality, suffixdedup, tokenbin, topk, warc

QUERIES = {
    "op1_warc_transactions": warc.op1,
    "op2_weak_label_quality": quality.op2,
    "op3_parity_jaccard_join": jaccard.op3,
    "op4_bwt_merge_dedup": suffixdedup.op4,
    "op5_elias_fano_token_ids": tokenbin.op5,
    "op6_sainte_lague_mixing": mixing.op6,
    "op7_mincut_main_text": maincontent.op7,
    "op8_bootstrapped_pii": pii.op8,
    "op9_threshold_topk": topk.op9,
    "op10_suffix_decontamination": decontaminate.op10,
}

ORACLE_SQL = {
    "op3_parity_jaccard_join": jaccard.OP3_SQL,
    "op1_warc_transactions": warc.OP1_SQL,
    "op9_threshold_topk": topk.OP9_SQL,
    "op10_suffix_decontamination": decontaminate.OP10_SQL,
}
