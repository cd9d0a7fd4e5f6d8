"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from strandline.llm import decontaminate, katz, minhash, packing, secrets, suffixes, toxicity, training_order, transport, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_secret_scan": secrets.query,
    "op3_katz_scores": katz.query,
    "op4_minhash_near_dedup": minhash.query,
    "op5_decontamination": decontaminate.query,
    "op6_training_order": training_order.query,
    "op7_transport_streams": transport.query,
    "op8_repeated_passages": suffixes.query,
    "op9_toxicity": toxicity.query,
    "op10_best_fit_packing": packing.query,
}

ORACLE = {
    "op7_transport_streams": transport.ORACLE,
    "op1_warc": warc.ORACLE,
    "op2_secret_scan": secrets.oracle(),
    "op5_decontamination": decontaminate.ORACLE,
    "op8_repeated_passages": suffixes.ORACLE,
}
