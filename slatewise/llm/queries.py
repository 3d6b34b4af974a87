"""The queries of the training-data operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from slatewise.llm import (
    collocations, decontamination, exact_dedup, hmm, licences, merkle, mixing, passages, quality, simhash, token_files, url_filter, warc)

QUERIES = {f.__name__: f for f in (
    decontamination.op1_decontamination, hmm.op2_hmm_scores, licences.op3_licence_scan, simhash.op4_simhash, mixing.op5_mixing, quality.op6_quality, passages.op7_passages,
    exact_dedup.op8_exact_dedup, url_filter.op9_url_filter, warc.op10_warc,
    token_files.op11_token_files, collocations.op12_collocations, merkle.op13_merkle_manifest)}

ORACLES = {
    "op1_decontamination": decontamination.SQL,
    "op3_licence_scan": licences.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_collocations": collocations.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
