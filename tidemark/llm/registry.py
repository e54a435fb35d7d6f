"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, licences, mixing, revisits, simhash, tokencount, toolcalls, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        licences.op1_license_scan,
        toolcalls.op2_tool_call_linking,
        revisits.op3_warc_revisits,
        tokencount.op4_edit_aware_counts,
        langid.op5_language_mixture,
        mixing.op6_pivotal_mixing,
        simhash.op7_simhash_near_duplicates,
        decontam.op8_string_tiling,
        topk.op9_exact_top_k,
        toxicity.op10_toxicity,
    )
}

#: Where SQL can say it and is fast enough on whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_tool_call_linking": toolcalls.SQL, "op3_warc_revisits": revisits.SQL, "op9_exact_top_k": topk.SQL}
