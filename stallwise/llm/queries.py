"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from stallwise.llm import alignment, ann, chat, html_text, mixing, packing, privacy, quality, simhash, toxicity, url_rules, variants, warc
from stallwise.llm.common import table
from stallwise.llm.oracles import ORACLES

QUERIES = {
    "op1_url_rules": lambda spark, sf: url_rules.report(table(spark, sf, "pages"), table(spark, sf, "labels")),
    "op2_multi_index": lambda spark, sf: ann.report(table(spark, sf, "embeddings")),
    "op3_budget_mix": lambda spark, sf: mixing.report(table(spark, sf, "documents")),
    "op4_toxicity": lambda spark, sf: toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op5_simhash": lambda spark, sf: simhash.report(table(spark, sf, "documents")),
    "op6_main_text": lambda spark, sf: html_text.report(table(spark, sf, "pages")),
    "op7_role_repair": lambda spark, sf: chat.repair_conversations(table(spark, sf, "conversations")),
    "op8_bin_completion": lambda spark, sf: packing.pack_documents(table(spark, sf, "documents")),
    "op9_quality": lambda spark, sf: quality.report(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op10_warc": lambda spark, sf: warc.report(table(spark, sf, "pages")),
    "op11_merge_path": lambda spark, sf: alignment.report(table(spark, sf, "documents")),
    "op12_variants": lambda spark, sf: variants.report(table(spark, sf, "documents")),
    "op13_privacy": lambda spark, sf: privacy.report(table(spark, sf, "documents")),
    "pipeline": corpus_pipeline.run,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
