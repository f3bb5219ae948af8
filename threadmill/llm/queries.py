"""The driver's queries over the synthetic tables: each applies an operator to its whole table."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html, near, quality, rules, secrets, sharding, warc
from .common import read

def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": _pipeline,
    "op1_block_rules": lambda s, d: html.op1(read(s, d, "pages")),
    "op2_capture_index": lambda s, d: warc.op2(read(s, d, "pages")),
    "op3_compression_quality": lambda s, d: quality.op3(read(s, d, "documents"), read(s, d, "labels")),
    "op4_winnowing": lambda s, d: decontaminate.op4(read(s, d, "documents"), read(s, d, "benchmark")),
    "op5_quotation_links": lambda s, d: chat.op5(read(s, d, "conversations")),
    "op6_divide_skip": lambda s, d: near.op6(read(s, d, "documents")),
    "op7_quality_rules": lambda s, d: rules.op7(read(s, d, "documents")),
    "op9_bpe": lambda s, d: bpe.op9(read(s, d, "documents")),
    "op10_secret_forest": lambda s, d: secrets.op10(read(s, d, "documents")),
    "op8_sharding": lambda s, d: sharding.op8(read(s, d, "documents")),
    # the part of op7 that SQL can express
    "base_rule_measures": lambda s, d: rules.base_measures(read(s, d, "documents")),
}
ORACLES: dict[str, str] = {
    "op8_sharding": sharding.OP8_SQL,
    "op2_capture_index": warc.OP2_SQL,
    "op4_winnowing": decontaminate.OP4_SQL,
    "op5_quotation_links": chat.OP5_SQL,
    "op6_divide_skip": near.OP6_SQL,
    "base_rule_measures": rules.BASE_SQL,
}
