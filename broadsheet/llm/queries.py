"""The operators over their whole tables: one thin query each, with SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from broadsheet.llm import (
    byte_bpe, chosen_path, collision_count, collocations, decontamination, hard_negatives, lang_id, packing, quality_rules, sharding, site_tree, suffix_dedup,
    token_attribution,
)
from broadsheet.llm.common import Query, table

QUERIES: dict[str, Query] = {
    "op1_collision_counting": lambda spark, sf_dir: collision_count.digest(table(spark, sf_dir, "embeddings")),
    "op10_chosen_path": lambda spark, sf_dir: chosen_path.digest(table(spark, sf_dir, "documents")),
    "op11_wu_manber": lambda spark, sf_dir: decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_quotient_filters": lambda spark, sf_dir: collocations.digest(table(spark, sf_dir, "documents")),
    "op13_four_russians": lambda spark, sf_dir: hard_negatives.digest(table(spark, sf_dir, "embeddings")),
    "op2_subword_language": lambda spark, sf_dir: lang_id.digest(table(spark, sf_dir, "documents")),
    "op3_concat_and_cut": lambda spark, sf_dir: packing.digest(table(spark, sf_dir, "documents")),
    "op4_site_style_tree": lambda spark, sf_dir: site_tree.digest(table(spark, sf_dir, "pages")),
    "op5_sampled_splitters": lambda spark, sf_dir: sharding.digest(table(spark, sf_dir, "documents")),
    "op6_linear_grouping": lambda spark, sf_dir: suffix_dedup.digest(table(spark, sf_dir, "documents")),
    "op7_offset_attribution": lambda spark, sf_dir: token_attribution.digest(table(spark, sf_dir, "documents")),
    "op8_rule_bitmask": lambda spark, sf_dir: quality_rules.verdicts(table(spark, sf_dir, "documents")),
    "op9_distinct_word_bpe": lambda spark, sf_dir: byte_bpe.digest(table(spark, sf_dir, "documents")),
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op8_rule_bitmask": quality_rules.sql(),
    "op11_wu_manber": decontamination.sql(),
    "op12_quotient_filters": collocations.sql(),
    "op13_four_russians": hard_negatives.sql(),
}
