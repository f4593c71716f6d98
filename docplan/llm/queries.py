"""One registered query per operator, over its whole table."""

from __future__ import annotations

from docplan.llm import (code_links, decontamination, host_rules, licenses, near_copies, packing, quality, quotations, sharding, subvectors,
                         suffix_tree, toxicity, whitening)
from docplan.llm.common import table
from docplan.llm.registry import register


@register("op7_feistel_shards")
def op7_feistel_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@register("op10_host_rules")
def op10_host_rules(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


@register("op2_additive_quality")
def op2_additive_quality(spark, sf_dir):
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_subsequence_toxicity")
def op8_subsequence_toxicity(spark, sf_dir):
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(table(spark, sf_dir, "documents"))


@register("op1_simhash_decontamination")
def op1_simhash_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_order_minhash_copies")
def op4_order_minhash_copies(spark, sf_dir):
    return near_copies.deduplicated(table(spark, sf_dir, "documents"))


@register("op5_suffix_tree_scores")
def op5_suffix_tree_scores(spark, sf_dir):
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


@register("op3_license_dice", licenses.oracle())
def op3_license_dice(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


# each turn's parent is the earliest turn of the conversation with the words of the turn before
_OP6_SQL = r"""
with recursive norm as (
  select conv_id, turn, text, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) as words from conversations),
firsts as (select conv_id, words, min(turn) as origin from norm where words <> '' group by all),
linked as (
  select n.conv_id, n.turn, n.text, f.origin as parent
  from (select *, lag(words) over (partition by conv_id order by turn) as before from norm) n
  left join firsts f on f.conv_id = n.conv_id and f.words = n.before and f.origin < n.turn),
walk as (
  select conv_id, turn, turn as conversation, 0 as depth from linked where parent is null
  union all
  select l.conv_id, l.turn, w.conversation, w.depth + 1 from linked l join walk w on w.conv_id = l.conv_id and w.turn = l.parent)
select l.conv_id, l.turn, l.parent, w.conversation, w.depth, trim(l.text, chr(10)) as own_text
from linked l join walk w on w.conv_id = l.conv_id and w.turn = l.turn
"""


@register("op6_quotation_threads", _OP6_SQL)
def op6_quotation_threads(spark, sf_dir):
    return quotations.threads(table(spark, sf_dir, "conversations"))


@register("op11_subvector_clusters", subvectors.oracle())
def op11_subvector_clusters(spark, sf_dir):
    return subvectors.clustered(table(spark, sf_dir, "embeddings"))


@register("op12_sliced_whitening")
def op12_sliced_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@register("op13_rotated_code_links", code_links.oracle())
def op13_rotated_code_links(spark, sf_dir):
    return code_links.links(table(spark, sf_dir, "embeddings"))
