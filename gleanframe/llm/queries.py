"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gleanframe.llm import alignment, ball_tree, bpe, decontaminate, lexical_search, passages, pii, quality_rules, quote_links, resample, secret_scan, simhash, token_files
from gleanframe.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_risk_controlled_rules", quality_rules.sql())
def op1_risk_controlled_rules(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_simhash_pigeonring")
def op2_simhash_pigeonring(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op3_pii_disclosure")
def op3_pii_disclosure(spark, sf):
    return pii.report(table(spark, sf, "documents"))


@query("op4_quote_links", quote_links.SQL)
def op4_quote_links(spark, sf):
    mail = quote_links.as_mail(table(spark, sf, "conversations"))
    return quote_links.report(quote_links.build(mail))


@query("op5_repeated_lines", passages.SQL)
def op5_repeated_lines(spark, sf):
    return passages.report(table(spark, sf, "documents"))


@query("op6_decontaminate", decontaminate.SQL)
def op6_decontaminate(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_secret_forest")
def op7_secret_forest(spark, sf):
    return secret_scan.report(secret_scan.scan(table(spark, sf, "documents"), rule=secret_scan.weak_label()))


@query("op8_bpe_round_trip")
def op8_bpe_round_trip(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"))


@query("op9_token_files")
def op9_token_files(spark, sf):
    return token_files.write_and_read(table(spark, sf, "documents"))


@query("op10_importance_resampling")
def op10_importance_resampling(spark, sf):
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op11_ball_tree_top_k", ball_tree.SQL)
def op11_ball_tree_top_k(spark, sf):
    return ball_tree.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op12_token_alignment")
def op12_token_alignment(spark, sf):
    return alignment.report(table(spark, sf, "documents"))


@query("op13_geometric_blocks", lexical_search.SQL)
def op13_geometric_blocks(spark, sf):
    return lexical_search.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
