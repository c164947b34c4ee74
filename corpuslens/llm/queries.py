"""Named queries of the operators for training data, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm import abuse, checks, encoding, frequency, mixture, nearcopies, scans, sitelines, split, tokens
from corpuslens.llm.oracle import SQL  # noqa: F401
from corpuslens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return encoding.garbled(table(spark, root, "documents_okf"))


def p1_restored(spark: SparkSession, root: str) -> DataFrame:
    return encoding.restored(table(spark, root, "documents_okf"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.noisy(table(spark, root, "documents_okf"), table(spark, root, "chunks"))


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    return scans.repaired(table(spark, root, "documents_okf"), table(spark, root, "chunks"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return split.oversized(table(spark, root, "chunks"))


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split.split_chunks(table(spark, root, "chunks"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return frequency.marked_terms(table(spark, root, "postings"), table(spark, root, "docs"))


def p4_term_frequencies(spark: SparkSession, root: str) -> DataFrame:
    return frequency.term_frequencies(table(spark, root, "postings"), table(spark, root, "docs"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, root, "documents_okf"))


def p6_templates(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.site_templates(table(spark, root, "documents_okf"))


def p6_cleaned(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.without_repeated_lines(table(spark, root, "documents_okf"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return nearcopies.similar_pairs(table(spark, root, "documents_okf"))


def p7_groups(spark: SparkSession, root: str) -> DataFrame:
    links, members = nearcopies.similar_classes(table(spark, root, "documents_okf"))
    return nearcopies.groups(links, members)


def p7_members(spark: SparkSession, root: str) -> DataFrame:
    return nearcopies.members(table(spark, root, "documents_okf"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.token_ids(table(spark, root, "documents"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return abuse.abusive(table(spark, root, "documents"), table(spark, root, "labels"))


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    return abuse.scored(table(spark, root, "documents"), table(spark, root, "labels"))


def p10_source_rates(spark: SparkSession, root: str) -> DataFrame:
    return abuse.source_rates(table(spark, root, "documents"), table(spark, root, "labels"))


def p1_unchanged(spark: SparkSession, root: str) -> DataFrame:
    return checks.restored_otherwise_unchanged(table(spark, root, "documents_okf"))


def p2_unchanged(spark: SparkSession, root: str) -> DataFrame:
    return checks.repaired_otherwise_unchanged(table(spark, root, "documents_okf"), table(spark, root, "chunks"))


def p3_joined(spark: SparkSession, root: str) -> DataFrame:
    return checks.pieces_joined(table(spark, root, "chunks"))


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    return checks.ids_decoded(table(spark, root, "documents"))


def p9_kept(spark: SparkSession, root: str) -> DataFrame:
    return checks.mixture_kept(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p10_counted(spark: SparkSession, root: str) -> DataFrame:
    return checks.scores_counted(table(spark, root, "documents"), table(spark, root, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_restored, p2_found, p2_repaired, p3_found, p3_pieces, p4_found, p4_term_frequencies, p6_found, p6_templates, p6_cleaned, p7_found, p7_groups, p7_members, p8_ids, p9_mixture, p9_report, p10_found, p10_scores, p10_source_rates, p1_unchanged, p2_unchanged, p3_joined, p8_decoded, p9_kept, p10_counted)
}
