"""The queries of problems 7 to 9 over the project's tables, with their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.text import plain_or_null
from quillstream.llm import mixture, residue, tokenizer
from quillstream.session import spread, stored, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """What the query needs of the documents; reading them in Python costs more than moving a few."""
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(_documents(spark, d), ["doc_id"], "text")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_counts(_documents(spark, d), ["doc_id"], "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text after encoding and decoding, which must be the text itself."""
    return tokenizer.decoded(p7_ids(spark, d), ["doc_id"])


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = mixture.target_table(table(spark, d, "mix_targets"))
    return mixture.sized(_documents(spark, d, "source"), targets, "doc_id", "text", "source", tokenizer.VOCABULARY), targets


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(*_sized(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sized(spark, d)
    return mixture.shares(stored(mixture.mix(sizes, targets), "mix"), sizes, targets)


def p8_available(spark: SparkSession, d: str) -> DataFrame:
    """What each target source has to give: its share, how often a document may come, and its documents with and without text."""
    targets = mixture.target_table(table(spark, d, "mix_targets"))
    held = table(spark, d, "documents").groupBy(plain_or_null("source").alias("source")).agg(F.count_if(F.length("text") > 0).alias("documents"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return targets.join(F.broadcast(held.join(targets.select("source"), "source", "left_semi")), "source", "left").select("source", "target_share", "max_repeats", zero("documents"), zero("empty"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_documents(spark, d), "doc_id", "text").select("doc_id").distinct()


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each case with what it shows: slot, filler, error or scripts."""
    return residue.residue(_documents(spark, d), "doc_id", "text")


def p9_templates(spark: SparkSession, d: str) -> DataFrame:
    """The mined message templates with their verdicts and how often they occur."""
    return residue.template_report(_documents(spark, d), "doc_id", "text")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that stay when the cases are excluded."""
    documents = table(spark, d, "documents").select("doc_id")
    return documents.join(p9_found(spark, d), "doc_id", "left_anti")


def queries() -> dict[str, Query]:
    made = [p7_ids, p7_counts, p7_decoded, p8_mix, p8_shares, p8_available, p9_found, p9_kinds, p9_templates, p9_kept]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    plain = "nullif(lower(trim({}, ' ' || chr(9))), '')"
    return {
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p8_available": f"""WITH t AS (SELECT {plain.format('source')} AS source, target_share, max_repeats FROM mix_targets)
  SELECT t.source, target_share, max_repeats, count(doc_id) FILTER (length(text) > 0) AS documents, count(doc_id) FILTER (coalesce(length(text), 0) = 0) AS empty FROM t LEFT JOIN documents d ON {plain.format('d.source')} = t.source GROUP BY ALL""",
    }
