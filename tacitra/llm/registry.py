"""The queries of the text problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tacitra.llm.encoding import garbled_rows
from tacitra.llm.entities import linked_addresses
from tacitra.llm.evidence import given_name_evidence, typed_names
from tacitra.llm.leakage import leaked_items
from tacitra.llm.newtext import foreign_lines
from tacitra.llm.personal import personal_data, without_personal_data
from tacitra.llm.spam import spam_pages
from tacitra.llm.tokenize import encode_corpus
from tacitra.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_lines(table(spark, sf_dir, "enron_emails"), "row_id", "body").select("row_id", "line_no")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_addresses(table(spark, sf_dir, "clean_names"), aliases_col="duplicates", mails=table(spark, sf_dir, "enron_emails"))


def _given_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_name_evidence(typed_names(table(spark, sf_dir, "enron_emails"), "from", table(spark, sf_dir, "clean_names"), "display_names"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "enron_emails"), "row_id", ["subject", "body"], learned=_given_names(spark, sf_dir))


def p5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject and body with its personal data replaced by keyed surrogates."""
    return without_personal_data(table(spark, sf_dir, "enron_emails"), "row_id", ["subject", "body"], key="surrogates of the test corpus", learned=_given_names(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_rows(table(spark, sf_dir, "enron_emails"), "row_id", "body").select("row_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that share ten words with one word added, missing or replaced at most."""
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ["passage", "question"], max_edits=1)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of p9_near that stand word for word."""
    return p9_near(spark, sf_dir).where("edits = 0").select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def queries() -> dict:
    return {"p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_surrogates": p5_surrogates, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    """Only what SQL expresses; the others are tested against brute force, libraries and round trips."""
    grams = "SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM ({words}))"
    words = "SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL"
    docs = grams.format(key="doc_id", words=words.format(key="doc_id", text="text", table="documents"))
    items = [grams.format(key="item_id", words=words.format(key="item_id", text=t, table="eval_items")) for t in ("passage", "question")]
    return {"p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({docs}) JOIN ({items[0]} UNION {items[1]}) USING (g)"}
