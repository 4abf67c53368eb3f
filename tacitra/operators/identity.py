"""Names of addresses: cleaning of header names, system accounts, duplicates, and the order in which names are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacitra.operators.dims import SYSTEM_ACCOUNT


def local_part(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", 1))


def domain_part(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.substring_index(address, "@", -1))).otherwise(F.lit(""))


def clean_header_name(raw: Column, suffix: str = "") -> Column:
    """A header name without directory path, brackets, trailing department and quotes; 'Last, First' turned round.

    ``suffix`` is the organisation's name as mail systems append it (Name@SUFFIX); by default any in capitals is removed.
    """
    out = raw
    for pattern in (r"(?i)\s*</O=[^>]*>?", r"\s*<[^>]*>", rf"(?i)@{suffix}\S*" if suffix else r"@[A-Z]{2,}\b\S*", r"(?i)\s*<IMCEA[^>]*>?", r"\s*\([^)]*\)\s*$", r"(?:/[A-Z]+)+$"):
        out = F.regexp_replace(out, pattern, "")
    out = F.trim(F.regexp_replace(out, r"[\"']", ""))
    out = F.when(out.rlike(r"^[^,]+,\s*[^,]+$"), F.regexp_replace(out, r"^([^,]+),\s*([^,]+)$", "$2 $1")).otherwise(out)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def formatted_name(address: Column, drop_digits: bool = False, drop_quoted: bool = False) -> Column:
    """A display name made of the local part: its tokens between dots and underscores, each with a capital."""
    tokens = F.filter(F.split(local_part(address), "[._]"), lambda t: t != "")
    if drop_digits:
        tokens = F.filter(tokens, lambda t: ~t.rlike(r"^\d+$"))
    if drop_quoted:
        tokens = F.filter(tokens, lambda t: ~t.startswith("'"))
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 200))), " ")


def is_system_account(address: Column) -> Column:
    """By the local part: a pattern of system names, digits only, or six characters at most with a digit."""
    local = local_part(address)
    return local.rlike(SYSTEM_ACCOUNT) | local.rlike(r"^\d+$") | (F.length(local) <= 6) & local.rlike(r"\d")


def in_lists(addresses: DataFrame, column: str, locals_: list[str], domains: list[str]) -> DataFrame:
    """Rows whose local part or domain stands in the lists, exactly (no beginnings); the lists are short."""
    c = F.col(f"`{column}`")
    return addresses.where(local_part(c).isin(*locals_) | domain_part(c).isin(*domains))


def valid_successor(name: Column) -> Column:
    """Two words at least, no digits or signs."""
    return (F.size(F.split(F.trim(name), r"\s+")) >= 2) & ~name.rlike(r"[0-9@#$%^&*_+=\[\]{}|<>]")


def classify_addresses(addresses: DataFrame, removed: DataFrame, duplicates: DataFrame, fixed: DataFrame, discovered: DataFrame) -> DataFrame:
    """(email, kind, name, canonical) with the precedence removed, duplicate, fixed, discovered, unknown.

    ``removed`` (email), ``duplicates`` (email, canonical), ``fixed`` and ``discovered`` (email, name). All are joined by
    address, none is broadcast by force.
    """
    out = (
        addresses.select(F.lower(F.trim("email")).alias("email")).where("email != ''").distinct()
        .join(removed.select("email").distinct().withColumn("r", F.lit(True)), "email", "left")
        .join(duplicates.groupBy("email").agg(F.min("canonical").alias("canonical")), "email", "left")
        .join(fixed.groupBy("email").agg(F.min("name").alias("fixed")), "email", "left")
        .join(discovered.groupBy("email").agg(F.min("name").alias("discovered")), "email", "left")
    )
    kind = F.when(F.col("r"), "removed").when(F.col("canonical").isNotNull(), "duplicate").when(F.col("fixed").isNotNull(), "fixed").when(F.col("discovered").isNotNull(), "discovered").otherwise("unknown")
    return out.select("email", kind.alias("kind"), F.coalesce("fixed", "discovered", formatted_name(F.col("email"))).alias("name"), "canonical")


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the first row of each key by ``order``."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))
