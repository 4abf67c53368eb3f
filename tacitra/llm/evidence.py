"""Given names learned from the corpus itself, to stand beside the prior list of ``names``.

Some typed names tell by their form which part is the given name: 'Family, Given', and names beside an address whose
local part is an initial joined to the family name. The parts of such names are counted over the whole corpus; a word
counts as a given name if it stands beside several family names and more often as given than as family name.

Defined results
* null and blank names and addresses, names of one word and names of companies give no evidence; letter case and accents
  do not matter; repeated rows change nothing (pairs of names are counted, not rows); an empty table gives no name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitra.llm.names import fold

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NO_PERSON = re.compile(r"\b(?:ltd|inc|corp|co|llc|plc|limited|incorporated|corporation|company|partners|services|group|holdings|associates|associs|assocs|utilities|team|desk)\b")


def sure_parts(address: str | None, name: str | None) -> tuple[str, str] | None:
    """(given name, family name) of a typed name whose form tells them apart, else None."""
    if not name:
        return None
    plain = fold(re.sub(r"\([^)]*\)|/.*|<.*|@.*|\"", " ", name))
    if _NO_PERSON.search(plain):
        return None
    left, comma, right = plain.partition(",")
    if comma:
        family, given = _WORD.findall(left), _WORD.findall(right)
        return (given[0], family[0]) if len(family) == 1 and 1 <= len(given) <= 2 and len(given[0]) > 2 else None
    words = [w for w in _WORD.findall(plain) if len(w) > 1]
    if len(words) != 2 or min(map(len, words)) < 3 or not address:
        return None
    local = re.sub(r"\d+$", "", address.partition("@")[0].lower())
    for given, family in (words, words[::-1]):
        if local in (given[0] + family, family + given[0]) and given[0] + family not in (words[1] + words[0], words[0] + words[1]):
            return given, family
    return None


def typed_names(mails: DataFrame | None, from_col: str, export: DataFrame | None, names_col: str) -> DataFrame:
    """(address, name) of every different name typed for an address, in senders and in an export of display names."""
    parts = []
    if mails is not None:
        sender = F.col(f"`{from_col}`")
        address = F.lower(F.regexp_extract(sender, r"([^\s<>\"(),;:\[\]]+@[^\s<>\"(),;:\[\]]+)", 1))
        name = F.coalesce(F.nullif(F.regexp_extract(sender, r"^([^<]*)<", 1), F.lit("")), F.nullif(F.regexp_extract(sender, r"@\S+\s*\(([^)]*)\)", 1), F.lit("")))
        parts.append(mails.select(address.alias("address"), name.alias("name")))
    if export is not None:
        parts.append(export.select(F.explode(F.col(f"`{names_col}`")).alias("address", "name")).select(F.lower(F.trim("address")).alias("address"), "name"))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.select("address", F.trim(F.regexp_replace("name", r"^[\s\"']+|[\s\"']+$", "")).alias("name")).where("name != ''").distinct()


def given_name_evidence(typed: DataFrame, least_families: int = 2) -> DataFrame:
    """(word) of the given names that the typed names (address, name) show beside ``least_families`` family names or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {p for p in (sure_parts(a, n) for a, n in zip(pdf.address, pdf.name)) if p}
            yield pd.DataFrame(sorted(found), columns=["given", "family"])

    pairs = typed.mapInPandas(run, "given string, family string").distinct()
    counted = pairs.select("given", F.lit(1).alias("g"), F.lit(0).alias("f")).union(pairs.select("family", F.lit(0), F.lit(1))).groupBy(F.col("given").alias("word")).agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    return counted.where((F.col("g") >= least_families) & (F.col("g") >= 2 * F.col("f"))).select("word")
