"""All queries of the core and their SQL."""

from __future__ import annotations

from tacitra.plans import departures, knowledge, network, packed, reports, risks, texts

MODULES = [knowledge, network, risks, departures, texts, reports]
FLAGSHIP = knowledge.topic_vulnerability


def queries() -> dict:
    found = dict(packed.QUERIES)
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(packed.SQL)
    for module in MODULES:
        found |= module.SQL
    return found
