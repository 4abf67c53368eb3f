"""Raw mail messages (file, message) read into the mail table."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_string, policy
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "file string, message_id string, date timestamp, from string, to string, cc string, subject string, body string"
_COLUMNS = ["file", "message_id", "date", "from", "to", "cc", "subject", "body"]


def _addresses(values: list[str] | None) -> str | None:
    found = [a.strip().lower() for _, a in getaddresses([str(v) for v in values or []]) if a.strip()]
    return ", ".join(found) or None


def _part(part) -> str:
    text = part.get_payload()
    if isinstance(text, str) and not text.isascii() and str(part.get("Content-Transfer-Encoding", "")).strip().lower() in ("", "7bit", "8bit", "binary"):
        return text  # decoded already; the parser would escape it
    raw = part.get_payload(decode=True)
    if raw is None:
        return part.get_payload() if isinstance(part.get_payload(), str) else ""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def parse_message(text: str | None) -> tuple:
    """(message_id, date, from, to, cc, subject, body); all None for a message that cannot be parsed."""
    nothing = (None,) * 7
    if not isinstance(text, str) or not text.strip():
        return nothing
    try:
        m = message_from_string(text, policy=policy.compat32)
        if not m.keys():
            return nothing
        try:
            when = parsedate_to_datetime(m["Date"]) if m["Date"] else None
            when = when and pd.Timestamp(when)
            when = when and (when.tz_localize("UTC") if when.tzinfo is None else when.tz_convert("UTC"))
        except (TypeError, ValueError, IndexError):
            when = None
        parts = [p for p in m.walk() if p.get_content_type() == "text/plain"] if m.is_multipart() else [m]
        body = "\n".join(_part(p) for p in parts)
        strip = lambda h: str(m[h]).strip() if m[h] is not None else None
        return (strip("Message-ID"), when, _addresses(m.get_all("From")), _addresses(m.get_all("To")), _addresses(m.get_all("Cc")), strip("Subject"), body or None)
    except Exception:  # noqa: BLE001 - any damage makes the row malformed
        return nothing


def parse_mail(raw: DataFrame) -> DataFrame:
    """The mail table of (file, message); a malformed message keeps its file, all else null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *parse_message(m)) for f, m in zip(pdf.file, pdf.message)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            out["date"] = pd.to_datetime(out["date"], utc=True)
            yield out

    return raw.select("file", "message").mapInPandas(run, SCHEMA)


def raw_message(message_id: Column, date: Column, sender: Column, to: Column, cc: Column, subject: Column, body: Column) -> Column:
    """The raw message of a mail: a header for each field that is not null, its line breaks made one space, and the body as it is."""
    fields = [("Message-ID", message_id), ("Date", date), ("From", sender), ("To", to), ("Cc", cc), ("Subject", subject)]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[ \t]*[\r\n][ \t\r\n]*", " "), F.lit("\n")), F.lit("")) for name, value in fields]
    return F.concat(*lines, F.lit("\n"), F.coalesce(body, F.lit("")))


def header(message: Column, name: str) -> Column:
    """The first line of a header by pattern alone, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(message, rf"(?im)^{name}:[ \t]*([^\r\n]+)", 1)), F.lit(""))


def malformed(mails: DataFrame) -> DataFrame:
    return mails.agg(F.count_if(F.col("message_id").isNull() & F.col("from").isNull()).alias("n_malformed"), F.count(F.lit(1)).alias("n"))
