"""Messages delivered more than once: exactly one copy of each identifier is kept.

The kept row comes from one hash aggregation by identifier whose value is ``min_by`` over delivery time and a
deterministic tie-break, so that map-side partial aggregation reduces a hot identifier before the shuffle. A struct is no
value that a hash aggregation can update in place (Spark would sort instead), so where the tie-break is a whole number the
two parts are packed into one decimal that orders as the struct does; for other tie-breaks the struct itself is used.

Defined results
* rows without identifier (null, or nothing left after cleaning) are never copies of each other and all kept;
* ties on the delivery time are decided by the tie-break column; a null delivery time comes last;
* tie-break values may repeat, within an identifier and across identifiers;
* wholly repeated rows (same identifier, time and tie-break) count as one row: ``keep_first`` keeps one of them,
  ``surplus_rows`` lists none of them;
* a null tie-break comes first; a row whose tie-break is null is never listed as surplus and always kept;
* extra columns are carried by ``keep_first``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message_key(message_id: Column) -> Column:
    """The identifier without outer white space and angle brackets, the part behind the last @ in lower case."""
    bare = F.regexp_replace(message_id, r"^[\s<>]+|[\s<>]+$", "")
    at = F.length(bare) - F.length(F.substring_index(bare, "@", -1))
    keyed = F.when(bare.contains("@"), F.concat(F.substring(bare, F.lit(1), at), F.lower(F.substring_index(bare, "@", -1)))).otherwise(bare)
    return F.when(keyed != "", keyed)


def _order(time: Column, tie: Column, time_type: str, tie_type: str) -> Column:
    """Delivery time, then tie-break, as one value: a decimal for timestamps and whole numbers, else a struct."""
    if time_type != "timestamp" or tie_type not in ("bigint", "int", "smallint", "tinyint"):
        return F.struct(time.isNull().alias("n"), time.alias("t"), tie.alias("i"))
    # 2^64 steps a microsecond: the whole range of years 1 to 9999 and every tie-break fit into 38 digits
    micros = F.coalesce(F.unix_micros(time), F.lit(4 * 10**17)).cast("decimal(18,0)")  # null sorts behind every given time
    return (micros * F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.coalesce(tie.cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))


def _kept(keyed: DataFrame) -> DataFrame:
    """(_key, _time, _tie) of the kept row of each identifier."""
    types = dict(keyed.dtypes)
    given = keyed.where(F.col("_key").isNotNull())
    order = _order(F.col("_time"), F.col("_tie"), types["_time"], types["_tie"])
    return given.groupBy("_key").agg(F.min_by("_time", order).alias("_time"), F.min_by("_tie", order).alias("_tie"))


def _keyed(df: DataFrame, key: Column, time_col: str, tie_col: str) -> DataFrame:
    return df.select(key.alias("_key"), F.col(f"`{time_col}`").alias("_time"), F.col(f"`{tie_col}`").alias("_tie"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """Identifier, time and tie-break agree; a missing time agrees with a missing one."""
    return (a["_key"] == b["_key"]) & a["_time"].eqNullSafe(b["_time"]) & (a["_tie"] == b["_tie"])


def surplus_rows(df: DataFrame, key: Column, time_col: str, tie_col: str, unique_ties: bool = False) -> DataFrame:
    """The tie-break values (row ids) of every row but the kept one of its identifier.

    ``unique_ties`` states that the tie-break column has no repeated value: then the second exchange holds nothing but
    row ids. Otherwise it holds identifier, time and tie-break. Neither exchange is skewed by a hot identifier.
    """
    keyed = _keyed(df, key, time_col, tie_col)
    kept = _kept(keyed)
    rows = keyed.where(F.col("_key").isNotNull() & F.col("_tie").isNotNull())
    if unique_ties:
        return rows.select("_tie").join(kept.select("_tie"), "_tie", "left_anti").select(F.col("_tie").alias(tie_col))
    return rows.join(kept, _same(rows, kept), "left_anti").select(F.col("_tie").alias(tie_col)).distinct()


def keep_first(df: DataFrame, key: Column, time_col: str, tie_col: str, unique_ties: bool = False) -> DataFrame:
    """All columns of the kept rows, rows without identifier included.

    ``unique_ties`` states that the tie-break column has no repeated value; whole rows are then exchanged by it alone and
    the removal of wholly repeated rows is left out.
    """
    kept = _kept(_keyed(df, key, time_col, tie_col))
    # the row travels as one column, so none of its own names can clash
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_key"), F.col(f"`{time_col}`").alias("_time"), F.col(f"`{tie_col}`").alias("_tie"))
    free = F.col("_key").isNull() | F.col("_tie").isNull()
    bare, keyed = whole.where(free), whole.where(~free)
    if unique_ties:
        first = keyed.join(kept.select("_tie"), "_tie", "left_semi").select("_row")
    else:
        first = keyed.join(kept, _same(keyed, kept), "left_semi").dropDuplicates(["_key", "_time", "_tie"]).select("_row")
    return first.unionByName(bare.select("_row")).select("_row.*")
