"""Unpack ``cpu=8,mem=64G,gres/gpu=2`` strings into one numeric column per resource."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that always get a column, and the keys that are used up rather than held.
DECLARED_KEYS = ["billing", "cpu", "energy", "gpu", "mem", "node"]
CONSUMED = ["energy", "billing"]


def to_number(text: Column, strict: bool = True) -> Column:
    """Number without its trailing G, M or T, in gigabytes: T counts 1024, M counts 1/1024, anything else 1.

    With ``strict`` other text raises an error; without it the result is null.
    """
    digits = F.rtrim(text, F.lit("GMT"))
    number = digits.cast("double") if strict else digits.try_cast("double")
    return (
        F.when(text.endswith("T"), number * 1024.0).when(text.endswith("M"), number / 1024.0).otherwise(number)
    )


def column_name(key: str) -> str:
    return ("consumed_" if key in CONSUMED else "allocated_") + key


def unpack(
    df: DataFrame,
    column: str = "allocated_resources",
    keys: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Replace the string column by one column per key: the first value of the key, null if there is none.

    Without ``keys`` all keys of the data are used (one job looks them up), next to the declared ones. Works inside the row
    with plain string search: no explode, no shuffle, no join. ``gpu`` stands for any ``gres...`` key; an entry without
    ``=`` has no value. The steps are separate projections, so that each piece of text is cut out once.
    """
    keys = all_keys(df, column) if keys is None else keys
    text = F.concat(F.lit(","), F.col(column), F.lit(","))
    found, entry, value, numbers = {}, {}, {}, {}
    for i, k in enumerate(keys):
        starts = [",gres", ",gpu=", ",gpu,"] if k == "gpu" else [f",{k}=", f",{k},"]
        places = [F.nullif(F.instr(text, F.lit(s)), F.lit(0)) for s in starts]
        found[f"_at_{i}"] = F.least(*places)
        entry[f"_entry_{i}"] = F.substring_index(F.substr(F.col(column), F.col(f"_at_{i}")), ",", 1)
        sign = F.instr(F.col(f"_entry_{i}"), F.lit("="))
        value[f"_text_{i}"] = F.when(sign > 0, F.nullif(F.substr(F.col(f"_entry_{i}"), sign + 1), F.lit("")))
        numbers[column_name(k)] = to_number(F.col(f"_text_{i}"), strict)
    return (
        df.withColumns(found).withColumns(entry).withColumns(value).withColumns(numbers)
    ).drop(column, *found, *entry, *value)


def entries(df: DataFrame, column: str = "allocated_resources", strict: bool = True) -> DataFrame:
    """Long form: one row per entry with its place, key and number, next to the other columns."""
    pair = F.split("_entry", "=", 2)
    key = F.get(pair, 0)
    return (
        df.select(
            *[c for c in df.columns if c != column], F.posexplode(F.split(column, ",")).alias("place", "_entry")
        )
        .where(F.col("_entry") != "")
        .withColumns(
            {
                "key": F.when(key.startswith("gres"), "gpu").otherwise(key),
                "value": to_number(F.get(pair, 1), strict),
            }
        )
        .drop("_entry")
    )


def keys_in(df: DataFrame, column: str = "allocated_resources") -> DataFrame:
    """Distinct keys of the data, with ``gres...`` folded into ``gpu``.

    The values are cut out of the text first. Of what is left there are few distinct ones, and only these are split.
    """
    shapes = df.select(F.regexp_replace(column, "=[^,]*", "=").alias("_shape")).distinct()
    key = F.substring_index("_entry", "=", 1)
    return (
        shapes.select(F.explode(F.split("_shape", ",")).alias("_entry")).where(F.col("_entry") != "")
        .select(F.when(key.startswith("gres"), "gpu").otherwise(key).alias("key")).distinct()
    )


def discover_keys(df: DataFrame, column: str = "allocated_resources") -> list[str]:
    """All keys of the data, however many. They become columns, so their number is that of the result's columns."""
    return sorted(r[0] for r in keys_in(df, column).collect())


def all_keys(df: DataFrame, column: str = "allocated_resources") -> list[str]:
    """The declared keys, which always have a column, and all others the data hold."""
    return sorted({*DECLARED_KEYS, *discover_keys(df, column)})


def check_keys(df: DataFrame, keys: Sequence[str], column: str = "allocated_resources") -> None:
    """Raise if the data hold a key that is not in ``keys``, so that none is lost unnoticed."""
    missing = set(discover_keys(df, column)).difference(keys)
    if missing:
        raise ValueError(f"resource keys without a column: {', '.join(sorted(missing))}")


def pivot_entries(
    long: DataFrame, row_keys: Sequence[str], keys: Sequence[str] | None = None
) -> DataFrame:
    """Long form back to one row per ``row_keys``: the first value of each key, null if absent.

    Without ``keys`` the declared ones and all others of the data become columns.
    """
    if keys is None:
        keys = sorted({*DECLARED_KEYS, *(r[0] for r in long.select("key").distinct().collect())})
    pivoted = long.groupBy(*row_keys).pivot("key", list(keys))
    return pivoted.agg(F.min_by("value", "place"))
