"""Values of written numerals and of constants named in texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The digits of Chinese numerals, and their units from the greatest.
DIGITS = {"〇": 0, "零": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, **{str(i): i for i in range(10)}}
UNITS = [("億亿", 10**8), ("萬万", 10**4), ("千", 1000), ("百", 100), ("十", 10)]
SIGNS = "".join(DIGITS) + "".join(names for names, _ in UNITS)


def numeral_value(text: str | None) -> int | None:
    """Value of a numeral; None if another character occurs or nothing is left.

    The last of the greatest units splits a numeral: what stands before counts so many of it."""
    if not text or any(c not in SIGNS for c in text):
        return None
    for names, size in UNITS:
        at = max(text.rfind(c) for c in names)
        if at >= 0:
            many, rest = text[:at], text[at + 1 :]
            return (numeral_value(many) if many else 1) * size + (numeral_value(rest) or 0)
    return int("".join(str(DIGITS[c]) for c in text))


@F.pandas_udf(LongType())
def numeral_value_udf(s: pd.Series) -> pd.Series:
    return s.map(numeral_value).astype("Int64")


def constant(text: Column) -> tuple[Column, Column]:
    """(name, numeral) of a sentence that names something and ends its first clause with a numeral."""
    pattern = rf"^([^，,。；;：:{SIGNS}]+?)([{SIGNS}]+)(?:[。；;，,]|$)"
    bare = F.regexp_replace(text, "。$", "")
    return F.trim(F.regexp_extract(bare, pattern, 1)), F.regexp_extract(bare, pattern, 2)


def extract_constants(spans):
    """First constant of each (source, name) in spans (source, id, kind, text) of the kind ``constant``."""
    from stemma.operators.aggregates import first_by_key

    name, numeral = constant(F.col("text"))
    found = spans.where("kind = 'constant'").select("source", F.col("id").alias("span"), name.alias("name"), numeral.alias("numeral")).where("name != '' AND numeral != ''")
    return first_by_key(found.withColumn("value", numeral_value_udf("numeral")), ["source", "name"], ["span"])
