"""Control parameters of clustering, one a line: k = 4, decay = 0.2, label:0 = trolls; # begins a comment, blank lines are none."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = r"^\s*(k|decay|label\s*:\s*\d+)\s*=\s*(.*?)\s*$"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """(line, key, value, error): key is k, decay or label:<index>, in lower case; error is null for a good line."""
    low: Column = F.lower(F.trim(F.split(F.col(line), "#")[0]))
    key = F.regexp_replace(F.regexp_extract(low, _LINE, 1), r"\s", "")
    value = F.regexp_extract(low, _LINE, 2)
    number = F.when(key == "k", value.try_cast("int").cast("double")).when(key == "decay", value.try_cast("double"))
    error = F.when(key == "", F.concat(F.lit("Invalid parameter line: "), low)).when(key.isin("k", "decay") & number.isNull(), F.concat(F.lit("Not a number: "), value))
    return lines.where(F.col(line).isNotNull()).where(low != "").select(F.col(line).alias("line"), key.alias("key"), value.alias("value"), error.alias("error"))


def parameters(lines: DataFrame, line: str = "line") -> DataFrame:
    return parsed(lines, line).where("error is null").select("key", "value")


def errors(lines: DataFrame, line: str = "line") -> DataFrame:
    return parsed(lines, line).where("error is not null").select("line", "error")


def read(lines: Iterable[str]) -> dict[str, str]:
    """The parameters of lines at hand, as parameters() gives them; of several of a key the last counts."""
    out = {}
    for line in lines:
        low = line.partition("#")[0].strip().lower()
        if match := re.match(_LINE, low):
            key, value = re.sub(r"\s", "", match[1]), match[2]
            try:
                if key in ("k", "decay"):
                    (int if key == "k" else float)(value)
            except ValueError:
                continue
            out[key] = value
    return out
