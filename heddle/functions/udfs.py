"""What built-in functions can't say: difference ratios, JSON-LD graphs. Arrow-batched."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """SCA10: twice the matched characters over all, by longest common blocks; null if either is null."""
    return F.pandas_udf(_ratios, "double")(a, b)


#: Letters that decomposition alone would lose (fixed values).
KEPT = str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE"})


def _ascii(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.translate(KEPT)).encode("ascii", "ignore").decode().casefold())


def ascii_folded(a: Column) -> Column:
    """General form of ``text.folded``: compatibility decomposition, then only ASCII, in lower case."""
    return F.pandas_udf(_ascii, "string")(a)


def nodes(text: str | None, kinds: set[str]) -> list[dict]:
    """All objects of a JSON-LD text, at any depth, whose type is one of ``kinds``; none for what can't be read."""
    try:
        left = [json.loads(text)] if text else []
    except ValueError:
        return []
    out = []
    while left:
        x = left.pop(0)
        if isinstance(x, dict):
            of = x.get("@type")
            if kinds & set(of if isinstance(of, list) else [of]):
                out.append(x)
            left[:0] = list(x.values())
        elif isinstance(x, list):
            left[:0] = x
    return out


def json_ld(rows: DataFrame, key: str, column: str, kinds: list[str], most: int = 20) -> DataFrame:
    """SCA38: a row for each typed object in a JSON-LD column, up to ``most`` a row: the key, its place, type, name and url."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["text"], strict=True):
                for i, x in enumerate(nodes(text, set(kinds))[:most]):
                    of = x["@type"]
                    said = lambda f, x=x: x[f] if isinstance(x.get(f), str) else None
                    out.append((k, i, of if isinstance(of, str) else of[0], said("name") or said("title"), said("url")))
            yield pd.DataFrame(out, columns=["k", "place", "type", "name", "url"])

    return rows.select(F.col(key).alias("k"), F.col(column).alias("text")).mapInPandas(run, f"k {kind}, place int, type string, name string, url string").withColumnRenamed("k", key)
