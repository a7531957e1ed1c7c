"""Helpers of the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS


def plain(df: DataFrame) -> DataFrame:
    """Results in the types both engines share: decimals as doubles, integers as bigint, arrays of texts joined by ``|``."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        c = c.cast("double") if kind.startswith("decimal") or kind == "float" else c.cast("bigint") if kind in ("tinyint", "smallint", "int") else F.array_join(c, "|") if kind == "array<string>" else c
        out.append(c.alias(f.name))
    return df.select(*out)


def typed(sql: str, **kinds: str) -> str:
    """``sql`` with its columns cast: d double, n bigint, s varchar, t date, b boolean."""
    names = {"d": "DOUBLE", "n": "BIGINT", "s": "VARCHAR", "t": "DATE", "b": "BOOLEAN"}
    return f"SELECT {', '.join(f'CAST("{c}" AS {names[k]}) AS "{c}"' for c, k in kinds.items())} FROM ({sql})"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens_sql(c: str) -> str:
    """The telling words of a narration in DuckDB's SQL."""
    words = f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '\\w+'))"
    telling = f"list_filter({words}, lambda w: w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9]+'))"
    return f"CASE WHEN len({telling}) > 0 THEN {telling} ELSE {words} END"
