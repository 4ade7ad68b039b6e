"""Steps that no built-in function has, as Arrow-batched functions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All HTML entities decoded."""
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def decode_bytes(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else GBK, else Latin-1."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in ("utf-8", "gbk"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass
        return b.decode("latin-1")

    return content.map(one)
