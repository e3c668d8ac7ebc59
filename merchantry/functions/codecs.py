"""Bytes: character sets, compression, digests (F25-F27). Arrow UDFs only where Spark has no function."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decoder(charset: str) -> object:
    """A UDF from bytes in charset (gbk, gb2312, ...) to text; bytes that do not fit are replaced."""

    @F.pandas_udf(T.StringType())
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return decode


def encoder(charset: str) -> object:
    """A UDF from text to bytes in charset; characters that it has not are question marks."""

    @F.pandas_udf(T.BinaryType())
    def encode(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else s.encode(charset, "replace"))

    return encode


@F.pandas_udf(T.BinaryType())
def compressed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else zlib.compress(s.encode()))


@F.pandas_udf(T.StringType())
def decompressed(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.decompress(bytes(b)).decode("utf-8", "replace"))


def salted_hash(text: Column, salt: Column) -> Column:
    """sha1 of salt, md5 of the text, salt."""
    return F.sha1(F.concat(salt, F.md5(text.cast("binary")), salt).cast("binary"))
