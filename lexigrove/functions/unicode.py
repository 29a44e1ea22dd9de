"""Unicode forms, which the JVM side has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: str, form: str = "NFC", fold: bool = False) -> str:
    """A text in a Unicode form; with ``fold`` case-folded between two passes of NFC."""
    out = unicodedata.normalize(form, text)
    return unicodedata.normalize("NFC", out.casefold()) if fold else out


def normalized(text: Column, form: str = "NFC", fold: bool = False) -> Column:
    """``canonical`` as a column; the package must be at hand in workers (``functions.shipping.ship``)."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: canonical(x, form, fold), na_action="ignore")

    return run(text)
