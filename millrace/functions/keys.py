"""Text keys of different strength.

``native`` keys stay in JVM code and take ``lower`` with the German sharp s spelt out for
case folding, without NFKC. They equal the exact ones on text that NFKC leaves alone and whose only folding beyond
lower case is that letter; ``native_is_exact`` counts the rows for which they don't. ``exact`` keys are
Arrow UDFs for any text.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.isspace has it.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
KINDS = ("weak", "strong", "alnum", "model")


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def compact(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, SPACE, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def key_weak(text: Column) -> Column:
    """Folded, without white space."""
    return compact(folded(text))


def key_strong(text: Column) -> Column:
    """Folded, without white space and punctuation; symbols stay."""
    return F.regexp_replace(folded(text), r"[\p{IsWhite_Space}\x1c-\x1f\p{P}]", "")


def key_alnum(text: Column) -> Column:
    """Folded, letters and numbers only."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}]", "")


def model_text(text: Column) -> Column:
    return strip(folded(text))


NATIVE = {"weak": key_weak, "strong": key_strong, "alnum": key_alnum, "model": model_text}


def exact_key(text: str | None, kind: str) -> str | None:
    """NFKC and full case folding, then what the kind of key leaves."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text).casefold()
    if kind == "model":
        return text.strip()
    keep = {
        "weak": lambda c: not c.isspace(),
        "strong": lambda c: not c.isspace() and not unicodedata.category(c).startswith("P"),
        "alnum": str.isalnum,
    }[kind]
    return "".join(filter(keep, text))


def exact(text: Column, kind: str) -> Column:
    @F.pandas_udf(T.StringType())
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: exact_key(x, kind))

    return key(text)


def native_is_exact(df: DataFrame, text: str, kind: str) -> DataFrame:
    """One row: how many texts have a native key other than the exact one."""
    differ = ~NATIVE[kind](F.col(text)).eqNullSafe(exact(F.col(text), kind))
    return df.agg(F.count_if(differ).alias("n_different"))
