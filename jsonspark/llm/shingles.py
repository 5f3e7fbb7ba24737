"""Word shingles as arrays of hashes, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 5


def plain_words(text: Column) -> Column:
    """Words of letters and digits in lower case; an empty array for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def kept_whole(value: Column) -> Column:
    """The value itself, in a form that the optimizer neither copies nor moves.

    A filter that is pushed below a projection takes the projected expressions
    along; inside a lambda they would be worked out anew for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_shingles(df: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Adds n_words and sh, the hash of every run of ``size`` words (of all words if there are fewer)."""
    df = df.withColumn("__h", kept_whole(F.transform(plain_words(F.col(text_col)), lambda w: F.xxhash64(w))))
    at = lambda i, k: F.get(F.col("__h"), i + k)
    shingles = F.transform(
        F.slice("__h", F.lit(1), F.greatest(F.size("__h") - size + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i, k) for k in range(1, size)])
    )
    whole = F.when(F.size("__h") > 0, F.array(F.xxhash64(F.array_join(F.col("__h").cast("array<string>"), " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("n_words", F.size("__h")).withColumn("sh", kept_whole(F.when(F.size("__h") >= size, shingles).otherwise(whole))).drop("__h")


def window(sh: Column, start: Column, words: Column, size: int = SIZE) -> Column:
    """The shingles inside the words [start, start + words)."""
    return F.slice(sh, start + 1, F.greatest(words - size + 1, F.lit(1)))
