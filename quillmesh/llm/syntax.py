"""Problem 4: source files that do not parse, per file and as rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.source_hygiene import clean_path, language
from quillmesh.llm.syntax_lexers import LANGUAGES, verdict


def _judged(df: DataFrame, keys: list[str], path: str, text: str) -> DataFrame:
    """(*keys, lang, reason): ``reason`` is null for a valid file. Files of other languages are left out."""
    lang = language(clean_path(F.col(path)))
    rows = df.where((F.length(text) > 0) & lang.isin(*LANGUAGES)).select(*keys, lang.alias("lang"), F.col(text).alias("_t"))
    fields = [f.name + " " + f.dataType.simpleString() for f in df.select(*keys).schema]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[*keys, "lang"]].assign(reason=[verdict(lang, t) for lang, t in zip(batch["lang"], batch["_t"])])

    return rows.mapInPandas(work, f"{', '.join(fields)}, lang string, reason string")


def invalid(df: DataFrame, item: str, path: str, text: str) -> DataFrame:
    """(item, lang, reason) of every file that is not valid in the language of its path's extension.

    A null path, an unknown extension, and a null or empty text are never cases; repeated files are judged alike.
    """
    return _judged(df, [item], path, text).where(F.col("reason").isNotNull())


def rates(df: DataFrame, item: str, repository: str, path: str, text: str) -> DataFrame:
    """(repository, lang, files, invalid, rate): a repository's and language's files, each path counted once.

    A file scanned again counts once; if its scans differ, it is invalid when any of them is. The counts combine
    before the shuffle, so a repository with a third of all files is no heavier than another.
    """
    keyed = df.select(F.col(repository).alias("repository"), clean_path(F.col(path)).alias("path"), F.col(text).alias("text"))
    judged = _judged(keyed, ["repository", "path"], "path", "text")
    files = judged.groupBy("repository", "path", "lang").agg(F.max(F.col("reason").isNotNull().cast("int")).alias("bad"))
    out = files.groupBy("repository", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("invalid"))
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
