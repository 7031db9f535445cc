"""Search over a table's text: exact (prefix and substring) and fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUZZY_LEAST = 0.3


def _trigrams(c: Column) -> Column:
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def _starts(words: Column, prefix: str) -> Column:
    return F.exists(words, lambda w: w.startswith(prefix))


def similarity(word: Column, query: Column) -> Column:
    """The larger of trigram Jaccard and one less relative edit distance."""
    a, b = _trigrams(word), _trigrams(query)
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    edit = 1 - F.levenshtein(word, query) / F.greatest(F.length(word), F.length(query))
    return F.greatest(jaccard, edit)


def search(rows: DataFrame, text: Column, key: Column, query: str, limit: int | None = 20, fuzzy: bool = False) -> DataFrame:
    """``rows`` with ``_score``, best first, ties by key; without a limit all that match, in no order."""
    low, wanted = F.lower(text), query.lower().split()
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    exact = low.contains(query.lower())
    every = F.lit(bool(wanted))
    for q in wanted:
        every = every & (_starts(words, q) | low.contains(q))
    score = F.when(exact | every, F.lit(1.0))
    if fuzzy:
        near = F.aggregate(words, F.lit(0.0), lambda m, w: F.greatest(m, similarity(w, F.lit(query.lower()))))
        score = F.coalesce(score, F.when(near >= FUZZY_LEAST, near))
    found = rows.withColumn("_score", score).filter("_score is not null")
    return found if limit is None else found.orderBy(F.desc("_score"), key).limit(limit)
