"""Text as columns: cleaning, tokens, n-grams, term statistics and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.vectors import attribute_metadata, col
from sparkloom.operators.aggregates import document_frequency

#: Punctuation and digits; also read by RE2.
PUNCTUATION = r"[\p{P}\p{S}\p{N}]+"
_EMAIL = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+"
_URL = r"(?:(?:https?|ftp)://|www\.)[^\s<>\"]+|[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.(?:com|org|net|edu|gov|info|biz|io|ru|ua|de|fr|es|uk|am|su)(?:/[^\s<>\"]*)?"
_WORD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"
TOKEN = rf"(?:{_EMAIL})|(?:{_URL})|(?:{_WORD})"
URL_TOKEN = rf"^(?:{_URL})$"


def clean(text: Column, pattern: str = PUNCTUATION, replacement: str = " ") -> Column:
    """Every match of the pattern replaced; null stays null."""
    return F.regexp_replace(text, pattern, replacement)


def tokens(text: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    """Matches of the pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def without_urls(text: Column) -> Column:
    """The lower-cased words of a text, addresses of the web left out and mail addresses kept, joined by blanks."""
    return F.array_join(F.filter(tokens(text, TOKEN), lambda t: ~F.rlike(t, F.lit(URL_TOKEN))), " ")


def ngrams(words: Column, least: int = 1, most: int = 2, separator: str = " ") -> Column:
    """Runs of `least` to `most` words, the shorter runs first; a shorter array has none of a length. Null stays null."""

    # arrays are zipped with themselves, shifted, so that no step looks an array up by place for each word
    def of_length(n: int) -> Column:
        runs = words
        for k in range(2, n + 1):
            m = F.greatest(F.size(words) - (k - 1), F.lit(0))
            runs = F.zip_with(F.slice(runs, 1, m), F.slice(words, k, m), lambda a, b: F.concat_ws(separator, a, b))
        return runs

    return F.concat(*[of_length(n) for n in range(least, most + 1)])


def term_frequencies(df: DataFrame, tokens_col: str, thresholds: Sequence[float] = (0.0,), timestamp: str | None = None, corpus_length: int | None = None, separator: str = " ") -> DataFrame:
    """(Term, Freq[, Timestamp]): rows with the term over the corpus length, where that is above the term's threshold.

    The corpus length is the number of (row, distinct term) pairs unless given. A term of n words has the n-th
    threshold, or the last. timestamp: its greatest value among the term's rows. Null terms are left out.
    """
    own = df.select(*([col(timestamp).alias("__ts")] if timestamp else []), F.explode(F.array_distinct(F.filter(col(tokens_col), lambda t: t.isNotNull()))).alias("Term"))
    counts = own.groupBy("Term").agg(F.count("*").alias("__n"), *([F.max("__ts").alias("Timestamp")] if timestamp else []))
    if corpus_length is None:
        total = counts.agg(F.sum("__n").alias("__total"))  # one row
        counts = counts.crossJoin(F.broadcast(total))
    else:
        counts = counts.withColumn("__total", F.lit(corpus_length))
    length = F.size(F.split("Term", separator)) if len(thresholds) > 1 else F.lit(1)
    limit = F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.least(length, F.lit(len(thresholds))) - 1)
    found = counts.withColumn("Freq", F.col("__n") / F.col("__total")).where(F.col("Freq") > limit)
    return found.select("Term", "Freq", *(["Timestamp"] if timestamp else []))


def fit_vocabulary(df: DataFrame, tokens_col: str, size: int = 1 << 18, min_documents: int = 1, inherited: Sequence[str] = ()) -> list[str]:
    """The most frequent terms, at most `size`; ties by term.

    An inherited vocabulary keeps its places, of which those of terms that are not found any more are filled, in the
    order of frequency, by new ones.
    """
    ranked = document_frequency(df, tokens_col, min_documents).orderBy(F.desc("n"), "term").limit(size)
    terms = [r["term"] for r in ranked.collect()]
    if not inherited:
        return terms
    found, old = set(terms), list(inherited)
    fresh = iter([t for t in terms if t not in set(old)])
    kept = [t if t in found else next(fresh, t) for t in old]
    return (kept + list(fresh))[: max(size, len(old))]


def count_vectors(df: DataFrame, tokens_col: str, vocabulary: Sequence[str], output: str, name_attributes: bool = True) -> DataFrame:
    """`df` with a sparse vector of term counts; null arrays give zeros. The metadata names the terms, or only counts them."""
    from pyspark.ml.feature import CountVectorizerModel

    model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol="__tokens", outputCol=output)
    filled = df.withColumn("__tokens", F.coalesce(F.filter(col(tokens_col), lambda t: t.isNotNull()), F.array().cast("array<string>")))
    out = model.transform(filled).drop("__tokens")
    return out.withMetadata(output, attribute_metadata(vocabulary) if name_attributes else {"ml_attr": {"num_attrs": len(vocabulary)}})
