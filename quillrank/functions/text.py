"""Tokens and list tails, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms, by language.
STOPWORDS = {
    "en": [
        "a", "an", "the", "and", "or", "but", "if", "of", "at", "by", "for", "with", "about", "into", "to", "from",
        "in", "on", "off", "over", "under", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does",
        "did", "has", "have", "had", "it", "its", "this", "that", "these", "those", "as", "s", "t",
    ],
    "da": [
        "og", "i", "jeg", "det", "at", "en", "den", "til", "er", "som", "paa", "de", "med", "han", "af", "for", "ikke",
        "der", "var", "mig", "sig", "men", "et", "har", "om", "vi", "min", "havde", "ham", "hun", "nu", "over", "da",
        "fra", "du", "ud", "sin", "dem", "os", "op", "man", "hans", "hvor", "eller", "hvad", "skal", "selv", "her",
        "alle", "vil", "blev", "kunne", "ind", "naar", "vaere", "dog",
    ],
}
# letters, letter-like numerals and other numerals; decimal digits separate
_WORD = r"([\p{L}\p{Nl}\p{No}]+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str, language: str = "en", drop_stopwords: bool = True, min_length: int = 2) -> Column:
    """Lower-case runs of letters, without short ones and stop words; ``[]`` for NULL."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(_WORD), F.lit(1))
    words = F.filter(words, lambda w: F.length(w) >= min_length)
    if drop_stopwords:
        stop = STOPWORDS.get(language, STOPWORDS["en"])
        words = F.filter(words, lambda w: ~w.isin(stop))
    return F.coalesce(words, F.array().cast("array<string>"))


def index_text(*fields: Column | str) -> Column:
    """The fields one after another, a blank between, NULL as empty."""
    return F.concat_ws(" ", *[F.coalesce(_col(f), F.lit("")) for f in fields])


def last_n(items: Column | str, n: int) -> Column:
    """The last ``n`` elements in order; shorter arrays whole."""
    items = _col(items)
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def string_list(items: Column | str) -> Column:
    """``array<string>`` without NULLs; NULL as empty."""
    return F.coalesce(F.filter(_col(items).cast("array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))
