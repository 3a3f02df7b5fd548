"""Text expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
SENTENCE_BREAK = r"(?<=[.!?。！？])\s+"

#: A tokenizer for search: a text column in, an array of terms out.
Analyzer = Callable[[Column], Column]
#: A token counter: a text column in, a count out.
Counter = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Lower-case words of a text; null has none. The default analyzer, a stand-in for a morphological one."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def lexemes(text: Column, analyzer: Analyzer = words) -> Column:
    """Distinct terms in the order of their first occurrence."""
    return F.array_distinct(analyzer(text))


def token_count(text: Column) -> Column:
    """Words and other visible characters; null counts 0. The default counter, a stand-in for a model's tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed sentences without blank ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK, -1), lambda s: F.trim(s, F.lit(" \t\n\r")))
    return F.filter(parts, lambda s: s != "")


def snippet(text: Column, chars: int = 300) -> Column:
    """The first ``chars`` characters, with dots if there are more."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def truncate_tokens(text: Column, limit: Column) -> Column:
    """A text cut after its first ``limit`` tokens, what stands between them kept."""
    mark = "\x01"
    marked = F.regexp_replace(text, "(" + TOKEN + ")", "$1" + mark)
    head = F.call_function("substring_index", marked, F.lit(mark), F.greatest(limit, F.lit(0)).cast("int"))
    cut = F.replace(head, F.lit(mark), F.lit(""))
    return F.when(token_count(text) <= limit, text).otherwise(cut)
