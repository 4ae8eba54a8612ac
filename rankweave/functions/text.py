"""Column expressions on text: analyzers, document bodies and query wrapping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Analyzer = Callable[[Column], Column]

# The token patterns and the instruction put before a query to be embedded.
WORD_PATTERN = r"[\p{L}\p{N}]+"
ASCII_PATTERN = r"[a-z0-9]+"
QUERY_TASK = "Given a search query, retrieve relevant documents that answer the query"


def words(text: Column) -> Column:
    """Lowercase runs of letters and digits in any script, as an array."""
    return _matches(text, WORD_PATTERN)


def ascii_words(text: Column) -> Column:
    """Lowercase runs of a-z and 0-9, as an array."""
    return _matches(text, ASCII_PATTERN)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def document_body(title: Column, text: Column, body: Column | None = None) -> Column:
    """Title and text on separate lines; `body` stands in for a missing text."""
    main = non_empty(text)
    if body is not None:
        main = F.coalesce(main, non_empty(body))
    return F.concat_ws("\n", non_empty(title), main)


def query_text(text: Column, title: Column | None = None) -> Column:
    """The text of a query, or its title; null when both are empty."""
    if title is None:
        return non_empty(text)
    return F.coalesce(non_empty(text), non_empty(title))


def query_instruction(query: Column, task: str = QUERY_TASK) -> Column:
    """The form in which a query, unlike a document, goes to the embedding model."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def run_starts(ordered: Column) -> Column:
    """Where each run of equal values starts in a sorted array of strings, counted from 0."""
    size = F.size(ordered)
    previous = F.slice(F.concat(F.array(F.lit(None).cast("string")), ordered), F.lit(1), size)
    index = F.slice(F.sequence(F.lit(0), size), F.lit(1), size)
    changes = F.zip_with(ordered, previous, lambda cur, prev: ~cur.eqNullSafe(prev))
    return F.filter(F.zip_with(index, changes, lambda i, new: F.when(new, i)),
                    lambda i: i.isNotNull())


def run_lengths(starts: Column, size: Column) -> Column:
    """Length of each run, from where the runs start and the size of the whole array."""
    ends = F.slice(F.concat(F.slice(starts, F.lit(2), size + 1), F.array(size)),
                   F.lit(1), F.size(starts))
    return F.zip_with(starts, ends, lambda start, end: (end - start).cast("long"))
