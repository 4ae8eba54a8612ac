"""Quality rules with a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are named sets of bits, so a new policy, or the question what a rule removes, needs
no second look at any text.

Defined cases: a null or empty text has no words and all counts 0, and fails `too_few_words`.
Repeated rows are judged each for itself. An empty table gives an empty ledger.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_text, raw_texts, text_bytes

WINDOW = 8
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, "
            "n_dup_lines bigint, n_repeat_words bigint, n_upper bigint, n_same_words bigint")

# Rules by bit. A rule is a condition on the measurements; true means failed.
RULES = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "capitals": "2 * n_upper > word_chars",
    "too_many_words": "n_words > 100000",
    "stutter": "3 * n_same_words > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

# Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_words",
           "long_words", "capitals", "stutter"),
    "strict": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_SPACE = _flags(SPACES)
_SYMBOL = _flags(SYMBOLS)
_UPPER = _flags(bytes(range(65, 91)))
_INNER = _flags(bytes(range(0x80, 0xC0)))  # bytes after the first of a code point


def _weights(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


_WEIGHTS = _weights(WINDOW)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of `window` words that occurs twice or more in the text.

    Windows with equal hashes are compared word for word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes += (ids[k:k + n] + np.uint64(1)) * _WEIGHTS[k]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    either = np.zeros(n, bool)
    either[order[1:][same]] = True
    either[order[:-1][same]] = True
    starts = np.flatnonzero(either)
    rows = ids[starts[:, None] + np.arange(window)]
    _, place, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    starts = starts[count[place.ravel()] > 1]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def _measure(texts: pa.StringArray) -> list:
    raw, places = text_bytes(texts)

    filled = np.flatnonzero(np.diff(places))

    def count(table: np.ndarray) -> np.ndarray:
        found = np.zeros(len(texts), np.int64)
        if len(filled):
            found[filled] = np.add.reduceat(table[raw], places[:-1][filled], dtype=np.int64)
        return found

    chars = np.diff(places) - count(_INNER) - count(_SPACE)
    n_words, n_lines, n_dup, n_repeat, n_same = [], [], [], [], []
    for text in raw_texts(texts):
        words = text.split()
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        n_words.append(len(words))
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
        n_repeat.append(repeated_words(words))
        n_same.append(sum(map(operator.eq, words, words[1:])))
    return [n_words, chars, count(_SYMBOL), n_lines, n_dup, n_repeat, count(_UPPER), n_same]


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The `keep` columns and the measurements of every text, in one map step."""
    return per_text(docs, keep, text, lambda: _measure, MEASURES)


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The measurements of every document and `failures`, one bit per failed rule of `RULES`."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0))
            for name, rule in RULES.items()]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measure(docs, keep, text).withColumn("failures", failures.cast("bigint"))


def kept(policy: str = "v1") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy does, from the bits alone.

    One row per rule: `n_failed` documents fail it, `n_only` fail no other rule of the policy (so
    they would be kept without it), `n_rejected` fail the policy. The bit patterns are counted in
    the map tasks; there are at most 2^rules of them.
    """
    patterns = entries.groupBy(
        F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(
            F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit"))
                                for name in POLICIES[policy]]))
    one = F.col("n")
    return (patterns.select("bits", "n", rules.alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, one).otherwise(0))
                 .alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), one).otherwise(0)).alias("n_only"),
                 F.sum(F.when(F.col("bits") != 0, one).otherwise(0)).alias("n_rejected")))


def filter_documents(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their columns.

    The columns travel through the map step with the text, so no join is needed.
    """
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    judged = ledger(numbered, numbered.columns, f"c{names.index(text)}").filter(kept(policy))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
