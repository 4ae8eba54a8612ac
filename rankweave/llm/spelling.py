"""Spelling variants: words one edit apart, found by walking a trie of all words level by level.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced character
turns one into the other. Two such words agree on at least half of the longer one, from the front or
from the back. So there are two tries, of the words and of the words reversed, and an edit is only
tried behind the first half of a word, where tries branch little.

A trie is a table of edges `(parent, label, child)` over the cluster. Only nodes where words part or
end are kept, so an edge's label may be several characters, and a long word has few edges. The
frontier is a table of states: a word, the position up to which it is used, the node reached, and
one edit made. States start at the nodes of the word's own path, from which an edge with another
first character is an insertion or a replacement, and skipping a character is a deletion. Then, level
by level, states are joined with the edges that go on with the word's next characters, and written
to the shared folder; most find none. Where a word and an edge's word end together, the two are
near; each pair is compared once more, exactly.

A node is named by a hash of its characters, so states are 64-bit numbers and joins hash well. Two
nodes of one name would only add states. A node has at most a few edges per character of the
alphabet, so a node that many words share multiplies rows by no more than that, and Spark splits it.

Each word points to its most frequent near word, if that is `ratio` times as frequent. Frequencies
grow along these pointers by that factor, so they form short chains; their ends are found by
doubling.

Defined cases: null and empty texts have no words. Words of a row with a null id are counted as they
are. Repeated rows count each. A very long run of letters is a word like any other; its path is
hashed in one pass. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, materialize
from .common import as_texts, raw_texts, slices

LEAST_CHARS = 6
LEAST_COUNT = 5
DROP_EVERY = 199        # one run in so many loses a character
RATIO = 5
HELD_WORDS = 200_000    # a task counts so many words before it passes them on

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _count(least: int, drop_every: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def passed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts = as_texts(batch.column(1))
            for start, stop in slices(texts):
                ids = batch.column(0).slice(start, stop - start).to_pylist()
                for doc_id, raw in zip(ids, raw_texts(texts.slice(start, stop - start))):
                    # Bytes are lowered in A-Z only.
                    found = Counter(runs.findall(raw.lower().decode()))
                    if doc_id is None:
                        counts.update(found)
                        continue
                    begun = zlib.crc32(f"{doc_id}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), begun)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield passed(counts)
                    counts.clear()
        yield passed(counts)

    return run


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
                drop_every: int = DROP_EVERY) -> DataFrame:
    """`word`, `n`: the words that are long and frequent enough."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))
    return (rows.mapInArrow(_count(least_chars, drop_every), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def first_edit(length: int) -> int:
    """Where the edits of a word of this length may begin: ceil((length - 1) / 2)."""
    return length // 2


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each word's path behind its first half, with the character that follows."""
    for batch in batches:
        columns = [[] for _ in range(6)]
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for back in (False, True):
                path = word[::-1] if back else word
                node, size = int(back) + 1, len(path)
                least = max(0, first_edit(size - 1))  # also for words one character shorter
                nodes, name = [], node
                for at, c in enumerate(path):
                    if at >= least:
                        nodes.append(name)
                    name = (name * _BASE + ord(c)) % _PRIME
                nodes.append(name)
                for at, node in enumerate(nodes, least):
                    row = (node, at, path[at] if at < size else "", word, back,
                           n if at == size else None)
                    for column, x in zip(columns, row):
                        column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["node", "at", "next", "word", "back", "end_n"])


def paths(words: DataFrame) -> DataFrame:
    """`path` (the word, reversed if `back`), `back`, `n` and `stops`: the kept nodes of the path as
    `(at, node, end_n)`; `end_n` is the count of the word that ends at the node, if any."""
    keyed = words.mapInArrow(_positions, "node bigint, at int, next string, word string, "
                                         "back boolean, end_n bigint").withColumn(
        "key", F.xxhash64("word")).withColumn("size", F.length("word")).drop("word")
    keyed = materialize(keyed, "positions")
    kept = keyed.groupBy("node").agg(
        F.min("next").alias("least"), F.max("next").alias("most"),
        F.max("end_n").alias("end_n")).filter("least <> most OR least = ''").select("node", "end_n")
    stops = keyed.drop("end_n").join(kept, "node").groupBy("key", "size", "back").agg(
        F.array_sort(F.collect_list(F.struct("at", "node", "end_n"))).alias("stops"))
    told = words.select("word", "n", F.xxhash64("word").alias("key"),
                        F.length("word").alias("size"))
    done = materialize(told.join(stops, ["key", "size"]).select(
        F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("path"),
        "back", "n", "size", "stops"), "paths")
    discard(keyed)
    return done


def _rest(path: str, at: str, label: str) -> Column:
    """Whether a path goes on with a label from a place."""
    return F.expr(f"substring({path}, {at} + 1, length({label})) = {label}")


def edges(found: DataFrame) -> DataFrame:
    """`parent`, `label`, `child`, and `end_word`, `end_n` of the word that ends at the child."""
    pairs = found.select("path", "back", "n", F.explode(F.arrays_zip(
        F.slice("stops", 1, F.size("stops") - 1).alias("a"),
        F.slice("stops", 2, F.size("stops") - 1).alias("b"))).alias("e"))
    word = F.when(F.col("back"), F.reverse("path")).otherwise(F.col("path"))
    last = F.col("e.b.at") == F.length("path")
    return (pairs.select(
        F.col("e.a.node").alias("parent"), F.col("e.b.node").alias("child"),
        F.expr("substring(path, e.a.at + 1, e.b.at - e.a.at)").alias("label"),
        F.when(last, word).alias("end_word"), F.when(last, F.col("n")).alias("end_n"))
        .groupBy("parent", "label", "child")
        .agg(F.max("end_word").alias("end_word"), F.max("end_n").alias("end_n")))


def near_words(words: DataFrame) -> DataFrame:
    """`word`, `near`, `near_n`: every pair of words one edit apart, in both directions."""
    found = paths(words)
    trie = materialize(edges(found), "edges").withColumn("first", F.substring("label", 1, 1))
    state = found.select("path", "back", "size", F.explode("stops").alias("s")).select(
        "path", "back", "size", F.col("s.at").alias("at"), F.col("s.node").alias("node"),
        F.col("s.end_n").alias("node_n")).filter(F.expr("at >= size DIV 2"))
    state = state.withColumn("next", F.expr("substring(path, at + 1, 1)"))

    # One character of the word skipped; of equal ones the last.
    skipped = state.filter("at < size AND (at = size - 1 OR next <> substring(path, at + 2, 1))")
    shorter = F.expr("substring(path, 1, size - 1)")
    ended = skipped.filter("at = size - 1 AND node_n IS NOT NULL").select(
        "path", "back", F.when(F.col("back"), F.reverse(shorter)).otherwise(shorter).alias("near"),
        F.col("node_n").alias("near_n"))
    states = skipped.filter("at < size - 1").select(
        "path", "back", "size", (F.col("at") + 1).alias("used"), "node",
        F.lit(None).cast("string").alias("end_word"), F.lit(None).cast("bigint").alias("end_n"))

    # Another first character: inserted before the word's next one, or in place of it.
    other = state.join(trie, (F.col("node") == F.col("parent")) & (F.col("next") != F.col("first")))
    put = F.expr("substring(path, at + 1, length(label) - 1) = substring(label, 2)")
    turned = F.expr("at < size AND substring(path, at + 2, length(label) - 1) = "
                    "substring(label, 2)")
    steps = F.filter(F.array(F.when(put, F.lit(0)), F.when(turned, F.lit(1))),
                     lambda x: x.isNotNull())
    moved = other.select("*", F.explode(steps).alias("step")).select(
        "path", "back", "size", (F.col("at") + F.length("label") - 1 + F.col("step")).alias("used"),
        F.col("child").alias("node"), "end_word", "end_n")
    frontier = materialize(states.unionByName(moved).filter("used <= size"), "frontier")

    near = [materialize(ended.unionByName(_ended(frontier)), "near")]
    while not frontier.filter("used < size").isEmpty():
        open_ = frontier.filter("used < size").select(
            "path", "back", "size", "used", "node",
            F.expr("substring(path, used + 1, 1)").alias("next"))
        on = trie.join(open_, (F.col("node") == F.col("parent")) & (F.col("first") == F.col("next")))
        further = materialize(on.filter(_rest("path", "used", "label")).select(
            "path", "back", "size", (F.col("used") + F.length("label")).alias("used"),
            F.col("child").alias("node"), "end_word", "end_n"), "frontier")
        discard(frontier)
        frontier = further
        near.append(materialize(_ended(frontier), "near"))
    pairs = near[0]
    for more in near[1:]:
        pairs = pairs.unionByName(more)
    word = F.when(F.col("back"), F.reverse("path")).otherwise(F.col("path"))
    return pairs.select(word.alias("word"), "near", "near_n").distinct().filter(
        F.levenshtein("word", "near", 1) == 1)


def _ended(frontier: DataFrame) -> DataFrame:
    return frontier.filter("used = size AND end_word IS NOT NULL").select(
        "path", "back", F.col("end_word").alias("near"), F.col("end_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` of every word with a `form`: the end of its chain of forms."""
    chain = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = chain.select(F.col("word").alias("_at"), F.col("root").alias("_up"))
        longer = chain.join(up, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_up", "root").alias("root"),
            F.col("_up").isNotNull().alias("moved"))
        done = materialize(longer, "roots")
        discard(chain)
        chain = done.drop("moved")
        if done.filter("moved").isEmpty():
            return chain


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of every word of `words` (`word`, `n`)."""
    words = materialize(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    frequent = -F.col("best.m") >= ratio * F.col("n")
    told = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
