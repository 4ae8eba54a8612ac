"""Chat formatting with a grammar round trip, by DataFrame functions only.

A conversation is rendered as

    <|im_start|>ROLE, a line feed, TEXT<|im_end|>, a line feed

for each turn. The parser is deterministic: it cuts at every start mark, and each piece must be a
role up to the first line feed and a text up to the one end mark, which stands last. Then one
backslash is taken out of every `<\\|` (with any number of backslashes), and in roles `\\n` is read as
a line feed and `\\\\` as a backslash.

Rendering is checked by parsing it again. Conversations whose turns don't come back identical are
rendered with escapes: in texts a backslash goes into every `<|` that has a bar behind any number of
backslashes, in roles backslashes and line feeds are written out as well. What still differs is an
error.

Defined cases: null roles and texts are empty. Turns with equal numbers are ordered by role and
text, null numbers come first. Rows with a null conversation id form one conversation. A repeated
row is a turn of its own. Each conversation is one output row, as it is one training example.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"),
                     F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A backslash pair is one backslash, backslash-n a line feed; pairs are parted first.
    pairs = F.split(role, r"\\\\")
    return unescape_text(F.array_join(F.transform(
        pairs, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\"))


def render(turns: Column, escaped: bool) -> Column:
    """The text of turns given as an array of (role, text)."""
    def one(turn: Column) -> Column:
        role, text = turn["role"], turn["text"]
        if escaped:
            role, text = escape_role(role), escape_text(text)
        return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def _pieces(formatted: Column) -> Column:
    """What stands behind each start mark; the first is what stands before the first mark."""
    return F.split(formatted, r"<\|im_start\|>")


def _well_formed(piece: Column) -> Column:
    body = F.substring_index(piece, END, 1)
    return (piece == F.concat(body, F.lit(END + "\n"))) & F.contains(body, F.lit("\n"))


def _role(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _text(piece: Column) -> Column:
    """The text as written, escapes included."""
    return F.substring_index(piece.substr(F.length(_role(piece)) + 2, F.length(piece)), END, 1)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, or null if it doesn't follow the grammar."""
    pieces = _pieces(formatted)
    turns = F.slice(pieces, F.lit(2), F.size(pieces))
    sound = (F.element_at(pieces, 1) == "") & F.forall(turns, _well_formed)
    return F.when(sound, F.transform(turns, lambda p: F.struct(
        unescape_role(_role(p)).alias("role"), unescape_text(_text(p)).alias("text"))))


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """(start, length) in code points, from 0, of the text of every turn of a role."""
    pieces = _pieces(formatted)
    turns = F.slice(pieces, F.lit(2), F.size(pieces))
    mark = len(START)
    walked = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"),
                 F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda state, p: F.struct(
            (state["at"] + mark + F.length(p)).alias("at"),
            F.when(unescape_role(_role(p)) == role, F.concat(state["spans"], F.array(F.struct(
                (state["at"] + mark + F.length(_role(p)) + 1).alias("start"),
                F.length(_text(p)).alias("length")))))
            .otherwise(state["spans"]).alias("spans")))
    return walked["spans"]


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the spans, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(
        formatted.substr(s["start"] + 1, s["length"]))), "")


def conversations_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id` and `turns`, an array of (role, text) in order."""
    empty = F.lit("")
    return (rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id"))
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col(f"`{turn}`").alias("turn"),
                F.coalesce(F.col(f"`{role}`").cast("string"), empty).alias("role"),
                F.coalesce(F.col(f"`{text}`").cast("string"), empty).alias("text")))).alias("t"))
            .select("conv_id", F.transform("t", lambda x: F.struct(
                x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))


def format_conversations(rows: DataFrame, **names: str) -> DataFrame:
    """`conv_id`, `formatted`, `escaped` and `loss_spans` of every conversation.

    Each rendering in turn is parsed and compared with the source; the first that comes back
    identical is taken.
    """
    found = conversations_of(rows, **names)
    source = F.col("turns")
    tried = found
    for i, escaped in enumerate((False, True)):
        tried = tried.withColumn(f"r{i}", render(source, escaped))

    def same(i: int) -> Column:
        return F.coalesce(parse(F.col(f"r{i}")) == source.cast(TURN), F.lit(False))
    chosen = reduce(lambda rest, i: F.when(same(i), F.struct(
        F.col(f"r{i}").alias("formatted"), F.lit(i > 0).alias("escaped"))).otherwise(rest),
        (1, 0), F.struct(F.raise_error(F.lit("a conversation does not survive the round trip"))
                         .cast("string").alias("formatted"), F.lit(True).alias("escaped")))
    done = tried.select("conv_id", chosen.alias("c"))
    return done.select("conv_id", "c.formatted", "c.escaped",
                       loss_spans(F.col("c.formatted")).alias("loss_spans"))
