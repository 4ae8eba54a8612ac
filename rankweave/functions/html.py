"""Column expressions that read text, title and links from HTML."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# What a tag holds behind its name: anything up to `>`, which may also stand inside a quoted value.
ATTRIBUTES = r"(?:[\s/](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)?"

# What is cut from a page, in this order. Scripts go before tags, because their
# strings may hold tags.
HIDDEN = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
COMMENT = r"(?s)<!--.*?-->"
DECLARATION = r"(?s)<[!?][^>]*>"
# Tags that part words; all others stand inside a line.
BLOCKS = ("address article aside blockquote body br caption center col colgroup dd details dialog "
          "dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 "
          "head header hr html iframe legend li link main menu meta nav noframes noscript ol "
          "optgroup option p pre search section select summary table tbody td textarea tfoot th "
          "thead title tr ul").split()
BLOCK_TAG = rf"(?is)</?(?:{'|'.join(BLOCKS)}){ATTRIBUTES}>"
TAG = rf"(?s)</?[A-Za-z][^\s/>]*{ATTRIBUTES}>"
BROKEN_TAG = r"(?s)</?[A-Za-z][^>]*>"
TITLE = rf"(?is)<title{ATTRIBUTES}>(.*?)</title"
HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'#]+)"

# Names that are read without a semicolon too, longest first.
_BARE = "|".join(sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n)))


def _characters() -> Column:
    """Entity names, with their semicolon if they need one, and their characters.

    Numbers 128 to 159 stand for the characters of the Windows code page at these places.
    """
    table = dict(html5)
    for code in range(128, 160):
        table[f"#{code}"] = bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _numbered(code: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    point = F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0"))
    return F.coalesce(F.try_element_at(_characters(), F.concat(F.lit("#"), code.cast("string"))),
                      F.decode(point, "UTF-32"))


def _after_ampersand(piece: Column) -> Column:
    number = F.regexp_extract(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
    hexadecimal = F.regexp_extract(number, r"^#[xX]0*([0-9a-fA-F]+)", 1)
    decimal = F.regexp_extract(number, r"^#0*([0-9]+)", 1)
    # Longer numbers are beyond all code points.
    code = F.when(hexadecimal != "", F.when(F.length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10)))
    code = code.otherwise(F.when(F.length(decimal) <= 10, decimal)).try_cast("bigint")
    name = F.regexp_extract(piece, r"^[A-Za-z][A-Za-z0-9]*;", 0)
    bare = F.regexp_extract(piece, f"^(?:{_BARE})", 0)
    known = F.try_element_at(_characters(), name)

    def rest(read: Column) -> Column:
        return piece.substr(F.length(read) + 1, F.length(piece))
    return (F.when(number != "", F.concat(_numbered(code), rest(number)))
            .when(known.isNotNull(), F.concat(known, rest(name)))
            .when(bare != "", F.concat(F.try_element_at(_characters(), bare), rest(bare)))
            .otherwise(F.concat(F.lit("&"), piece)))


def unescape(text: Column) -> Column:
    """Decode named and numbered entities, each once."""
    pieces = F.split(text, "&")
    decoded = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces)), _after_ampersand), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip(text: Column) -> Column:
    """Cut white space of every kind from both ends."""
    return F.regexp_replace(text, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", "")


def html_text(html: Column, block_separator: str = " ", compat: bool = False) -> Column:
    """The visible text of a page, title included.

    By default tags of blocks leave a separator, tags inside a line leave nothing, and white space
    is collapsed. With `compat` no removed piece leaves anything and every empty line is deleted,
    which may join words.
    """
    text = html
    for pattern in (HIDDEN, COMMENT, DECLARATION):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, BLOCK_TAG, "" if compat else block_separator)
    for pattern in (TAG, BROKEN_TAG):
        text = F.regexp_replace(text, pattern, "")
    text = unescape(text)
    if compat:
        return F.replace(text, F.lit("\n\n"), F.lit(""))
    return strip(F.regexp_replace(text, r"[\s\x{00a0}]+", " "))


def html_title(html: Column) -> Column:
    """The first title, stripped; null when absent or empty."""
    return F.nullif(strip(unescape(F.regexp_extract(html, TITLE, 1))), F.lit(""))


def html_links(html: Column) -> Column:
    """The href of every anchor, in page order, as an array."""
    plain = F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), COMMENT, " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(HREF), F.lit(1)), unescape)
