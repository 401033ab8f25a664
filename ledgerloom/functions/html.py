"""Filing HTML to plain text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from ledgerloom.functions.strings import tidy_lines

# Comments, script and style elements, declarations, instructions and tags; the
# alternatives are tried left to right, so a tag inside a comment stays inside it.
MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b[^>]*+>.*?(?:</script\s*+>|\z)"
    r"|<style\b[^>]*+>.*?(?:</style\s*+>|\z)"
    r"|<![^>]*+>|<\?[^>]*+>|</[^a-z>][^>]*+>|</>"
    r"""|</?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
    # Quotes outside values are plain characters of a tag.
    r"""|</?[a-z](?:[^\s>=]++|\s++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))*+>"""
)

_FREQUENT = ("amp", "nbsp", "quot", "lt", "gt", "apos")


def _entity_table() -> Column:
    """Entity name to character, from the standard library's own table."""
    table = {name.rstrip(";"): char for name, char in html5.items()}
    ordered = {name: table.pop(name) for name in _FREQUENT} | table
    return F.from_json(F.lit(json.dumps(ordered)), "map<string,string>")


def _windows_table() -> Column:
    """Code points 128-159 as Windows-1252, the way browsers read them."""
    table = {
        str(code): bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(128, 160)
    }
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _character(code: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    encoded = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.between(128, 159), F.try_element_at(_windows_table(), code.cast("string")))
        .when(valid, encoded)
        .otherwise(F.lit("�"))
    )


def _decode_piece(piece: Column) -> Column:
    """Text that followed an ampersand, with the reference it starts with resolved."""
    name = F.regexp_extract(piece, r"^([a-zA-Z][-.a-zA-Z0-9]*)", 1)
    decimal = F.regexp_extract(piece, r"^#([0-9]+)", 1)
    hexadecimal = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+)", 1)

    def rest(pattern: str) -> Column:
        return F.regexp_replace(piece, pattern, "")

    named = F.coalesce(F.try_element_at(_entity_table(), name), F.concat(F.lit("&"), name))
    # A number too long for the code space is replaced, never wrapped around.
    from_decimal = F.coalesce(decimal.try_cast("bigint"), F.lit(-1))
    from_hex = F.when(
        F.length(hexadecimal) <= 8, F.conv(hexadecimal, 16, 10).try_cast("bigint")
    ).otherwise(F.lit(-1))
    return (
        F.when(name != "", F.concat(named, rest(r"^[a-zA-Z][-.a-zA-Z0-9]*;?")))
        .when(decimal != "", F.concat(_character(from_decimal), rest(r"^#[0-9]+;?")))
        .when(hexadecimal != "", F.concat(_character(from_hex), rest(r"^#[xX][0-9a-fA-F]+;?")))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def decode_entities(text: Column) -> Column:
    pieces = F.split(text, "&")
    decoded = F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(_decode_piece(piece)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """Visible text: one stripped line per text node, no blank lines.

    Scripts, styles and comments that are never closed run to the end. A tag that is
    never closed is text.
    """
    return tidy_lines(decode_entities(F.regexp_replace(html, MARKUP, "\n")))
