"""Text from HTML and office XML, as column expressions; only numeric entities need more than a fixed replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each kind of mark-up stands for, in the order in which it is replaced.
MARKS = (
    (r"<w:tab\b[^>]*/?>", "\t"), (r"<(?:w:br|w:cr)\b[^>]*/?>", "\n"), (r"</(?:w:p|a:p|text:p|text:h)>", "\n"), (r"</(?:w:tc|a:tc)>", "\t"),
    (r"</(?:w:tr|a:tr|table:table-row)>", "\n"), (r"</(?:si|c)>", "\n"), (r"<[^>]+>", ""),
)
ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&"))


def numeric_entities(text: Column) -> Column:
    """Decimal, then hexadecimal references as their characters. The text is cut at the references, whose values are
    put back between the parts; numbers that are no character become U+FFFD."""

    def replaced(text: Column, pattern: str, number: Column | None) -> Column:
        values, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1)
        code = (lambda v: v.try_cast("long")) if number is None else (lambda v: F.conv(v, 16, 10).try_cast("long"))
        # A code point as UTF-32 bytes; decode() knows no surrogates or numbers past the last plane.
        char = lambda n: F.when(n.between(0, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")
        pairs = F.zip_with(values, F.slice(parts, 2, F.greatest(F.size(values), F.lit(1))), lambda v, p: F.concat(char(code(v)), F.coalesce(p, F.lit(""))))
        return F.when(text.rlike(pattern), F.concat(F.get(parts, F.lit(0)), F.array_join(pairs, ""))).otherwise(text)

    return replaced(replaced(text, "&#([0-9]+);", None), "&#x([0-9a-fA-F]+);", F.lit(16))


def xml_text(xml: Column, numeric: bool = True) -> Column:
    """Mark-up to text: tabs, breaks and ends of paragraphs and rows as white space, tags away, entities resolved
    (numeric ones first), blanks at line ends away, three or more newlines as two. Unknown names stay."""
    for pattern, text in MARKS:
        xml = F.regexp_replace(xml, pattern, text)
    if numeric:
        xml = numeric_entities(xml)
    # Each name is replaced only where it stood in the input: & itself comes last.
    for name, char in ENTITIES:
        xml = F.regexp_replace(xml, f"(?i)&{name};", char)
    return F.regexp_replace(F.regexp_replace(xml, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def html_text(html: Column, numeric: bool = True) -> Column:
    """Scripts and styles away, then as xml_text. Comments go with the tags, except what follows a > inside them."""
    html = F.coalesce(html, F.lit(""))
    for name in ("script", "style"):
        html = F.regexp_replace(html, rf"(?i)<{name}[\s\S]*?</{name}>", " ")
    return xml_text(html, numeric)
