"""Text functions as column expressions: page-label digits, Markdown pieces, PDF numbers, font flags, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Font flags, bullets and CJK ranges of the Markdown rules.
ITALIC, SERIF, MONO, BOLD = 2, 4, 8, 16
SPACED_BULLETS = "・•●○◦▪‣–—-*"
TIGHT_BULLETS = "・•●○◦▪‣"
CJK_CLASS = "[\\u3000-\\u30FF\\u3400-\\u9FFF\\uF900-\\uFAFF\\uFF00-\\uFFEF]"
#: Name parts that ask for a CJK or a serif fallback font.
CJK_HINTS = "gothic mincho meiryo hiragino noto sans cjk simsun simhei msyh mingliu batang malgun gulim".split()
SERIF_HINTS = "mincho serif song ming batang".split()


def _digit(n: Column, unit: int, one: str, five: str, ten: str) -> Column:
    d = F.pmod(F.floor(n / F.lit(unit)), F.lit(10)).cast("int")
    forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    return F.element_at(F.array(*map(F.lit, forms)), d + 1)


def roman(n: Column) -> Column:
    """Upper-case Roman numerals of a positive number."""
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), _digit(n, 100, "C", "D", "M"), _digit(n, 10, "X", "L", "C"), _digit(n, 1, "I", "V", "X"))


def letters(n: Column) -> Column:
    """A to Z, then AA to ZZ and so on: one letter, repeated."""
    return F.repeat(F.char((F.lit(65) + F.pmod(n - 1, F.lit(26))).cast("int")), (F.floor((n - 1) / 26) + 1).cast("int"))


def format_label(prefix: Column, style: Column, n: Column) -> Column:
    digits = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", letters(n)).when(style == "a", F.lower(letters(n))).otherwise(F.lit(""))
    return F.concat(F.coalesce(prefix, F.lit("")), digits)


def escape_cell(cell: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def list_item(line: Column) -> Column:
    """The line as a Markdown list item, or null where it isn't one."""
    spaced = f"^[{SPACED_BULLETS[:-2]}*\\-][ \\u3000]+(.*)$"
    tight = f"^[{TIGHT_BULLETS}](.*)$"
    numbered = "^([0-9]{1,3})[.)][ \\u3000]+(.*)$"
    return (
        F.when(line.rlike(spaced), F.concat(F.lit("- "), F.regexp_extract(line, spaced, 1)))
        .when(line.rlike(tight), F.concat(F.lit("- "), F.regexp_extract(line, tight, 1)))
        .when(line.rlike(numbered), F.concat(F.regexp_extract(line, numbered, 1), F.lit(". "), F.regexp_extract(line, numbered, 2)))
    )


def emphasize(text: Column, flags: Column) -> Column:
    """Bold and italic marks around the text, outer white space outside of them."""
    mark = F.when(flags.bitwiseAND(BOLD | ITALIC) == (BOLD | ITALIC), "***").when(flags.bitwiseAND(BOLD) != 0, "**").when(flags.bitwiseAND(ITALIC) != 0, "*").otherwise("")
    inner = F.trim(text)
    lead = F.regexp_extract(text, "^( *)", 1)
    tail = F.regexp_extract(text, "( *)$", 1)
    return F.when((inner == "") | (mark == ""), text).otherwise(F.concat(lead, mark, inner, mark, tail))


def join_lines(a: Column, b: Column) -> Column:
    """Two lines of a paragraph: no space between CJK characters, one otherwise."""
    glue = F.when(F.substring(a, -1, 1).rlike(CJK_CLASS) & F.substring(b, 1, 1).rlike(CJK_CLASS), "").otherwise(" ")
    return F.concat(a, glue, b)


def pdf_number(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), "\\.$", "")
    return F.when(s.isin("-0", ""), F.lit("0")).otherwise(s)


def font_flags(name: Column) -> Column:
    low = F.lower(name)
    bit = lambda pattern, v: F.when(low.rlike(pattern), v).otherwise(0)
    return bit("italic|oblique", ITALIC).bitwiseOR(bit("times|serif", SERIF)).bitwiseOR(bit("courier|mono", MONO)).bitwiseOR(bit("bold|black", BOLD))


def filespec_name(uf: Column, f: Column, plain: Column) -> Column:
    return F.coalesce(uf, f, plain)


def fallback_slot(name: Column) -> Column:
    """The fallback font that a name asks for."""
    low = F.lower(name)
    return F.when(low.rlike("|".join(CJK_HINTS)), F.when(low.rlike("|".join(SERIF_HINTS)), "cjk-serif").otherwise("cjk-sans")).when(low.rlike("|".join(SERIF_HINTS)), "serif").otherwise("sans")


def winansi_text(text: Column) -> Column:
    return F.regexp_replace(text, "\\r\\n?", "\n")
