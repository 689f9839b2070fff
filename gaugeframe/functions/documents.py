"""texts and formulas of recognised documents in a form in which they can be compared, as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands that change how a formula looks but not what it says, and parts that are taken out whole.
LOOKS = [
    "\\mathbf", "\\mathrm", "\\mathnormal", "\\mathit", "\\mathbb", "\\mathcal", "\\mathscr", "\\mathfrak", "\\mathsf", "\\mathtt", "\\textbf", "\\text", "\\boldmath", "\\boldsymbol", "\\operatorname", "\\bm",
    "\\symbfit", "\\mathbfcal", "\\symbf", "\\scriptscriptstyle", "\\notag", "\\setlength", "\\coloneqq", "\\space", "\\thickspace", "\\thinspace", "\\medspace", "\\nobreakspace", "\\negmedspace",
    "\\quad", "\\qquad", "\\enspace", "\\substackw", " ",
]
PARTS = [r"\\tag\{.*?\}", r"\\hspace\{.*?\}", r"\\begin\{.*?\}", r"\\end\{.*?\}", r"\\arraycolsep.*?\}"]
#: Full-width forms of the printable ASCII characters, and the wide space.
WIDE, NARROW = "\u3000" + "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F)), " " + "".join(chr(i) for i in range(0x21, 0x7F))


def half_width(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def unfenced(text: Column) -> Column:
    """Without the fences of a markdown block."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```markdown\n?", ""), r"(?m)```\n?$", "")


def squeezed(text: Column) -> Column:
    """At most four underscores or spaces in a row, and four of any other sign that comes more than ten times."""
    four = F.regexp_replace(F.regexp_replace(text, "_{4,}", "____"), " {4,}", "    ")
    return F.regexp_replace(four, r"([^a-zA-Z0-9])\1{10,}", "$1$1$1$1")


def bare(text: Column) -> Column:
    """Letters, digits and underscores alone; written tabs and line breaks go with the real ones."""
    text = functools.reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), ["\\t", "\\n", "\t", "\n", "/t", "/n"], text)
    return F.regexp_replace(text, r"(?U)[^\w\u4e00-\u9fff]", "")


def plain_formula(text: Column) -> Column:
    """The first displayed formula, or the text, without tags, spacing, environments and looks; lower case."""
    inner = F.regexp_extract(text, r"\\\[(.+?)(?<!\\)\\\]", 1)
    text = F.when(inner != "", F.trim(inner)).otherwise(text)
    text = F.btrim(functools.reduce(lambda c, x: F.regexp_replace(c, x, ""), PARTS, text), F.lit("."))
    return F.lower(functools.reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), LOOKS, text))
