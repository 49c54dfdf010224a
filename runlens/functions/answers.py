"""Final answers of math responses and the reward built on them."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import SPACE_CLASS, last_match, py_strip

# Fixed patterns of the answer cascade. \p{Nd} stands for Python's \d.
BOXED = r"\\boxed\{([^}]+)\}"
HASHED = rf"####{SPACE_CLASS}*(-?[\p{{Nd}},]+\.?\p{{Nd}}*)"
BARE = r"-?[\p{Nd},]+\.?\p{Nd}*"
BARE_WITH_DIGIT = r"-?,*\p{Nd}[\p{Nd},]*\.?\p{Nd}*"

# The numerals Python's float() reads, after translation to ASCII digits.
_DIGITS = r"\d+(?:_\d+)*"
FLOAT_TEXT = (
    rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))$"
)

_WIDE_DIGITS = [
    chr(code)
    for code in range(128, sys.maxunicode + 1)
    if unicodedata.category(chr(code)) == "Nd"
]
_WIDE = "".join(_WIDE_DIGITS)
_ASCII = "".join(str(unicodedata.decimal(digit)) for digit in _WIDE_DIGITS)


def strip_prompt_prefix(query: Column, prompt: Column) -> Column:
    """The response part of `query`; unchanged when it does not open with `prompt`."""
    return F.when(
        F.startswith(query, prompt), F.substr(query, F.length(prompt) + 1)
    ).otherwise(query)


def extract_answer(text: Column, require_digit: bool = False) -> Column:
    """Last boxed answer, else last `####` number, else last number, else null.

    The bare fallback also takes a lone comma (giving an empty answer), as in
    "42 dollars, right"; `require_digit` asks for at least one digit there.
    A nested brace closes the box: `\\boxed{\\frac{1}{2}}` gives `\\frac{1`.
    """
    bare = BARE_WITH_DIGIT if require_digit else BARE

    def number(pattern: str, group: int) -> Column:
        return py_strip(F.replace(last_match(text, pattern, group), F.lit(","), F.lit("")))

    return F.coalesce(
        py_strip(last_match(text, BOXED, 1)), number(HASHED, 1), number(bare, 0)
    )


def normalize_number(text: Column) -> Column:
    """Double value of a numeral after dropping commas, null when Python refuses it.

    The guard keeps out what only the JVM accepts (`1d`, `0x1p3`), the
    translation lets in what only Python accepts (other digits, `1_000`).
    """
    bare = py_strip(F.replace(text, F.lit(","), F.lit("")))
    ascii_text = F.translate(bare, _WIDE, _ASCII)
    return F.when(
        ascii_text.rlike(FLOAT_TEXT), F.replace(ascii_text, F.lit("_"), F.lit(""))
    ).try_cast("double")


def math_reward(response: Column, label: Column, tolerance: float = 1e-6) -> Column:
    """1.0 when the response's number equals the label's, else 0.0."""
    gold = F.nullif(extract_answer(label), F.lit(""))
    expected = F.when(gold.isNotNull(), normalize_number(gold)).otherwise(
        normalize_number(label)
    )
    gap = F.abs(normalize_number(extract_answer(response)) - expected)
    return F.when(gap < tolerance, F.lit(1.0)).otherwise(F.lit(0.0))


def binary_reward(resolved: Column) -> Column:
    return F.when(resolved, F.lit(1.0)).otherwise(F.lit(0.0))
