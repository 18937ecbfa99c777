"""String functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters and white space of all scripts, written out: the short classes of regex engines differ beyond ASCII.
WORD_CLASS, SPACE_CLASS = r"\p{L}\p{N}_", r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
#: Runs of letters, numbers and underscores, or one other character that is no space.
TOKEN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]"
RESPONSE = "### Response:"
FENCE = "```"


def strip_comments(code: Column) -> Column:
    """Line comments go first, then block comments: a // inside a block comment takes the block's end with it."""
    return F.regexp_replace(F.regexp_replace(code, r"(?dm)//.*?$", ""), r"(?s)/\*.*?\*/", "")


def tokenize(code: Column, keep_comments: bool = False) -> Column:
    """Array of tokens; a null text has none."""
    text = F.coalesce(code, F.lit(""))
    return F.regexp_extract_all(text if keep_comments else strip_comments(text), F.lit(TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z", "")


def after(text: Column, mark: str) -> Column:
    """What follows the first mark; the whole text without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise(text)


def fenced_block(response: Column, language: Column) -> Column:
    """The first fenced block of the language behind the response mark, stripped.

    Without a mark the whole response is taken as it is; without a block, what follows the mark, stripped.
    """
    rest = after(response, RESPONSE)
    blocks = F.lit(None).cast("string")
    for name in ("dart", "swift"):
        opened = F.contains(rest, F.lit(FENCE + name))
        block = F.split_part(after(rest, FENCE + name), F.lit(FENCE), F.lit(1))
        blocks = F.when((F.lower(language) == name) & opened, block).otherwise(blocks)
    return F.when(~F.contains(response, F.lit(RESPONSE)), response).otherwise(strip(F.coalesce(blocks, rest)))


def with_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), text).otherwise(F.concat(text, F.lit(suffix)))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, space-joined; tokens hold no spaces."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def encoded(text: Column) -> Column:
    """The UTF-8 bytes of a text."""
    return F.encode(text, "UTF-8")


def decimals(value: Column, places: int = 4) -> Column:
    """A number as text with so many decimals, without group separators: the double's exact value, ties to the even digit.

    Numbers from 2**53 / 10**places on, and more than 9 places, are left to the JVM's format, which rounds the shortest decimal
    that stands for the double. NaN and infinities are nan, inf and -inf.
    """
    if places > 9:
        return F.format_string(f"%.{places}f", value.cast("double"))
    return bound(value.cast("double"), lambda v: bound(F.abs(v), lambda x: F.when(v.isNotNull(), _decimals(v, x, places))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def _decimals(value: Column, x: Column, places: int) -> Column:
    # x * 10**places is z * 5**places, where z is exact; its fraction is split so that both parts' products are exact too
    five = float(5**places)
    z = x * float(2**places)
    parts = bound(z - F.floor(z), lambda rest: bound(F.floor(rest * float(2**26)) / float(2**26), lambda high: F.struct((high * five).alias("times"), ((rest - high) * five).alias("low"))))

    def rounded(p: Column) -> Column:
        part = F.floor(p["times"])
        to_half, below = 0.5 - (p["times"] - part), F.floor(z) * 5**places + part
        return below + F.when((p["low"] > to_half) | (p["low"] == to_half) & (below % 2 == 1), 1).otherwise(0)

    def shown(digits: Column) -> Column:
        point = F.length(digits) - places
        return digits if not places else F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(places)))

    digits = bound(bound(parts, rounded).cast("string"), lambda d: F.when(F.length(d) > places, d).otherwise(F.lpad(d, places + 1, "0")))
    minus = F.when(F.startswith(value.cast("string"), F.lit("-")), "-").otherwise("")
    named = F.when(F.isnan(value), "nan").when(x == float("inf"), F.concat(minus, F.lit("inf")))
    exact = named.when(x * float(10**places) < float(2**53), F.concat(minus, bound(digits, shown)))
    return exact.otherwise(F.format_string(f"%.{places}f", value))
