"""Numbers in damaged print: candidate readings, the best reading, and agreement with an expected number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs that stand for one digit each; B alone stands for two, 8 and then 3.
GLYPHS = {
    "O": "0", "o": "0", "D": "0", "Q": "0", "U": "0",
    "I": "1", "i": "1", "l": "1", "L": "1", "|": "1", "!": "1", "]": "1", "[": "1",
    "Z": "2", "z": "2",
    "E": "3",
    "A": "4", "h": "4", "y": "4",
    "S": "5", "s": "5",
    "G": "6", "b": "6",
    "T": "7", "t": "7", "/": "7", "\\": "7",
    "g": "9", "q": "9", "P": "9",
}
# Pairs of digits that print confuses, in either order.
CONFUSED = ("08", "06", "09", "0D", "17", "14", "38", "39", "35", "32", "56", "58", "59", "68", "79", "89", "94", "27")
_PAIRS = sorted({p for x in CONFUSED for p in (x, x[::-1])})
_FROM, _TO = "".join(GLYPHS), "".join(GLYPHS.values())
_ALL = r"^[0-9OoDQUIilL|!\]\[ZzBEAhySsGbTt/\\gqP]+$"


def stripped(s: Column) -> Column:
    return F.translate(s, ", .'-_", "")


def substitutions(s: Column) -> Column:
    return F.length(F.regexp_replace(stripped(s), "[0-9]", ""))


def integer_candidates(s: Column, most: int = 8) -> Column:
    """Distinct readings, likeliest first: at most six characters and three substitutions; a digit, or one glyph that has one meaning."""
    c = stripped(s)
    n_sub = substitutions(s)
    readable = c.rlike(_ALL) & (F.length(c) <= 6) & (n_sub <= 3) & (c.rlike("[0-9]") | ((F.length(c) == 1) & (c != "B")))
    texts = F.array(F.translate(c, _FROM, _TO))
    for _ in range(3):
        texts = F.flatten(F.transform(texts, lambda t: F.when(t.contains("B"), F.array(F.regexp_replace(t, "^([^B]*)B", "$18"), F.regexp_replace(t, "^([^B]*)B", "$13"))).otherwise(F.array(t))))
    values = F.slice(F.array_distinct(F.transform(texts, lambda t: t.try_cast("int"))), 1, most)
    return F.when(F.coalesce(readable, F.lit(False)), values).otherwise(F.array().cast("array<int>"))


def looks_numeric(s: Column) -> Column:
    return F.size(integer_candidates(s)) > 0


def best_integer(s: Column, low: int | None = None, high: int | None = None) -> Column:
    """struct(value, penalty): the first reading in range; if none is, the first of all with penalty 1; null without readings."""
    return best_of(integer_candidates(s), substitutions(s), low, high)


def best_of(c: Column, n_sub: Column, low: int | None, high: int | None) -> Column:
    base = n_sub * 0.25
    make = lambda v, p: F.struct(v.cast("int").alias("value"), p.cast("double").alias("penalty"))
    if low is None:
        return F.when(F.size(c) > 0, make(F.get(c, F.lit(0)), F.least(F.lit(1.0), base)))
    fit = F.filter(c, lambda v: v.between(low, high))
    at = F.array_position(c, F.get(fit, F.lit(0))) - 1
    return F.when(F.size(fit) > 0, make(F.get(fit, F.lit(0)), F.least(F.lit(1.0), base + at * 0.1))).when(F.size(c) > 0, make(F.get(c, F.lit(0)), F.lit(1.0)))


def _meanings(c: Column) -> Column:
    return F.when(c == "B", F.lit("83")).when(c.isin(*GLYPHS), F.translate(c, _FROM, _TO)).otherwise("")


def character_agreement(a: Column, b: Column) -> Column:
    same = (a == b) | _meanings(a).contains(b)
    return F.when(same, 1.0).when(F.concat(a, b).isin(*_PAIRS), 0.5).otherwise(0.0)


def digit_similarity(observed: Column, expected: Column) -> Column:
    """Of digit strings: mean agreement at equal lengths, else at most half of the edit share."""
    n = F.length(expected)
    agreed = F.aggregate(F.zip_with(F.split(observed, ""), F.split(expected, ""), character_agreement), F.lit(0.0), lambda s, v: s + v) / n
    unequal = F.greatest(F.lit(0.0), 1 - F.levenshtein(observed, expected) / F.greatest(F.length(observed), n)) * 0.5
    return F.when(n == 0, 0.0).when(F.length(observed) == n, agreed).otherwise(unequal)


def number_similarity(observed: Column, expected: Column) -> Column:
    return F.when(observed == expected, 1.0).otherwise(digit_similarity(observed.cast("string"), expected.cast("string")))


def text_number_similarity(observed: Column, expected: Column) -> Column:
    c = stripped(observed)
    return F.when(F.length(c) == 0, 0.0).when(F.array_contains(integer_candidates(c), expected), 1.0).otherwise(digit_similarity(c, expected.cast("string")))


def yardage_similarity(observed: Column, expected: Column) -> Column:
    """Digits or closeness, whichever is more; the expected yardage is positive."""
    error = F.abs(observed - expected) / expected.cast("double")
    close = F.when(error < 0.04, 0.9).when(error < 0.15, (1 - (error - 0.04) / 0.11) * 0.5).otherwise(0.0)
    return F.greatest(number_similarity(observed, expected), close)


def total_similarity(observed: Column, expected: Column) -> Column:
    error = F.abs(observed - expected) / expected.cast("double")
    return F.when(observed == expected, 1.0).otherwise(F.greatest(number_similarity(observed, expected), F.when(error < 0.03, 0.8).otherwise(F.greatest(F.lit(0.0), 1 - error * 8))))
