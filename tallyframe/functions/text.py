"""Names and labels: normal forms and similarity, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't tell one course from another.
STOP_WORDS = ("golf", "club", "course", "links", "the", "at", "of", "and", "cc", "country", "gc", "g", "c", "national", "resort")
# Letters with strokes, which have no decomposition.
_STROKED, _PLAIN = "łøđħŧ", "lodht"


def _folded() -> tuple[str, str]:
    """Small letters of alphabets below U+2000 whose canonical decomposition is one letter and combining marks, and those letters."""
    pairs = []
    for point in range(0xC0, 0x2000):
        letter = chr(point)
        base, *marks = unicodedata.normalize("NFD", letter)
        if marks and letter == letter.lower() and base.isalpha() and all(unicodedata.combining(m) for m in marks):
            pairs.append((letter, base))
    return "".join(x for x, _ in pairs), "".join(x for _, x in pairs)


_FROM, _TO = (x + y for x, y in zip(_folded(), (_STROKED, _PLAIN), strict=True))
#: Combining marks that stand after their letter.
_MARKS = r"[\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\uFE20-\uFE2F]"


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def normalize_label(s: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(s), r"[^\p{L}\p{M}\p{N}]", "")


def normalize_name(s: Column) -> Column:
    """Lower case without accents; anything but letters and digits is one blank between words."""
    plain = F.translate(F.regexp_replace(F.lower(s), _MARKS, ""), _FROM, _TO)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}]+", " "))


def tokens_of(form: Column) -> Column:
    """The telling words of a normal form; all of them if none tells."""
    every = F.filter(F.split(form, " "), lambda t: t != "")
    telling = F.filter(every, lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))
    return F.when(F.size(telling) > 0, telling).otherwise(every)


def significant_tokens(s: Column) -> Column:
    return tokens_of(normalize_name(s))


def edit_share(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def character_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of the normal forms; 0 if either is empty."""
    x, y = normalize_name(a), normalize_name(b)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).when(x == y, 1.0).otherwise(edit_share(x, y))


def token_share(x: Column, y: Column) -> Column:
    """Of token arrays: the mean of each token's best match in the other, both ways."""

    def one_way(p: Column, q: Column) -> Column:
        best = F.transform(p, lambda t: F.array_max(F.transform(q, lambda u: F.when(t == u, F.lit(1.0)).otherwise(edit_share(t, u)))))
        return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(p)

    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise((one_way(x, y) + one_way(y, x)) / 2)


def token_similarity(a: Column, b: Column) -> Column:
    return token_share(significant_tokens(a), significant_tokens(b))


def name_similarity(a: Column, b: Column) -> Column:
    c, t = character_similarity(a, b), token_similarity(a, b)
    return F.greatest(c, t) * 0.7 + F.least(c, t) * 0.3


def is_name_like(s: Column) -> Column:
    """Three characters of normal form at least, and three letters."""
    return (F.length(normalize_name(s)) >= 3) & (F.regexp_count(s, F.lit(r"\p{L}")) >= 3)


def joined_fragments(parts: Column) -> Column:
    """The fragments, then runs of two and of three neighbours, joined by blanks."""

    def runs(n: int) -> Column:
        return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(parts, runs(2), runs(3))


def matchable_names(name: Column, facility: Column, layout: Column, aliases: Column) -> Column:
    """All distinct names that a course may be printed under."""
    both = F.when(facility.isNotNull() & layout.isNotNull(), F.concat_ws(" ", facility, layout))
    return F.array_distinct(F.filter(F.concat(F.array(name, facility, layout, both), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))


def display_name(name: Column, layout: Column) -> Column:
    return F.when(layout.isNotNull() & (layout != ""), F.concat(name, F.lit(" — "), layout)).otherwise(name)
