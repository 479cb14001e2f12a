"""Finding words and phrases of plain lists in a text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts words: all that is no letter, mark or digit.
GAP = r"[^\p{L}\p{M}\p{N}]+"


def folded(text: Column) -> Column:
    """A text's words in lower case, one space before, between and after them; ``you're`` is two words."""
    low = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("'re"), F.lit(" are"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


def listed(words: str) -> list[str]:
    """The phrases of a comma-separated list."""
    return [w.strip() for w in words.split(",")]


def whole(words: str) -> str:
    """A pattern, on folded text, for any phrase of a list."""
    return " (?:" + "|".join(map(re.escape, listed(words))) + ") "


def beginning(words: str) -> str:
    """A pattern, on folded text, for any phrase of a list, the last word of which may go on."""
    return " (?:" + "|".join(map(re.escape, listed(words))) + ")"


def chain(*steps: tuple[str, int]) -> str:
    """A pattern, on folded text: phrases of several lists, one after the other, each followed by at most so many words."""
    return "".join(" (?:" + "|".join(map(re.escape, listed(words))) + ")(?: [^ ]+){0," + str(reach) + "}" for words, reach in steps)


def followed(first: str, reach: int, then: str, go_on: bool = True) -> str:
    """A pattern, on folded text: a phrase of one list and, at most ``reach`` words later, one of another."""
    return chain((first, reach)) + (beginning(then) if go_on else whole(then))
