"""Text normalisation."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables, of which LEAD x VOWEL x TAIL letters decompose by arithmetic; a syllable's tail may be missing.
SYLLABLES, LEAD, VOWEL, TAIL = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)
_N = LEAD[1] * VOWEL[1] * TAIL[1]


@cache
def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What characters become when decomposed without nonspacing marks, where that changes them: (to one or none, to several); no Hangul syllables."""
    short, long = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if (unicodedata.decomposition(c) or unicodedata.category(c) == "Mn") and not SYLLABLES <= ord(c) < SYLLABLES + _N and not 0xD800 <= ord(c) < 0xE000:
            plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if plain != c:
                (short if len(plain) < 2 else long)[c] = plain
    return short, long


def _letters(text: Column) -> Column:
    """Hangul syllables as their letters."""
    pick = lambda first, of, k: F.substring(F.lit("".join(chr(first + i) for i in range(of))), (k + 1).cast("int"), F.lit(1))

    def one(c: Column) -> Column:
        k = F.ascii(c) - SYLLABLES
        tail = k % TAIL[1]
        parts = F.concat(pick(*LEAD, F.floor(k / (VOWEL[1] * TAIL[1]))), pick(*VOWEL, F.floor(k / TAIL[1]) % VOWEL[1]), F.when(tail > 0, pick(*TAIL, tail)).otherwise(""))
        return F.when((k >= 0) & (k < _N), parts).otherwise(c)

    return F.array_join(F.transform(F.split(text, "", -1), one), "")


def strip_accents(text: Column | str) -> Column:
    """Canonical decomposition without its nonspacing marks: a map of single characters, replacement of the few that become several, arithmetic for Hangul.

    The tables come from Python's Unicode data when the expression is built; it runs in Spark alone, and ASCII texts pass as they are.
    """
    text = F.col(text) if isinstance(text, str) else text
    short, long = _decompositions()
    several = text
    for c, plain in long.items():
        several = F.replace(several, F.lit(c), F.lit(plain))
    several = F.when(text.rlike("[" + "".join(long) + "]"), several).otherwise(text)
    syllables = F.when(several.rlike(f"[{chr(SYLLABLES)}-{chr(SYLLABLES + _N - 1)}]"), _letters(several)).otherwise(several)
    kept = {c: p for c, p in short.items() if p}
    gone = "".join(c for c, p in short.items() if not p)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(syllables, "".join(kept) + gone, "".join(kept.values())))


def strip_accents_and_lower_case(text: Column | str) -> Column:
    return F.lower(strip_accents(text))


#: What counts as white space at the ends of a text.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def relax_str(text: Column | str) -> Column:
    """Without accents, in lower case, without white space at either end."""
    return F.btrim(strip_accents_and_lower_case(text), F.lit(SPACE))
