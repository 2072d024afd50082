"""English word stems by Porter's rules (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

# The suffixes of steps 2 to 4 and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), ""
)
PLAIN = re.compile("[a-z]{3,64}")


def _shape(part: str) -> str:
    """``v`` for a vowel and ``c`` for a consonant, letter by letter; y is a vowel behind a consonant."""
    out = ""
    for letter in part:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(part: str) -> int:
    """How often vowels are followed by consonants."""
    return _shape(part).count("vc")


def _short(part: str) -> bool:
    """Consonant, vowel, consonant at the end, the last no w, x or y."""
    return _shape(part).endswith("cvc") and part[-1] not in "wxy"


def _double(part: str) -> bool:
    return len(part) > 1 and part[-1] == part[-2] and _shape(part)[-1] == "c"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    """Replace the longest suffix of the table if what stands before it measures ``least`` or more."""
    suffix = next((word[k:] for k in range(len(word)) if word[k:] in table), None)
    if suffix is None:
        return word
    before = word.removesuffix(suffix)
    if _measure(before) < least or (suffix == "ion" and before[-1:] not in ("s", "t")):
        return word
    return before + table[suffix]


def _past_and_ing(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    before = next((word.removesuffix(s) for s in ("ed", "ing") if word.endswith(s)), None)
    if before is None or "v" not in _shape(before):
        return word
    if before.endswith(("at", "bl", "iz")):
        return before + "e"
    if _double(before) and before[-1] not in "lsz":
        return before[:-1]
    return before + "e" if _measure(before) == 1 and _short(before) else before


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words with other than a to z, or under three letters, stay."""
    if not PLAIN.fullmatch(word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past_and_ing(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table, least in ((STEP_2, 1), (STEP_3, 1), (STEP_4, 2)):
        word = _swap(word, table, least)
    if word.endswith("e"):
        n = _measure(word[:-1])
        if n > 1 or (n == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if _measure(word) > 1 and _double(word) and word[-1] == "l" else word
