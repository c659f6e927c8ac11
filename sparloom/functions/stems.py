"""English word stems by Porter's rules of 1980, as plain functions for tasks."""

from __future__ import annotations

from functools import lru_cache

# The published suffix rules, in the order in which they are tried (longest first within a step).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(word: str, i: int) -> bool:
    if word[i] in "aeiou":
        return False
    return word[i] != "y" or i == 0 or not _consonant(word, i - 1)


def _shape(word: str) -> str:
    """c for consonants, v for vowels, runs as one."""
    out = ""
    for i in range(len(word)):
        kind = "c" if _consonant(word, i) else "v"
        if not out.endswith(kind):
            out += kind
    return out


def _measure(word: str) -> int:
    """How often a vowel run is followed by consonants."""
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    n = len(word)
    return n > 2 and _consonant(word, n - 1) and not _consonant(word, n - 2) and _consonant(word, n - 3) and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) >= least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif _double(base) and base[-1] not in "lsz":
                    word = base[:-1]
                else:
                    word = base + "e" if _measure(base) == 1 and _short(base) else base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 1), STEP_3, 1)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if _measure(word) > 1 and word.endswith("ll") else word
