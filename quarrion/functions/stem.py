"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

# Suffixes of steps 2, 3 and 4 with their replacements.
_STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _longest_first(rules: str) -> list[list[str]]:
    return sorted((r.split(":") for r in rules.split()), key=lambda r: -len(r[0]))


_RULES2, _RULES3, _SUFFIXES4 = _longest_first(_STEP2), _longest_first(_STEP3), [r[0] for r in _longest_first(_STEP4)]


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or w[i] == "y" and i > 0 and not _vowel(w, i - 1)


def _measure(w: str) -> int:
    """Times that a vowel is followed by a consonant."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


def _replace(w: str, rules: list[list[str]], least: int) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + new if _measure(base) > least else w
    return w


def stem(word: str) -> str:
    """Stem of a lower-case word; words of other letters than a to z, and of two letters or fewer, stay."""
    w = word
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _RULES2, 0), _RULES3, 0)
    for suffix in _SUFFIXES4:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _cvc(base):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
