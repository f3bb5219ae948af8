"""Porter's suffix stripping (1980), as a function of one lower-case word."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiou"
#: Fixed suffix tables of the published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
          ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
          ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou"]


def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(c not in _VOWELS and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    c = _consonants(w)
    return sum(1 for a, b in zip(c, c[1:]) if not a and b)


def _vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _short(w: str) -> bool:
    c = _consonants(w)
    return len(w) > 2 and c[-3:] == [True, False, True] and w[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    if len(w) < 3 or len(w) > 64 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((x for x in table if w.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((x for x in _STEP4 if w.endswith(x)), key=len, default=None)
    if hit:
        root = w[: -len(hit)]
        if _measure(root) > 1 and (hit != "ion" or root[-1:] in ("s", "t")):
            w = root
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
