"""The English (Porter2) stemmer, written from its published description.

Words are lower case; anything of one or two letters is returned as it is.
"""

from __future__ import annotations

from functools import lru_cache

# Fixed values of the published algorithm.
VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
R1_PREFIXES = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "ousness": "ous", "iveness": "ive", "fulness": "ful",
    "tional": "tion", "lessli": "less", "biliti": "ble", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "fulli": "ful", "ousli": "ous", "iviti": "ive", "enci": "ence", "anci": "ance",
    "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = tuple("ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split())


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: what follows the first consonant after a vowel, and the same again."""

    def after(start: int) -> int:
        for i in range(start + 1, len(word)):
            if word[i] not in VOWELS and word[i - 1] in VOWELS:
                return i + 1
        return len(word)

    r1 = next((len(p) for p in R1_PREFIXES if word.startswith(p)), None)
    if r1 is None:
        r1 = after(0)
    return r1, after(r1)


def _short_end(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _step_1a(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")):
        return w
    if w.endswith("s") and _has_vowel(w[:-2]):
        return w[:-1]
    return w


def _step_1b(w: str, r1: int) -> str:
    for end in ("eedly", "eed"):
        if w.endswith(end):
            return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    for end in ("ingly", "edly", "ing", "ed"):
        if w.endswith(end):
            rest = w[: -len(end)]
            if not _has_vowel(rest):
                return w
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if rest.endswith(DOUBLES):
                return rest[:-1]
            return rest + "e" if len(rest) <= r1 and _short_end(rest) else rest
    return w


def _step_2(w: str, r1: int) -> str:
    for n in range(7, 2, -1):
        end = w[-n:]
        if end in STEP_2:
            return w[:-n] + STEP_2[end] if len(w) - n >= r1 else w
        if end == "ogi":
            return w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    if w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in LI_ENDINGS:
        return w[:-2]
    return w


def _step_3(w: str, r1: int, r2: int) -> str:
    for n in range(7, 2, -1):
        end = w[-n:]
        if end in STEP_3:
            return w[:-n] + STEP_3[end] if len(w) - n >= r1 else w
        if end == "ative":
            return w[:-5] if len(w) - 5 >= r2 and len(w) - 5 >= r1 else w
    return w


def _step_4(w: str, r2: int) -> str:
    for end in STEP_4:
        if w.endswith(end):
            return w[: -len(end)] if len(w) - len(end) >= r2 else w
    if w.endswith(("sion", "tion")):
        return w[:-3] if len(w) - 3 >= r2 else w
    return w


def _step_5(w: str, r1: int, r2: int) -> str:
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            return w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        return w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    w = word[1:] if word[0] == "'" else word
    # a y at the start or after a vowel counts as a consonant, written Y
    chars = list(w)
    for i, c in enumerate(chars):
        if c == "y" and (i == 0 or chars[i - 1] in VOWELS):
            chars[i] = "Y"
    w = "".join(chars)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    w = _step_1a(w)
    if w in AFTER_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    w = _step_2(w, r1)
    w = _step_3(w, r1, r2)
    w = _step_4(w, r2)
    w = _step_5(w, r1, r2)
    return w.replace("Y", "y")
