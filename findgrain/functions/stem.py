"""English stems by the published Snowball "English" (Porter2) algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published algorithm.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
STEP_3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_SYLLABLE = re.compile(f"[{VOWELS}][^{VOWELS}]")
_SHORT_END = re.compile(f"(?:^|.*[^{VOWELS}])[{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$", re.S)
_HAS_VOWEL = re.compile(f"[{VOWELS}]")


def _after_syllable(w: str, start: int) -> int:
    m = _SYLLABLE.search(w, start)
    return m.end() if m else len(w)


def _first_region(w: str) -> int:
    m = re.match("gener|commun|arsen", w)
    return m.end() if m else _after_syllable(w, 0)


def _ends_short(w: str) -> bool:
    return bool(_SHORT_END.search(w)) if len(w) > 2 else bool(re.match(f"^[{VOWELS}][^{VOWELS}]$", w))


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay as they are."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'") if "'" in word or "’" in word else word
    if w in WHOLE_WORDS:
        return WHOLE_WORDS[w]
    w = re.sub(rf"^y|(?<=[{VOWELS}])y", "Y", w)
    r1 = _first_region(w)
    r2 = _after_syllable(w, r1)

    w = re.sub(r"'s'$|'s$|'$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w.lower()
    # past and progressive
    m = re.search(r"(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        base, end = w[: m.start()], m.group()
        if end in ("eed", "eedly"):
            if m.start() >= r1:
                w = base + "ee"
        elif _HAS_VOWEL.search(base):
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif base.endswith(DOUBLES):
                w = base[:-1]
            elif r1 >= len(base) and _ends_short(base):
                w = base + "e"
            else:
                w = base
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # derivational endings, longest first
    for end, to in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, to in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
