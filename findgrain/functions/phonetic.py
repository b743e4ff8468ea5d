"""Phonetic codes of names: a short code that words of like sound share."""

from __future__ import annotations

import re

# Spelling to sound, the first that fits. A code ends with the sound that brings it to four letters.
SOUNDS = (
    (r"^[GKP](?=N)|^W(?=R)", ""),
    (r"^[AEIOU]", "A"),
    (r"GH(?![AEIOU])", ""),
    (r"CH|SH", "X"),
    (r"PH|FF?|V", "F"),
    (r"TH", "0"),
    (r"BB?|P", "P"),
    (r"C|G|KK?|Q", "K"),
    (r"D|T", "T"),
    (r"(?<![^AEIOU])H(?=[AEIOU])", "H"),
    (r"J", "J"),
    (r"LL?", "L"),
    (r"MM?", "M"),
    (r"NN?", "N"),
    (r"R", "R"),
    (r"S|Z", "S"),
    (r"W(?=[AEIOU])", "W"),
    (r"X", "KS"),
    (r"Y(?=[AEIOU])", "Y"),
)
_SCAN = re.compile("|".join(f"({spelling})" for spelling, _ in SOUNDS))


def phonetic_code(word: str) -> str:
    code = ""
    for m in _SCAN.finditer(word.upper()):
        code += SOUNDS[m.lastindex - 1][1]
        if len(code) >= 4:
            break
    return code
