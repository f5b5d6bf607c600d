"""Stemmers after the published algorithms: Porter2 for English, the nominal suffixes of the Snowball Turkish stemmer.

Written from the public descriptions. Words come in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_V = "aeiouy"

# fixed values: words that Porter2 treats apart
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_S = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, at: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from `at` on."""
    m = re.compile(f"[{_V}][^{_V}]").search(word, at)
    return m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", word)) or bool(re.fullmatch(f"[{_V}][^{_V}]", word))


def english(word: str) -> str:
    """The Porter2 stem."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    if word in _SAME:
        return word
    w = word.lstrip("'")
    w = re.sub(f"^y|(?<=[{_V}])y", "Y", w)
    m = re.match(r"(gener|commun|arsen)", w)
    r1 = m.end() if m else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_S:
        return w
    # 1b
    if (m := re.search(r"(eedly|eed)$", w)) is not None:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) is not None and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    # 1c
    w = re.sub(f"(?<=.[^{_V}])[yY]$", "i", w)
    # 2, 3
    for suffix, by in _STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + by
            break
    for suffix, by in _STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                w = w[:at] + by
            break
    # 4
    for suffix in _STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _short_syllable(w[:-1])) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_TV = "aeıioöuü"
#: After which last vowel a suffix vowel may stand: the harmony of the language.
_HARMONY = {"a": "aı", "e": "ei", "ı": "aı", "i": "ei", "o": "au", "ö": "eü", "u": "au", "ü": "eü"}
_WIDE = "[ıiuü]"
#: Nominal suffixes in the order in which they are stripped, from the end of the word inwards.
_CASES = ["ndan nden", "ntan nten", "dan den tan ten", "nda nde", "da de ta te", "nın nin nun nün", "yla yle", "ca ce", "na ne", "nı ni nu nü", "ya ye", "yı yi yu yü"]
_OWNERS = ["ları leri", "ımız imiz umuz ümüz", "ınız iniz unuz ünüz", "ım im um üm", "sı si su sü"]
_PLURAL = ["lar ler"]
_KI = ["ki"]


def _syllables(word: str) -> int:
    return sum(c in _TV for c in word)


def _fits(stem: str, suffix: str) -> bool:
    """Whether the suffix agrees with the last vowel of the stem."""
    last = next((c for c in reversed(stem) if c in _TV), None)
    first = next((c for c in suffix if c in _TV), None)
    return last is not None and (first is None or first in _HARMONY[last])


def _strip(word: str, groups: list[str]) -> str:
    for group in groups:
        for suffix in group.split():
            if word.endswith(suffix):
                rest = word[: -len(suffix)]
                if _syllables(rest) >= 1 and len(rest) >= 2 and _fits(rest, suffix):
                    return rest
    return word


def turkish(word: str) -> str:
    """The stem without case, owner and plural suffixes; final voiced stops become voiceless. Words of one syllable stay."""
    if _syllables(word) < 2:
        return word
    w = word.split("'")[0]
    w = _strip(w, _KI) if w.endswith("ki") and w[:-2].endswith(("da", "de", "ta", "te")) else w
    before = w
    w = _strip(w, _CASES)
    w = _strip(w, _PLURAL) if w.endswith(("lar", "ler")) else _strip(w, _OWNERS)
    if w == before and w.endswith("m") and w[-2:-1] in _TV and _syllables(w) > 1:
        w = w[:-1]  # "my", after a vowel
    w = _strip(w, _PLURAL)
    if w != before and _syllables(w) < 1:
        w = before
    if w != word and w[-1:] in "bcdğ" and len(w) > 2:
        w = w[:-1] + {"b": "p", "c": "ç", "d": "t", "ğ": "k"}[w[-1]]
    return w


def stemmer(language: str) -> Callable[[str], str]:
    """The stemmer of a language; one that leaves words as they are where there is none."""
    return {"en": english, "tr": turkish}.get(language, lambda w: w)
