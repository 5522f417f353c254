"""The English (Porter2) stemmer of the Snowball project's published description, and its usual stop words."""

from __future__ import annotations

import re

#: English stop words of full-text search.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, words that stay as they are, and words that end the work after step 1a.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SPECIAL |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_DONE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
#: Endings of steps 2, 3 and 4, tried from the longest on, and what replaces them.
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_V = "[aeiouy]"
_REGION = re.compile(f".*?{_V}[^aeiouy]")
_EARLY = re.compile("gener|commun|arsen")
_SHORT_END = re.compile(f"(?:^{_V}[^aeiouy]|[^aeiouy]{_V}[^aeiouywxY])$")
_HAS_VOWEL = re.compile(_V)
_DOUBLED = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin that endings must lie in."""
    begins = _EARLY.match(word) or _REGION.match(word)
    first = begins.end() if begins else len(word)
    second = _REGION.match(word, first)
    return first, second.end() if second else len(word)


def _ending(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


def stem(word: str) -> str:
    """Stem of a lower-case word."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    # a y that stands for a consonant is marked
    word = re.sub("^y", "Y", re.sub("(?<=[aeiouy])y", "Y", word))
    first, second = _regions(word)
    for mark in ("'s'", "'s", "'"):
        if word.endswith(mark):
            word = word[: -len(mark)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _HAS_VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _DONE:
        return word
    # 1b: past and participle
    end = _ending(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eedly", "eed"):
        if len(word) - len(end) >= first:
            word = word[: -len(end)] + "ee"
    elif end and _HAS_VOWEL.search(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _DOUBLED.search(word):
            word = word[:-1]
        elif first >= len(word) and _SHORT_END.search(word):
            word += "e"
    # 1c: a final y after a consonant that isn't the first letter
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    # 2
    end = _ending(word, _STEP2)
    if end and len(word) - len(end) >= first:
        rest = word[: -len(end)]
        if end == "ogi":
            word = rest + "og" if rest.endswith("l") else word
        elif end == "li":
            word = rest if rest[-1:] in tuple("cdeghkmnrt") else word
        else:
            word = rest + _STEP2[end]
    # 3
    end = _ending(word, _STEP3)
    if end and len(word) - len(end) >= first and (end != "ative" or len(word) - len(end) >= second):
        word = word[: -len(end)] + _STEP3[end]
    # 4
    end = _ending(word, _STEP4)
    if end and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    # 5
    if word.endswith("e") and (len(word) - 1 >= second or (len(word) - 1 >= first and not _SHORT_END.search(word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()
