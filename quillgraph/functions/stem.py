"""Snowball stemmers after their published definitions: English (Porter 2) and Russian."""

from __future__ import annotations

import re

VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# English words with stems of their own, and those that step 1a leaves alone.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffixes and their replacements, longest first where they overlap.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    region = lambda at: m.end() if (m := re.compile("[aeiouy][^aeiouy]").search(w, at)) else len(w)
    r1 = region(0) if r1 is None else r1
    return r1, region(r1)


def _short_end(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w)) or bool(re.fullmatch("[aeiouy][^aeiouy]", w))


def english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(f"(^|[{VOWELS}])y", lambda m: m[1] + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if not w.endswith(end):
            continue
        if end in ("eedly", "eed"):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
        elif re.search(f"[{VOWELS}]", w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1 : at] == "l") and (end != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= (r2 if end == "ative" else r1):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_RU_VOWELS = "аеиоуыэюя"
# Russian endings by class; those in the first of a pair must follow а or я.
_GERUND = (["в", "вши", "вшись"], ["ив", "ивши", "ившись", "ыв", "ывши", "ывшись"])
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE = (["ем", "нн", "вш", "ющ", "щ"], ["ивш", "ывш", "ующ"])
_REFLEXIVE = ["ся", "сь"]
_VERB = (
    "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(),
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split(),
)
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
_SUPERLATIVE = ["ейш", "ейше"]
_DERIVATIONAL = ["ост", "ость"]


def _cut(w: str, rv: int, endings: list[str], after: bool = False) -> str | None:
    """``w`` without its longest ending among those that lie in the region."""
    best = max((e for e in endings if w.endswith(e) and len(w) - len(e) >= rv), key=len, default=None)
    if best is None or (after and not (w[: -len(best)][rv:] and w[: -len(best)][-1] in "ая")):
        return None
    return w[: -len(best)]


def _either(w: str, rv: int, pair: tuple[list[str], list[str]]) -> str | None:
    a, b = _cut(w, rv, pair[0], True), _cut(w, rv, pair[1])
    found = [x for x in (a, b) if x is not None]
    return min(found, key=len) if found else None


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    first = next((i for i, c in enumerate(w) if c in _RU_VOWELS), None)
    if first is None:
        return w
    rv = first + 1
    region = lambda at: m.end() if (m := re.compile(f"[{_RU_VOWELS}][^{_RU_VOWELS}]").search(w, at)) else len(w)
    r2 = region(region(0))
    cut = _either(w, rv, _GERUND)
    if cut is None:
        base = _cut(w, rv, _REFLEXIVE) or w
        cut = _cut(base, rv, _ADJECTIVE)
        if cut is not None:
            cut = _either(cut, rv, _PARTICIPLE) or cut
        else:
            cut = _either(base, rv, _VERB)
            if cut is None:
                cut = _cut(base, rv, _NOUN)
            if cut is None:
                cut = base
    w = cut
    if w.endswith("и") and len(w) > rv:
        w = w[:-1]
    w = _cut(w, max(r2, rv), _DERIVATIONAL) or w
    if w.endswith("нн"):
        return w[:-1]
    shorter = _cut(w, rv, _SUPERLATIVE)
    if shorter is not None:
        return shorter[:-1] if shorter.endswith("нн") else shorter
    return w[:-1] if w.endswith("ь") and len(w) > rv else w


def stem(token: str) -> str:
    """As the index keeps a token: verbatim with a hyphen or digit, else by its script."""
    if "-" in token or any("0" <= c <= "9" for c in token):
        return token
    if any("Ѐ" <= c <= "ӿ" for c in token):
        return russian(token)
    return english(token)
