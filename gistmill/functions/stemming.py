"""Word stems by the published Snowball rules: English (Porter2) for words in ASCII letters, Russian for others.

The rules work on one word.  Workers remember the words that they have stemmed, so a column costs little more than a lookup for each word.
"""

from __future__ import annotations

import functools
import re

# Fixed values of the two algorithms: endings, in the order in which they are tried, and exceptions.
_VOWELS = "aeiouy"
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAYS_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
# Most words have none of a step's endings, which one comparison with all of them tells.
_ENDS_2, _ENDS_3, _ENDS_4 = tuple(x for x, _ in _STEP_2), tuple(x for x, _ in _STEP_3), tuple(_STEP_4)
_VOWEL, _REGION, _SPECIAL = re.compile(f"[{_VOWELS}]"), re.compile(r"[aeiouy][^aeiouy]"), re.compile(r"gener|commun|arsen")
_Y_AFTER, _OWNED, _EED, _PAST = re.compile(r"(?<=[aeiouy])y"), re.compile(r"'s'$|'s$|'$"), re.compile(r"eedly$|eed$"), re.compile(r"ingly$|edly$|ing$|ed$")
_TWICE, _Y_LAST = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), re.compile(r"[^aeiouy][yY]$")
_SHORT, _SHORT_WORD = re.compile(r"[^aeiouy][aeiouy][^aeiouywxY]$"), re.compile(r"[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, and again from there."""
    head = _SPECIAL.match(word)
    r1 = head.end() if head else (m.end() if (m := _REGION.search(word)) else len(word))
    m = _REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(_SHORT.search(word) or _SHORT_WORD.fullmatch(word))


def english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = _Y_AFTER.sub("Y", word.lstrip("'"))
    w = "Y" + w[1:] if w.startswith("y") else w
    r1, r2 = _regions(w)
    w = _OWNED.sub("", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _STAYS_AFTER_PLURAL:
        return w
    # past and progressive forms
    if m := _EED.search(w):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif (m := _PAST.search(w)) and _VOWEL.search(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _TWICE.search(w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if _Y_LAST.search(w) and len(w) > 2:
        w = w[:-1] + "i"
    # derived words
    for end, by in _STEP_2 if w.endswith(_ENDS_2) else ():
        if w.endswith(end):
            w = w[: -len(end)] + by if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, by in _STEP_3 if w.endswith(_ENDS_3) else ():
        if w.endswith(end):
            w = w[: -len(end)] + by if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP_4 if w.endswith(_ENDS_4) else ():
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Fixed values of the Russian rules: endings by kind; those marked stand only after а or я, which stay.
_GERUND_AFTER, _GERUND = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE_AFTER, _PARTICIPLE = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB_AFTER = ("йте", "ете", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н")
_VERB = (
    "ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю",
)
_NOUN = (
    "иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я",
)
_VOWELS_RU = "аеиоуыэюя"
_VOWEL_RU, _REGION_RU = re.compile(f"[{_VOWELS_RU}]"), re.compile(f"[{_VOWELS_RU}][^{_VOWELS_RU}]")


@functools.cache
def _longest_first(plain: tuple[str, ...], after: tuple[str, ...]) -> list[str]:
    return sorted((*plain, *after), key=len, reverse=True)


def _cut(word: str, plain: tuple[str, ...], after: tuple[str, ...] = ()) -> str | None:
    """The word without its longest ending of either kind; null where there is none."""
    for end in _longest_first(plain, after) if word.endswith(plain + after) else ():
        if word.endswith(end):
            if end in plain:
                return word[: -len(end)]
            if word[: -len(end)].endswith(("а", "я")):
                return word[: -len(end)]
    return None


def russian(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("ё", "е")
    first = _VOWEL_RU.search(w)
    if not first:
        return w
    r1 = m.end() if (m := _REGION_RU.search(w)) else len(w)
    r2 = m.end() if (m := _REGION_RU.search(w, r1)) else len(w)
    head, rest = w[: first.end()], w[first.end() :]
    cut = _cut(rest, _GERUND, _GERUND_AFTER)
    if cut is None:
        rest = next((rest[: -len(x)] for x in _REFLEXIVE if rest.endswith(x)), rest)
        cut = _cut(rest, _ADJECTIVE)
        if cut is not None:
            shorter = _cut(cut, _PARTICIPLE, _PARTICIPLE_AFTER)
            cut = cut if shorter is None else shorter
        else:
            cut = _cut(rest, _VERB, _VERB_AFTER)
            cut = _cut(rest, _NOUN) if cut is None else cut
    rest = rest if cut is None else cut
    rest = rest.removesuffix("и")
    for end in ("ость", "ост"):
        if rest.endswith(end):
            rest = rest[: -len(end)] if len(head) + len(rest) - len(end) >= r2 else rest
            break
    if rest.endswith("нн"):
        rest = rest[:-1]
    elif m := re.search(r"ейше?$", rest):
        rest = rest[: m.start()].removesuffix("н") if not rest[: m.start()].endswith("нн") else rest[: m.start() - 1]
    elif rest.endswith("ь"):
        rest = rest[:-1]
    return head + rest


def stem(word: str) -> str:
    """A word with letters beyond ASCII is stemmed as Russian, others as English; numbers stay."""
    return english(word) if word.isascii() else russian(word)
