"""Word tokens with offsets, light stems and stop words per language, sentences, and what a text identifies."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

#: Characters that write an apostrophe, and the longest phrase.
APOSTROPHES = "’‘ʼ′"
SHORTEST, LONGEST, INNER_STOPS = 2, 5, 1
_TOKEN = re.compile(rf"\w+(?:['{APOSTROPHES}]\w+)*")
_FOLD = str.maketrans(dict.fromkeys(APOSTROPHES, "'") | {"̇": None})
_YEAR = re.compile("(?:19|20)[0-9]{2}")
#: Words that carry no topic, per language.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have in is it its of on or our that the their this to was we were will with you your".split(),
    "de": "aber als am an auf aus bei das dem den der des die ein eine einem einen einer für im in ist mit nach oder sich sie sind um und vom von wie zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il la le les leur nous ou par pas pour que qui sa se ses son sur un une vos votre".split(),
    "es": "al con de del el en es esta este la las lo los más o para pero por que se sin su sus un una y".split(),
}
#: Month names, January first.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "de": "januar februar märz april mai juni juli august september oktober november dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
#: Endings that a stem loses, the longest that leaves three letters or more.
ENDINGS = {
    "en": ("'s", "ings", "ing", "edly", "ed", "ies", "es", "s", "e"),
    "de": ("ern", "em", "en", "er", "es", "e", "n", "s"),
    "fr": ("ements", "ement", "ées", "és", "ée", "é", "es", "er", "s", "e"),
    "es": ("amientos", "amiento", "aciones", "ación", "ando", "ados", "ado", "ar", "es", "os", "as", "o", "a", "s"),
}


@dataclass(frozen=True, slots=True)
class Word:
    start: int
    end: int
    folded: str


def words(text: str, offset: int = 0) -> list[Word]:
    return [Word(offset + m.start(), offset + m.end(), m[0].casefold().translate(_FOLD)) for m in _TOKEN.finditer(text)]


def vocabulary(text: str) -> set[str]:
    """The distinct words of a text, folded."""
    return {t.casefold().translate(_FOLD) for t in set(_TOKEN.findall(text))}


@functools.lru_cache(1024)
def primary(language: str | None) -> str | None:
    """The language's primary subtag if there are rules for it."""
    code = re.split("[-_]", language)[0].casefold() if language else None
    return code if code in ENDINGS else None


@functools.lru_cache(1 << 16)
def stem(word: str, language: str | None) -> str:
    """A light stem: one ending off, a doubled last consonant single (running, run); the word itself without rules."""
    code = primary(language)
    for ending in ENDINGS.get(code or "", ()):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            cut = word[: -len(ending)] + ("i" if ending == "ies" else "")
            if code == "en" and ending in ("ing", "ings", "ed", "edly") and len(cut) > 3 and cut[-1] == cut[-2] and cut[-1] not in "lsz":
                cut = cut[:-1]
            return cut[:-1] + "i" if code == "en" and cut.endswith("y") else cut
    return word[:-1] + "i" if code == "en" and word.endswith("y") and len(word) > 3 else word


def content(tokens: Iterable[str], language: str | None) -> frozenset[str]:
    """Distinct stems of the tokens that are no stop words."""
    stops = set(STOP_WORDS.get(primary(language) or "", ()))
    return frozenset(stem(t, language) for t in tokens if t not in stops)


def stem_jaccard(phrase: str, keyword: str, language: str | None) -> float:
    """Overlap of the content stems; of all stems where either text holds stop words alone."""
    a, b = ([w.folded for w in words(x)] for x in (phrase, keyword))
    left, right = content(a, language), content(b, language)
    if not left or not right:
        left, right = ({stem(t, language) for t in x} for x in (a, b))
    return len(left & right) / len(left | right) if left | right else 0.0


def gaps(text: str, found: list[Word], offset: int = 0) -> list[str]:
    """What stands before each word but the first: joined (no white space), space, or border (punctuation with white space around)."""
    kinds = []
    for a, b in zip(found, found[1:], strict=False):
        between = text[a.end - offset : b.start - offset]
        kinds.append("space" if not between.strip() else "border" if re.search(r"\s", between) else f"joined {between}")
    return kinds


@functools.lru_cache(1024)
def _months(language: str | None) -> dict[str, int]:
    return {stem(m, language): i for i, m in enumerate(MONTHS.get(primary(language) or "", ()), 1)}


def identifiers(found: list[str], kinds: list[str], language: str | None, brand: frozenset[str] = frozenset()) -> frozenset[str]:
    """Words with a digit, and month:n for a month beside one of them; a brand's own words are neither."""
    digit = [t not in brand and any(c.isdigit() for c in t) for t in found]
    months = _months(language)
    out = {t for t, d in zip(found, digit, strict=True) if d}
    for i, t in enumerate(found):
        if t not in brand and (n := months.get(stem(t, language))):
            before = i > 0 and kinds[i - 1] != "border" and digit[i - 1]
            after = i + 1 < len(found) and kinds[i] != "border" and digit[i + 1]
            if before or after:
                out.add(f"month:{n}")
    return frozenset(out)


def names_one_thing(identifier: str) -> bool:
    """A code: letters with digits, or four digits and more that are no year."""
    if identifier.startswith("month:"):
        return False
    mixed = any(c.isalpha() for c in identifier) and any(c.isdigit() for c in identifier)
    return mixed or (identifier.isdigit() and len(identifier) >= 4 and not _YEAR.fullmatch(identifier))


def sentences(text: str, headings: Iterable[str] = ()) -> list[tuple[int, int, str]]:
    """(number, start, sentence): by line, then after . ! ? or an ellipsis; heading lines are numbered and left out."""
    flat = lambda x: " ".join(x.split()).casefold()
    skip, out, number = {flat(h) for h in headings}, [], 0
    for line in re.finditer(r"[^\r\n]+", text):
        at, hidden = line.start(), flat(line[0]) in skip
        for piece in re.split(r"((?<=[.!?…])\s+)", line[0]):
            inner = piece.strip()
            if inner:
                if not hidden:
                    out.append((number, at + piece.index(inner), inner))
                number += 1
            at += len(piece)
    return out


def word_count(phrase: str) -> int:
    """Words of a phrase; what is joined without white space is one."""
    found = words(phrase)
    return len(found) - sum(k.startswith("joined") for k in gaps(phrase, found))
