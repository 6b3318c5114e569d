"""Japanese inflection: kana after kanji are read as chains of endings, conditioned by word class, and taken off.

A word is kanji, up to two kana that belong to the stem, and the longest chain of endings that the classes allow: godan verbs by
the row that a stem ends in, ichidan verbs, adjectives, and auxiliaries (passive, causative, desire, progress, politeness), which
inflect in turn. What is left is the same for all forms of a word. Particles and numbers are told apart. No dictionary is used:
a form that two classes share, such as a past in かった, is read as an adjective's, and words that differ by class only are one.
"""

from __future__ import annotations

import re
import unicodedata

from .text import HAN, HIRAGANA, KATAKANA, ranges

# Rows of kana that godan stems end in, by vowel.
ROW_A, ROW_I, ROW_E, ROW_O, ROW_U = "かがさたなばまらわ", "きぎしちにびみりい", "けげせてねべめれえ", "こごそとのぼもろお", "くぐすつぬぶむるう"


def _endings() -> str:
    """All chains of endings as a pattern."""
    polite = "ま(?:す|した|せん(?:でした)?|しょう)"
    adjective = "(?:い|くな(?:い|く(?:て)?|かった|ければ)|くて|く|かった|ければ)"
    negative = "(?:な(?:い|く(?:て)?|かった|ければ)|ず)"
    desire = f"た{adjective}"
    plain = f"(?:る|れば|よう|ろ|{polite}|{negative}|{desire}|た(?:ら|り)?|て|ながら)"  # after the stem of an ichidan verb
    progress = f"い?{plain}"
    ichidan = f"(?:られ|させ)*(?:て{progress}|{plain})"
    godan = "|".join((
        f"[{ROW_U}]",
        f"[{ROW_I}](?:{polite}|{desire}|ながら)",
        f"[{ROW_A}](?:{negative}|(?:せられ|され|れ|せ){ichidan})",
        f"[{ROW_E}](?:ば|{ichidan})",
        f"[{ROW_O}]う",
        f"[いっし](?:て{progress}|て|た(?:ら|り)?)",
        f"[んい](?:で{progress}|で|だ(?:ら|り)?)",
    ))
    return f"(?:{godan}|[{ROW_I}{ROW_E}]?{ichidan}|{adjective}|す(?:る|れば))"


INFLECTED = re.compile(_endings())
#: Beginnings of the forms of する.
NOUN_VERB = re.compile("し|す(?:る|れ)|さ(?:れ|せ)")
#: Most kana of a stem; kana that a stem doesn't have right after kanji, as they are particles; what may follow one in が.
#: Kana that a stem and its endings may have together, more than any chain of them comes to.
LONGEST_CHAIN = 32
STEM_KANA, NEVER_KEPT, GA_ROW = 2, frozenset("はをにへのでもと"), tuple("らりるれろっ")
# Particles and forms of the copula, which no search needs.
PARTICLES = frozenset("は が を に で と も の へ や か ね よ な ぞ わ から まで より など だけ しか ので のに けど けれど って です でした でしょう だ だった なら ば".split())
_LEADING = re.compile("|".join(sorted(PARTICLES, key=len, reverse=True)))
# Kanji of numbers.
DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")}
SMALL_UNITS, LARGE_UNITS = {"十": 10, "百": 100, "千": 1000}, {"万": 10**4, "億": 10**8, "兆": 10**12}
NUMERAL = f"0-9{''.join(DIGITS)}{''.join(SMALL_UNITS)}{''.join(LARGE_UNITS)}"
_TOKEN = re.compile(
    rf"(?P<n>[0-9][{NUMERAL}]*(?:[.,][0-9]+)*|[{NUMERAL}]{{2,}})|(?P<k>(?:(?![{NUMERAL}]{{2}})[{ranges(HAN)}々])+)(?P<o>[{ranges(HIRAGANA)}]*)"
    rf"|(?P<h>[{ranges(HIRAGANA)}]+)|(?P<t>[{ranges(KATAKANA)}ー]+)|(?P<w>[^\W_0-9{ranges(HAN)}{ranges(HIRAGANA)}{ranges(KATAKANA)}ー][^\W_{ranges(HAN)}{ranges(HIRAGANA)}{ranges(KATAKANA)}ー]*)"
)


def number(text: str) -> str:
    """A number in kanji, digits or both as digits; what isn't one stays."""
    plain = text.replace(",", "")
    if plain.replace(".", "", 1).isdigit() and plain.isascii():
        return plain
    if "." in plain:
        return text
    if all(c in DIGITS or c.isascii() for c in plain):  # digit by digit
        return "".join(c if c.isascii() else str(DIGITS[c]) for c in plain)
    whole = part = here = 0
    said = False  # a digit that no unit has taken yet
    for c in plain:
        if c in DIGITS or c.isascii():
            here, said = here * 10 * said + (DIGITS[c] if c in DIGITS else int(c)), True
        elif c in SMALL_UNITS:
            part, here, said = part + (here if said else 1) * SMALL_UNITS[c], 0, False
        else:
            whole, part, here, said = whole + ((part + here) or 1) * LARGE_UNITS[c], 0, 0, False
    return str(whole + part + here)


def _may_keep(kana: str, keep: int) -> bool:
    """Whether the first kana can belong to a stem: particles can't, が only in stems of the row of ら, as in 上がる."""
    kept = kana[:keep]
    return not (set(kept) & NEVER_KEPT or "が" in kept[:-1] or kept.endswith("が") and kana[keep : keep + 1] not in GA_ROW)


def split_okurigana(kana: str) -> tuple[int, int]:
    """(kana of the stem, kana of stem and endings) of what follows kanji: the longest chain, with the fewest kana of the stem."""
    best, kana = (0, 0), kana[:LONGEST_CHAIN]
    for keep in range(min(STEM_KANA, len(kana) - 1) + 1):
        if _may_keep(kana, keep):
            end = next((e for e in range(len(kana), max(keep, best[1]), -1) if INFLECTED.fullmatch(kana, keep, e)), 0)
            best = (keep, end) if end else best
    return best


def base_tokens(text: str) -> list[tuple[str, int, int, int]]:
    """(term, pos, start, end): stems of inflected words, numbers as digits, other words; katakana as hiragana, lower case.

    Particles go, and so do words of one letter. text is in normal form (NFKC).
    """
    out: list[tuple[str, int, int, int]] = []
    pos = 0

    def add(term: str, start: int, end: int) -> None:
        nonlocal pos
        if end - start >= 2 or term.isdigit():
            folded = "".join(chr(ord(c) - 96) if "ァ" <= c <= "ヶ" else c for c in term.lower())
            out.append((folded, pos, start, end))
        pos += 1

    def kana(start: int, end: int) -> None:
        while start < end and text[start:end] not in PARTICLES and (m := _LEADING.match(text, start, end)) and end - m.end() >= 2:
            start = m.end()
        if start < end and text[start:end] not in PARTICLES:
            add(text[start:end], start, end)

    for m in _TOKEN.finditer(text):
        if m["n"]:
            add(number(m["n"]), m.start(), m.end())
        elif m["k"]:
            o = m.start("o")
            keep, end = split_okurigana(m["o"])
            if not keep and o - m.start() >= 2 and NOUN_VERB.match(m["o"]):  # a noun with the verb する, a word by itself
                add(m["k"], m.start(), o)
            else:
                add(text[m.start() : o + keep] if end else m["k"], m.start(), o + end)
            if o + end < m.end():
                kana(o + end, m.end())
        elif m["h"]:
            kana(m.start(), m.end())
        else:
            add(m[0], m.start(), m.end())
    return out


def analysed(text: str) -> list[tuple[str, int, int, int]]:
    """`base_tokens` of any text, with places in the text as it is written."""
    from .analyzers import normalized

    if unicodedata.is_normalized("NFKC", text):
        return base_tokens(text)
    clean, at = normalized(text)
    return [(t, p, at[a], max(at[b], at[a] + 1)) for t, p, a, b in base_tokens(clean)]
