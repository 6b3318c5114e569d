"""Text analysis for the index: a text to tokens (term, pos, start, end), Arrow-batched.

Plain functions take a string; `analyzed` lifts them to columns. The analyzer of Japanese inflection is an approximation by
rules of endings (`functions.inflection`): there is no dictionary to look words up in. It can be replaced through `register`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import memo
from .text import HAN, HIRAGANA, KATAKANA, ranges

Token = tuple[str, int, int, int]
TOKENS = "array<struct<term:string,pos:int,start:int,end:int>>"
# English stop words of the usual analyzer.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Combining marks of kana, which carry meaning and are kept when accents are folded.
KANA_MARKS = chr(0x3099) + chr(0x309A)


def _class(points) -> str:  # noqa: ANN001
    return f"[{ranges(points)}]"


def _regex():  # noqa: ANN202
    import regex

    return regex


def normalized(text: str) -> tuple[str, Sequence[int]]:
    """NFKC, and for each of its characters and the end the place in the text that it comes from."""
    if text.isascii() or unicodedata.is_normalized("NFKC", text):
        return text, range(len(text) + 1)
    out, at = [], []
    i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or text[j] in "ﾞﾟ"):
            j += 1
        piece = unicodedata.normalize("NFKC", text[i:j])
        out.append(piece)
        at += [i] * len(piece)
        i = j
    return "".join(out), [*at, len(text)]


#: Marks of Latin letters, all without a width of their own.
MARKS = re.compile("[\u0300-\u036f]+")


@memo(100_000)
def folded(term: str) -> str:
    """Case and accents folded, but for the marks of kana."""
    if term.isascii():
        return term.lower()
    parts = unicodedata.normalize("NFD", term.casefold())
    if (bare := MARKS.sub("", parts)).isascii():
        return bare
    kept = []
    for i, c in enumerate(parts):
        kana = i > 0 and 0x3040 <= ord(parts[i - 1]) <= 0x30FF
        if not (unicodedata.category(c) == "Mn" and not (kana and c in KANA_MARKS)):
            kept.append(c)
    return unicodedata.normalize("NFC", "".join(kept))


def hiragana(term: str) -> str:
    return "".join(chr(ord(c) - 96) if "ァ" <= c <= "ヶ" else c for c in term)


@memo(100_000)
def split_formation(term: str, strict_compat: bool = False) -> tuple[str, ...]:
    """Parts of a fleet name such as 4thdesdiv3; other terms as they are.

    strict_compat: digits aren't parts, as where the pattern's escapes are doubled by mistake.
    """
    if "div" not in term and "ron" not in term:
        return (term,)
    number = "" if strict_compat else r"(\d+(?:st|nd|rd|th))?"
    m = _regex().fullmatch(number + r"((?:bat|car|cru|des)(?:div|ron))" + ("" if strict_compat else r"(\d+)?"), term)
    return tuple(g for g in m.groups() if g) if m else (term,)


@memo(500_000)
def _parts(word: str, strict_compat: bool = False) -> tuple[str, ...]:
    """The terms of a word as it is written."""
    return split_formation(folded(word).replace("’", "'"), strict_compat)


#: Letters but y as v or c; letters beyond ASCII count as consonants.
VOWELS = type("Vowels", (dict,), {"__missing__": lambda self, c: "v" if chr(c) in "aeiou" else "y" if chr(c) == "y" else "c"})()
VOWELS.update({i: VOWELS[i] for i in range(128)})  # found without a call
CJK = "|".join((_class(HIRAGANA), _class(KATAKANA), _class(HAN), "ー"))


#: What the pattern of words below is for ASCII.
ASCII_WORDS = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_]|['.:](?=[A-Za-z])|[.,](?=[0-9]))*")


@memo(1)
def _word_patterns():  # noqa: ANN202
    cjk = re.compile(f"[{''.join(map(ranges, (HIRAGANA, KATAKANA, HAN)))}ー]")  # a class of `re` is quicker than of `regex`
    return cjk, _regex().compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}_]|['’.:](?=\p{L})|[.,](?=\p{N}))*")


@memo(1)
def _mixed_pattern():  # noqa: ANN202
    return _regex().compile(rf"(?P<c>{CJK})[{KANA_MARKS}]*|[\p{{L}}\p{{N}}](?:(?!{CJK})[\p{{L}}\p{{N}}\p{{M}}_]|['’.:](?=\p{{L}})(?!{CJK})|[.,](?=\p{{N}}))*")


def default_tokens(text: str, strict_compat: bool = False) -> list[Token]:
    """NFKC, words, folding, katakana as hiragana, fleet names in parts, CJK letters as overlapping pairs (alone: as they are)."""
    clean, at = normalized(text)
    every, words = _word_patterns()
    if clean.isascii():
        return [(part, i, m.start(), m.end()) for i, m in enumerate(ASCII_WORDS.finditer(clean)) for part in _parts(m[0], strict_compat)]
    if not every.search(clean):
        return [(part, i, at[m.start()], at[m.end()]) for i, m in enumerate(words.finditer(clean)) for part in _parts(m[0], strict_compat)]
    out: list[Token] = []
    pos = 0
    run: list[tuple[str, int, int]] = []

    def flush() -> None:
        nonlocal pos, run
        if len(run) == 1:
            out.append((hiragana(run[0][0]), pos, run[0][1], run[0][2]))
            pos += 1
        for a, b in zip(run, run[1:], strict=False):
            out.append((hiragana(a[0] + b[0]), pos, a[1], b[2]))
            pos += 1
        run = []

    for m in _mixed_pattern().finditer(clean):
        start, end = at[m.start()], at[m.end()]
        end = max(end, start + 1)
        if m["c"]:
            if run and run[-1][2] != start:
                flush()
            run.append((folded(m[0]), start, end))
            continue
        flush()
        for part in _parts(m[0], strict_compat):
            out.append((part, pos, start, end))
        pos += 1
    flush()
    return out


#: Tokens of many texts: the text of each token, the number of its term, (pos, start, end); and the terms.
Columns = tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]


def columns_of(texts: list[str | None], run: Callable[[str], list[Token]]) -> Columns:
    """Tokens of texts by any analyzer."""
    tokens = [run(t) if t else [] for t in texts]
    of = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
    number: dict[str, int] = {}
    code = np.array([number.setdefault(t[0], len(number)) for doc in tokens for t in doc], np.int64)
    spots = np.array([t[1:] for doc in tokens for t in doc], np.int32).reshape(-1, 3)
    return of, code, spots, pa.array(list(number), pa.string())


#: Kinds of characters in the pattern of words: inside a word, a letter, a number, between letters, between numbers.
INSIDE, LETTER, NUMBER, JOINS_LETTERS, JOINS_NUMBERS = 1, 2, 4, 8, 16


@memo(1)
def _kinds() -> np.ndarray:
    """The kinds of the characters below U+10000."""
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))  # surrogates are no characters
    kinds = np.zeros(0x10000, np.uint8)
    for pattern, kind in ((r"[\p{L}\p{N}\p{M}_]", INSIDE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER), ("['’.:]", JOINS_LETTERS), ("[.,]", JOINS_NUMBERS)):
        kinds[[ord(c) for c in _regex().findall(pattern, points)]] |= kind
    return kinds


def default_columns(texts: list[str | None]) -> Columns:
    """`default_tokens` of many texts at once: words are found by the kinds of all characters, terms are made by distinct word.

    Texts with CJK letters, with characters beyond U+FFFF, or that NFKC changes go one by one.
    """
    beyond = re.compile(f"{_word_patterns()[0].pattern[:-1]}\U00010000-\U0010ffff]")
    hard = [i for i, t in enumerate(texts) if t and not t.isascii() and (not unicodedata.is_normalized("NFKC", t) or beyond.search(t))]
    plain = [t or "" for t in texts]
    for i in hard:
        plain[i] = ""
    parts, begin, size = [], 0, 0
    for i, t in enumerate(plain):
        size += len(t) + 1
        if size > 250_000 or i + 1 == len(plain):  # few enough for a processor's cache
            of, spots, words = _words(plain[begin : i + 1])
            parts.append((of + begin, spots, words))
            begin, size = i + 1, 0
    of, code, spots, terms = _termed(*zip(*parts, strict=True))
    if not hard:
        return of, code, spots, terms
    of_, code_, spots_, terms_ = columns_of([texts[i] for i in hard], default_tokens)
    both = pa.concat_arrays([terms, terms_]).dictionary_encode()
    number = both.indices.to_numpy()
    code = np.concatenate((number[: len(terms)][code], number[len(terms) :][code_]))
    return np.concatenate((of, np.array(hard)[of_])), code, np.concatenate((spots, spots_)), both.dictionary


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text, (pos, start, end) and letters of each word, A to Z folded."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(lengths + 1) - lengths - 1  # a line feed stands between two texts
    joined = "\n".join(texts)
    ascii_ = joined.isascii()
    points = np.frombuffer(joined.encode(), np.uint8) if ascii_ else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[points]
    after = np.append(kinds[1:], np.uint8(0))
    inside = ((kinds & INSIDE) > 0) | (((kinds & JOINS_LETTERS) > 0) & ((after & LETTER) > 0)) | (((kinds & JOINS_NUMBERS) > 0) & ((after & NUMBER) > 0))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    # a word begins with the first letter or number of a run
    late = np.flatnonzero((kinds[start] & (LETTER | NUMBER)) == 0)
    if len(late):
        first = np.append(np.flatnonzero(kinds & (LETTER | NUMBER)), len(points))
        start[late] = first[np.searchsorted(first, start[late])]
        start, end = start[start < end], end[start < end]
    of = np.searchsorted(begins, start, "right") - 1
    if not len(of):
        return of, np.zeros((0, 3), np.int32), pa.array([], pa.large_string())
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    pos = np.arange(len(of)) - np.repeat(firsts, np.diff(np.append(firsts, len(of))))
    spots = np.stack((pos, start - begins[of], end - begins[of]), 1).astype(np.int32)
    # words and what is between them are strings by turns
    lower = points + ((points >= 65) & (points <= 90)).astype(np.uint8) * np.uint8(32)
    cuts = np.stack((start, end), 1).ravel()
    if not ascii_:
        size = np.uint8(1) + (points >= 0x80) + (points >= 0x800)
        cuts = np.append(0, np.cumsum(size, dtype=np.int64))[cuts]
    data = lower.tobytes() if ascii_ else lower.tobytes().decode("utf-32-le").encode()
    turns = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    return of, spots, turns.take(pa.array(np.arange(0, len(cuts) - 1, 2)))


def _termed(of: Sequence[np.ndarray], spots: Sequence[np.ndarray], words: Sequence[pa.Array]) -> Columns:
    """The columns of words, each put in its terms' place."""
    of, spots, found = np.concatenate(of), np.concatenate(spots), pa.concat_arrays(words).dictionary_encode()
    code, distinct = found.indices.to_numpy(), found.dictionary.cast(pa.string())
    whole = pc.and_not(pc.string_is_ascii(distinct), pc.or_(pc.match_substring(distinct, "div"), pc.match_substring(distinct, "ron"))).to_numpy(zero_copy_only=False)
    parts = [_parts(w) for w in distinct.filter(pa.array(~whole)).to_pylist()]
    n = np.ones(len(distinct), np.int64)
    n[~whole] = np.fromiter(map(len, parts), np.int64, len(parts))
    made = pa.concat_arrays([distinct.filter(pa.array(whole)), pa.array([p for x in parts for p in x], pa.string())]).dictionary_encode()
    at, number = np.empty(len(distinct), np.int64), made.indices.to_numpy()
    at[whole] = np.arange(whole.sum())
    at[~whole] = whole.sum() + np.cumsum(n[~whole]) - n[~whole]
    if n.max(initial=0) <= 1:
        return of, number[at[code]], spots, made.dictionary
    times = n[code]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(of, times), number[np.repeat(at[code], times) + within], np.repeat(spots, times, 0), made.dictionary


def kanji_tokens(text: str) -> list[Token]:
    return [(m[0], i, m.start(), m.end()) for i, m in enumerate(_regex().finditer(_class(HAN), text))]


def english_spans(text: str) -> list[Token]:
    """The tokens that word counts and alignments go by."""
    return [(m[0], i, m.start(), m.end()) for i, m in enumerate(_regex().finditer(r"\p{L}+(?:['’]\p{L}+)*|\d+(?:[,.]\d+)*", text))]


def japanese_spans(text: str) -> list[Token]:
    """Runs of one script, in order; symbols are left out. Approximate (see the head of this module)."""
    re = _regex()
    pattern = f"{_class(HAN)}+|{_class(HIRAGANA)}+|(?:{_class(KATAKANA)}|ー)+|[\\p{{L}}\\p{{N}}]+"
    return [(m[0], i, m.start(), m.end()) for i, m in enumerate(re.finditer(pattern, text))]


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = word.translate(VOWELS)
    while "y" in out:
        i = out.index("y")
        out = out[:i] + ("v" if i and out[i - 1] == "c" else "c") + out[i + 1 :]
    return out


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _by_last_two(steps: str) -> dict[str, list[tuple[str, str]]]:
    """Endings and what takes their place, in order, by their last two letters."""
    out: dict[str, list[tuple[str, str]]] = {}
    for pair in steps.split():
        end, new = pair.split(":")
        out.setdefault(end[-2:], []).append((end, new))
    return out


#: Porter's steps 2 to 4, each with the measure that what is left must exceed.
ENDINGS = (
    (_by_last_two("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"), 0),
    (_by_last_two("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"), 0),
    (_by_last_two("ement: ance: ence: able: ible: ment: ant: ent: ism: ate: iti: ous: ive: ize: ion: al: er: ic: ou:"), 1),
)


@memo(100_000)
def stem(word: str) -> str:
    """Porter's stemmer (1980)."""
    if len(word) < 3:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for endings, least in ENDINGS:
        for end, new in endings.get(w[-2:], ()):
            if w.endswith(end):
                base = w[: -len(end)]
                if _measure(base) > least and (end != "ion" or base[-1:] in ("s", "t")):
                    w = base + new
                break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@memo(500_000)
def _stemmed(term: str) -> str | None:
    t = term.removesuffix("'s")
    return None if t in STOP_WORDS else stem(t)


def english_conjugation_tokens(text: str) -> list[Token]:
    return [(t, pos, start, end) for term, pos, start, end in default_tokens(text) if (t := _stemmed(term)) is not None]


#: Analyzers that only put another term, or none, in place of each term of another analyzer.
DERIVED: dict[str, tuple[str, Callable[[str], str | None]]] = {"english_conjugations": ("default", _stemmed)}


def japanese_conjugation_tokens(text: str) -> list[Token]:
    """Stems of inflected words, see `functions.inflection`."""
    from .inflection import analysed

    return analysed(text)


ANALYZERS: dict[str, Callable[[str], list[Token]]] = {
    "default": default_tokens,
    "english_conjugations": english_conjugation_tokens,
    "japanese_conjugations": japanese_conjugation_tokens,
    "kanji": kanji_tokens,
    "english_words": english_spans,
    "japanese_words": japanese_spans,
}


#: Analyzers that have a form for many texts.
BATCHED: dict[Callable[[str], list[Token]], Callable[[list[str | None]], Columns]] = {default_tokens: default_columns}


def register(name: str, analyzer: Callable[[str], list[Token]]) -> None:
    """Use another analyzer under a name, such as one with a dictionary."""
    ANALYZERS[name] = analyzer
    DERIVED.pop(name, None)


def analyzed(text: Column, name: str) -> Column:
    """array<struct<term, pos, start, end>> of a text; null has no tokens."""
    return tokens_by(text, ANALYZERS[name])


def tokens_by(text: Column, run: Callable[[str], list[Token]], many: Callable[[list[str]], list[list[Token]]] | None = None) -> Column:
    """The same by an analyzer that has no name; many: its form for some hundred texts at once. Tokens go into Arrow arrays, of a few hundred texts at a time."""

    @F.arrow_udf(TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.concat_arrays([_token_lists(b.slice(i, 200), run, many) for i in range(0, max(len(b), 1), 200)])

    return tokens(text)


def _token_lists(texts: pa.Array, run: Callable[[str], list[Token]], many: Callable[[list[str]], list[list[Token]]] | None = None) -> pa.Array:
    ends, columns = [0], ([], [], [], [])
    plain = [x or "" for x in texts.to_pylist()]
    for found in many(plain) if many else map(run, plain):
        for t in found:
            for c, v in zip(columns, t, strict=True):
                c.append(v)
        ends.append(len(columns[0]))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "pos", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
