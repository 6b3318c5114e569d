"""Text functions and predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that may open and close a wrapped quotation; they need not pair.
OPENING, CLOSING = "\"“「『", "\"”」』"
#: Kanji or hiragana, as imports want them.
KANJI_OR_HIRAGANA = "[一-龠ぁ-ゔ]"
#: Kanji, both kana and their marks, as scraped pages are judged.
JAPANESE_LETTERS = "[一-龠ぁ-ゔァ-ヴー々〆〤ヶ]"
# Script ranges, inclusive code points.
HIRAGANA = ((0x3041, 0x3096), (0x309D, 0x309E), (0x309F, 0x309F), (0x1B001, 0x1B11F), (0x1B132, 0x1B132), (0x1B150, 0x1B152), (0x1F200, 0x1F200))
KATAKANA = ((0x30A1, 0x30FA), (0x30FD, 0x30FE), (0x30FF, 0x30FF), (0x31F0, 0x31FF), (0x32D0, 0x32FE), (0x3300, 0x3357), (0xFF66, 0xFF6F), (0xFF71, 0xFF9D), (0x1AFF0, 0x1AFF3), (0x1AFF5, 0x1AFFB), (0x1AFFD, 0x1AFFE), (0x1B000, 0x1B000), (0x1B120, 0x1B122), (0x1B155, 0x1B155), (0x1B164, 0x1B167))
HAN = ((0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303A), (0x303B, 0x303B), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFA6D), (0xFA70, 0xFAD9), (0x16FE2, 0x16FE2), (0x16FE3, 0x16FE3), (0x16FF0, 0x16FF1), (0x20000, 0x2A6DF), (0x2A700, 0x2B739), (0x2B740, 0x2B81D), (0x2B820, 0x2CEA1), (0x2CEB0, 0x2EBE0), (0x2EBF0, 0x2EE5D), (0x2F800, 0x2FA1D), (0x30000, 0x3134A), (0x31350, 0x323AF))
# Words of English text (letters with inner apostrophes, or digits with inner separators) and a mention in a query.
ENGLISH_TOKEN = r"\p{L}+(?:['’]\p{L}+)*|\d+(?:[,.]\d+)*"
MENTION = r"(?U)\s*(?<!\S)[@＠](\S+)\s*"


def ranges(points) -> str:  # noqa: ANN001
    """The inside of a character class, for Java's patterns and for `regex`."""
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in points)


def trim_unicode(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def unwrapped(s: Column) -> Column:
    """Trimmed, without one pair of wrapping quotation marks; a lone mark stays."""
    t = trim_unicode(s)
    return F.when(t.rlike(f"(?s)^[{OPENING}].*[{CLOSING}]$"), trim_unicode(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def format_english(s: Column) -> Column:
    """Unwrapped, every run of white space one space."""
    return F.regexp_replace(unwrapped(s), r"(?U)\s+", " ")


def format_japanese(s: Column) -> Column:
    """Unwrapped, line breaks removed."""
    return F.regexp_replace(unwrapped(s), r"[\r\n]", "")


def has_kanji_or_hiragana(s: Column) -> Column:
    return s.rlike(KANJI_OR_HIRAGANA)


def has_japanese_letters(s: Column) -> Column:
    return s.rlike(JAPANESE_LETTERS)


def is_japanese(s: Column) -> Column:
    """Any character of the three scripts, as searches are judged."""
    return s.rlike(f"[{ranges(HIRAGANA)}{ranges(KATAKANA)}{ranges(HAN)}]")


def is_single_kanji(s: Column) -> Column:
    return s.rlike(f"^[{ranges(HAN)}]$")


def japanese_ratio(s: Column) -> Column:
    return F.regexp_count(s, F.lit(JAPANESE_LETTERS)) / F.greatest(F.length(s), F.lit(1))


def is_missing(s: Column) -> Column:
    """Nothing but white space and question marks."""
    return s.rlike(r"^(?U)[\s\?]*$")


def english_tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(ENGLISH_TOKEN), F.lit(0))


def word_count(s: Column) -> Column:
    return F.size(english_tokens(s))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def base_name(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def html_encode(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def file_uri(source: Column, path: Column, inner: Column | None = None) -> Column:
    uri = F.concat(F.lit("file:///"), source, F.lit("/"), F.translate(path, "\\", "/"))
    return uri if inner is None else F.concat(uri, F.when(inner.isNotNull(), F.concat(F.lit("#"), F.translate(inner, "\\", "/"))).otherwise(""))


def kana_folded(s: Column) -> Column:
    """Lower-case, katakana as hiragana, as names are matched while typing."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(F.lower(s), kata, "".join(chr(ord(c) - 96) for c in kata))


def content_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (
        F.when(ext == "mp3", "audio/mpeg").when(ext.isin("ogg", "opus"), "audio/ogg").when(ext == "m4a", "audio/mp4").otherwise(F.raise_error(F.concat(F.lit("unknown extension: "), F.coalesce(name, F.lit("")))))
    )


def fallback_name(name: Column) -> Column:
    """The .m4a beside a file that isn't .mp3; null for .mp3."""
    return F.when(~F.lower(name).endswith(".mp3"), F.regexp_replace(name, r"\.[^.]+$", ".m4a"))


def scene_title(title: Column, language: Column, mapped: Column | None = None) -> Column:
    """A mapped title, else the trimmed one; English: full-width spaces as spaces and a capital first letter."""
    t = F.translate(title, "　", " ")
    english = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    plain = trim_unicode(F.when(language == "en", english).otherwise(title))
    return plain if mapped is None else F.coalesce(mapped, plain)


def speaker_or_placeholder(name: Column, language: Column) -> Column:
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.when(language == "ja", F.lit("不明")).otherwise(F.lit("Unknown"))).otherwise(name)


def blank_to_null(s: Column) -> Column:
    return F.when(F.trim(s) != "", s)


# --- visual-novel markup -------------------------------------------------------------------------------------------

KS_TAG = r"(?<!\[)\[[^\]]*\]"
KS_NAME = r"(?i)(?<!\[)\[\s*nm\s[^\]]*"


def ks_plain(s: Column) -> Column:
    return trim_unicode(F.regexp_replace(s, KS_TAG, ""))


def ks_attribute(s: Column, name: str) -> Column:
    """Attribute t or s of the first name tag, quoted or bare; null if absent or empty. Two name tags are an error."""
    tag = F.regexp_extract(s, KS_NAME, 0)
    value = F.coalesce(F.nullif(F.regexp_extract(tag, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf'(?i)\s{name}\s*=\s*([^"\s\]][^\s\]]*)', 1), F.lit("")))
    return F.when(F.regexp_count(s, F.lit(KS_NAME)) > 1, F.raise_error(F.lit("more than one name tag in a line"))).otherwise(value)


# Percent tags and ruby of scene text, and percent tags that aren't known.
SCN_TAG = r"(?i)(?<!\\)(?:%l;%l(?:[^;]+;){3}|%(?:l[^;]*;)?[^;]*;|\[[^\]]*\])"
SCN_UNKNOWN = r"(?i)(?<!\\)%[^\d;dfl]"


def scn_plain(s: Column, key: Column | None = None) -> Column:
    """Scene text without percent tags and ruby, unescaped. Unknown tags, bare ampersands and unknown escapes are errors."""
    key = F.lit("text") if key is None else key
    stripped = F.regexp_replace(s, SCN_TAG, "")
    wrong = (
        F.when(s.rlike(SCN_UNKNOWN), F.lit("unknown percent tag"))
        .when(stripped.rlike(r"(?<!\\)&"), F.lit("unescaped ampersand"))
        .when(stripped.rlike(r"(?s)^(?:[^\\]|\\[\\%&n])*\\[^\\%&n]"), F.lit("unknown escape"))
    )
    hold = chr(0xE001)  # stands for an escaped backslash meanwhile
    out = F.replace(stripped, F.lit("\\\\"), F.lit(hold))
    for a, b in (("\\%", "%"), ("\\&", "&"), ("\\n", "\n"), (hold, "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(wrong.isNotNull(), F.raise_error(F.concat(key, F.lit(": "), wrong))).otherwise(out)


def name_before_mark(s: Column) -> Column:
    """The part of a name before a full-width at sign, underscores as spaces."""
    return F.translate(F.split(s, "＠")[0], "_", " ")


def stage_trim(s: Column) -> Column:
    return F.btrim(s, F.lit(" *()"))


# --- queries -------------------------------------------------------------------------------------------------------

def mention_of(q: Column) -> Column:
    return F.nullif(F.regexp_extract(q, MENTION, 1), F.lit(""))


def without_mention(q: Column) -> Column:
    return trim_unicode(F.regexp_replace(q, MENTION, " "))


def mention_count(q: Column) -> Column:
    return F.regexp_count(q, F.lit(MENTION))


def sha1_path(data: Column, ext: Column) -> Column:
    """aa/bb/rest.ext of the content's SHA-1."""
    h = F.sha1(data)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 2), F.lit("/"), F.substring(h, 5, 36), F.lit("."), ext)


def title_order(title: Column) -> Column:
    """A key that orders titles without regard to case, by Unicode's root collation."""
    return F.collate(title, "UNICODE_CI")
