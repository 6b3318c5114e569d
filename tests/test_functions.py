import hashlib
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from duolex.functions import analyzers, binary, context, ids, spans
from duolex.functions import text as T
from duolex.plans import search

def plain_simplified(rows, en, ja):
    """Word for word: sort, then let each row take in what it can of the later ones, until a pass changes nothing."""

    def gap(a, b, text):
        lo, hi = sorted((a, b))
        return lo[1] >= hi[0] or text[lo[1] : hi[0]].strip() == ""

    def can(x, y):
        inside = lambda i, o: o[0] <= i[0] and i[1] <= o[1]
        f, t = (x[:2], y[:2]), (x[2:], y[2:])
        both = inside(*f) and inside(*t) or inside(*f[::-1]) and inside(*t[::-1])
        return both or f[0] == f[1] and gap(*t, ja) or t[0] == t[1] and gap(*f, en)

    rows = sorted(set(rows))
    while True:
        old, i = list(rows), 0
        while i < len(rows):
            j = i + 1
            while j < len(rows):
                if can(rows[i], rows[j]):
                    x, y = rows[i], rows.pop(j)
                    rows[i] = (min(x[0], y[0]), max(x[1], y[1]), min(x[2], y[2]), max(x[3], y[3]))
                else:
                    j += 1
            i += 1
        rows.sort()
        if rows == old:
            return rows


def test_simplify():
    """Against the plain version, on words of sentences with gaps of all kinds."""
    rnd = random.Random(9)
    en, ja = "Far lights, dim harbour. We wait for rain", "とおい灯り、くらい 港。 雨をまつ"
    words = lambda t: [m.span() for m in re.finditer(r"[^ ,.、。]+", t)]
    for _ in range(400):
        letters = [(i, i + rnd.randrange(1, 3)) for i in range(len(ja) - 2) if ja[i].strip("、。 ")]
        rows = [(*rnd.choice(words(en)), *rnd.choice(rnd.choice((words(ja), letters)))) for _ in range(rnd.randrange(12))]
        assert spans.simplify_rows(rows, en, ja) == plain_simplified(rows, en, ja)


def test_simplify_properties():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    span = st.tuples(st.integers(0, 8), st.integers(0, 8)).map(sorted)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.tuples(span, span).map(lambda x: (*x[0], *x[1])), max_size=12))
    def check(rows):
        once = spans.simplify_rows(rows, "ab cd ef g", "ab cd ef g")
        assert spans.simplify_rows(once, "ab cd ef g", "ab cd ef g") == once
        for a in rows:
            if a[0] < a[1] and a[2] < a[3]:
                assert any(b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and a[3] <= b[3] for b in once)

    check()


def test_blob_round_trip(spark):
    rnd = random.Random(4)
    rows = [[rnd.randrange(1 << 16) for _ in range(4)] for _ in range(50)]
    blob = b"".join(struct.pack("<4H", *r) for r in rows)
    d = spark.createDataFrame([(bytearray(blob),), (bytearray(b""),), (None,)], "b binary").withColumn("a", binary.decode_alignments(F.col("b")))
    got = d.withColumn("e", binary.encode_alignments(F.col("a"))).collect()
    assert [list(x) for x in got[0].a] == rows and bytes(got[0].e) == blob
    assert got[1].a == [] and got[2].a is None


def test_highlights(spark):
    """Words put between marks come out as spans; those that only spaces and hyphens part are one."""
    m, rnd = chr(0xE000), random.Random(5)
    pieces = ["grey", "-", "green", " ", "stones", ", ", "cold", " ", "water", ". ", "no", " ", "one", "-", "there"]
    for _ in range(20):
        hit = {i for i in range(0, len(pieces), 2) if rnd.random() < 0.5}
        s = "".join(f"{m}{p}{m}" if i in hit else p for i, p in enumerate(pieces))
        plain, want = "".join(pieces), []
        for i in sorted(hit):
            a = len("".join(pieces[:i]))
            if want and (i - 2) in hit and pieces[i - 1].strip(" -") == "":
                want[-1] = (want[-1][0], a + len(pieces[i]))
            else:
                want.append((a, a + len(pieces[i])))
        got = spark.createDataFrame([(s,)], "s string").select(spans.marker_spans(F.col("s"), m).alias("x")).first().x
        assert [tuple(x) for x in got] == want, plain


def test_marked_encodes_always(spark):
    d = spark.createDataFrame([("a<b & c", [(0, 1)]), ("<", [])], "t string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in d.select(spans.marked(F.col("t"), F.col("s"))).collect()] == ["<mark>a</mark>&lt;b &amp; c", "&lt;"]


def test_utf16_spans(spark):
    d = spark.createDataFrame([("𪚲ab", [(2, 3)]), ("xab", [(2, 3)])], "t string, s array<struct<start:int,end:int>>")
    assert [tuple(r[0][0]) for r in d.select(spans.from_utf16(F.col("s"), F.col("t"))).collect()] == [(1, 2), (2, 3)]


@pytest.mark.parametrize("parts", [
    (("It", "isn't"), "raining", ", ", "not", "-", "yet"), ("Gate", "12", "-", ("opens",), ": ", "rock'n'roll", "! "), ("Anaïs’s", " ", "'", "quoted", "'", "/", "1,250.75", "€ ", "3", "."),
])
def test_english_tokens(spark, parts):
    """Tokens are the parts that have a letter or digit; tuples are words that only a space parts."""
    text = "".join(" ".join(p) + " " if isinstance(p, tuple) else p for p in parts)
    tokens = [w for p in parts for w in (p if isinstance(p, tuple) else (p,)) if any(c.isalnum() for c in w)]
    assert [t[0] for t in analyzers.english_spans(text)] == tokens
    assert spark.createDataFrame([(text,)], "t string").select(T.english_tokens(F.col("t"))).first()[0] == tokens
    assert all(text[t[2] : t[3]] == t[0] for t in analyzers.english_spans(text))


def test_default_analyzer():
    got = [t[0] for t in analyzers.default_tokens("CruRon7 12thBatDiv Ｎａｉ̈ｖｅ ﾎﾞ 森の道")]
    assert got == ["cruron", "7", "12th", "batdiv", "naive", "ぼ", "森の", "の道"]
    assert [t[0] for t in analyzers.default_tokens("cruron7", strict_compat=True)] == ["cruron7"]
    assert [t[0] for t in analyzers.kanji_tokens("の森𪚲み")] == ["森", "𪚲"]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("effective", "effect"), ("sky", "sky"), ("happy", "happi")])
def test_stemmer(word, stem):
    assert analyzers.stem(word) == stem


def test_query_checks():
    """Every length in letters of one and of two code points, in both languages, with and without a mention."""
    for letter, most in (("b", 64), ("o" + chr(0x308), 64), ("ぬ", 32), ("ば", 32), ("は" + chr(0x3099), 32), ("森", 32)):
        for n in (0, 1, 2, 3, most - 1, most, most + 1, 2 * most):
            for mention in ("", " @Someone"):
                if n == 0 and mention:
                    continue
                if n == 1 and letter == "森":
                    want = "kanji"
                else:
                    want = "TooShort" if n < 2 else "TooLong" if n > most else "general"
                try:
                    got = search.parse(letter * n + mention).kind
                except search.InvalidQuery as e:
                    got = e.reason
                assert got == want, (letter, n, mention)
    with pytest.raises(search.InvalidQuery, match="MultipleMentions"):
        search.parse("@one @two")


@pytest.mark.parametrize("query,kind,fields", [
    ("森の中", "general", ["japanese.text", "japanese.text", "japanese.text.conjugations"]), ("cold　water", "general", ["english.text", "english.text", "english.text.conjugations"]),
    ("𪚲", "kanji", ["japanese.text.kanji"]), ("@Some_One", "mention", []), ("cold @x", "general", ["english.text"] * 2 + ["english.text.conjugations"]), ("aa @" + "x" * 31, "empty", []),
])
def test_plans(query, kind, fields):
    q = search.parse(query)
    assert q.kind == kind and [c[1] for c in search.clauses(q)] == fields


def test_language():
    assert search.detect_language("") == "english" and search.detect_language("", "ja") == "japanese"
    assert search.detect_language("abc") == "english" and search.detect_language("aかc") == "japanese"


def test_format(spark):
    rows = [('  "Hi  there\n you" ', 'Hi there you'), ("「ab」", "ab"), ('"', '"'), ("　x　", "x"), (None, None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "s string").select(T.format_english(F.col("s"))).collect()
    assert [g[0] for g in got] == [r[1] for r in rows]
    assert spark.createDataFrame([("『あ\r\nい』",)], "s string").select(T.format_japanese(F.col("s"))).first()[0] == "あい"


def test_sha1_path(spark):
    data = bytes.fromhex("494433") + b"any sound"
    h = hashlib.sha1(data).hexdigest()
    r = spark.createDataFrame([(bytearray(data),)], "d binary").select(T.sha1_path(F.col("d"), binary.audio_format(F.col("d")))).first()[0]
    assert r == f"{h[:2]}/{h[2:4]}/{h[4:]}.mp3"


def test_fuz(spark):
    data = b"FUZE" + (1).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"lipXWM"
    got = spark.createDataFrame([(bytearray(data),), (bytearray(b"nope"),)], "d binary").select(binary.fuz_audio(F.col("d"))).collect()
    assert bytes(got[0][0]) == b"XWM" and got[1][0] is None


def test_ids(spark):
    d = spark.createDataFrame([(1 << 48 | 0x2BE10 << 16 | 1,)], "id long")
    form, response = ids.form_of(F.col("id"))
    r = d.select(ids.source_of(F.col("id")), ids.form_hex(form), response).first()
    assert tuple(r) == (1, "0002BE10", 1)
    with pytest.raises(Exception, match="out of range"):
        d.select(ids.pack_pair(F.lit(1), F.lit(70000), F.lit(0))).collect()
    p = ids.load_order_prefix(spark.createDataFrame([("a", "full", 0), ("b", "light", 1), ("c", "full", 2), ("d", "medium", 3)], "name string, kind string, ord int"))
    assert {r["name"]: r["prefix"] for r in p.collect()} == {"a": 0, "b": 0xFE000000, "c": 1 << 24, "d": 0xFD000000}


@pytest.mark.parametrize("c,en", [
    ("7th anniversary 2020", "7th Anniversary"), ("Docking (Minor)", "Docking (Minor Damage)"), ("Supply 3", "Supply"), ("returning from sortie/NightBattle", "Returning From Sortie / Night Battle"),
    ("Spring Mini-Event 2018", "Spring 2018"), ("Special", "Special Attack"), ("Yura Special Attack", "Special Attack"), ("Idle", "Secretary Idle"), ("Intro", "Introduction"), ("Supply (Kai 2)", "Supply (Kai 2)"),
    ("Minor Damage2", "Minor Damage"),
])
def test_context(spark, c, en):
    """Spellings by the rules; a translation puts the table's tokens in place of the English ones."""
    d = spark.createDataFrame([(c, "Yura")], "c string, n string")
    got = d.select(context.translated(F.col("c"), F.col("n")).alias("t")).first().t
    assert got.english == en
    for token in sorted(context.TRANSLATIONS, key=len, reverse=True):
        en = en.replace(token, context.TRANSLATIONS[token])
    assert got.japanese.replace(" ", "") == en.replace(" ", "")


def test_unknown_context(spark):
    d = spark.createDataFrame([("Nothing of that kind / Supply", None), (None, None)], "c string, n string")
    got = [tuple(r.t) for r in d.select(context.translated(F.col("c"), F.col("n")).alias("t")).collect()]
    assert got == [("Nothing of That Kind / Supply",) * 2, (None, None)]


def test_scn_errors(spark):
    bad = spark.createDataFrame([("a&b",)], "s string")
    with pytest.raises(Exception, match="ampersand"):
        bad.select(T.scn_plain(F.col("s"))).collect()
    ok = spark.createDataFrame([(r"50\% \\ \& [ruby]x",)], "s string").select(T.scn_plain(F.col("s"))).first()[0]
    assert ok == "50% \\ & x"


def test_inflection():
    """Forms of one word share a term, with the place of the whole form; particles go, numbers are digits."""
    from duolex.functions import inflection
    from duolex.language_queries import paradigms

    for stem, rest in paradigms():
        end = len(stem) if len(stem) > 1 else len(stem + rest)  # the verb of a noun isn't part of it
        assert inflection.analysed(stem + rest) == [(stem, 0, 0, end)]
    for forms in ("集まる 集まります 集まらない 集まった 集まっている", "起こす 起こした 起こします", "楽しい 楽しくて 楽しかった", "上がる 上がった"):
        assert len({inflection.analysed(f)[0][0] for f in forms.split()}) == 1
    terms = lambda t: [x[0] for x in inflection.analysed(t)]
    assert terms("本を読んでいなかった") == ["読"] and terms("カメラを買わなければならない")[:2] == ["かめら", "買"]
    assert terms("先生です") == ["先生"] and terms("１２，３４５と百万") == ["12345", "1000000"] and terms("二〇二四年") == ["2024"]
    assert [inflection.number(n) for n in ("二十三", "三千五百", "一億二千万", "5万", "千", "3.14", "十")] == ["23", "3500", "120000000", "50000", "1000", "3.14", "10"]
    assert terms("") == [] and terms("…!") == [] and inflection.analysed("Ⅻ読む")[-1][2:] == (1, 3)
    assert len(inflection.analysed("読" + "あ" * 5000)) >= 1


def test_tokens_in_batches(spark):
    """Tokens of many texts, null, empty and long ones among them, are those of each alone; they leave Python as Arrow arrays."""
    import pyarrow as pa

    from duolex.functions import analyzers

    texts = [None if i % 7 == 0 else "" if i % 7 == 1 else "Aa bb 鏡かた " * (i % 5) for i in range(450)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r.id: [tuple(x) for x in r.k] for r in d.select("id", analyzers.analyzed(d.t, "default").alias("k")).collect()}
    assert got == {i: [tuple(t) for t in analyzers.default_tokens(x)] if x else [] for i, x in enumerate(texts)}
    assert len(analyzers._token_lists(pa.array([], pa.string()), analyzers.default_tokens)) == 0
