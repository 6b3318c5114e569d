"""Periodic runs, SentencePiece and fill-in-middle against plain versions and the library, over whole tables and made cases."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duolex.llm import infill, periods, piece_bpe

from .helpers import CLASHING, messy, plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def all_runs(w, shortest=12):
    """Every maximal stretch of least period p, by comparing all words p apart."""
    out, seen = [], set()
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if n >= 2 * p and (s, n) not in seen:  # a smaller period of the same stretch came first
                seen.add((s, n))
                if n >= shortest:
                    out.append((s, n, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(w, runs):
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs)]


@pytest.mark.parametrize("probes, shortest", [(1 << 20, 12), (1 << 20, 2), (23, 12), (23, 2)])
def test_runs(monkeypatch, probes, shortest):
    rnd = random.Random(probes)
    a, b = "a", "ab"
    for _ in range(10):
        a, b = b, b + a
    cases = [b, "", "x", "a" * 300, "ab" * 200, "a" * 90 + "b" + "a" * 90, ("abc" * 40 + "d") * 3 + "abc" * 40]
    cases += ["".join(rnd.choices("abcdefgh"[:k], k=rnd.randrange(80))) for k in (1, 2, 2, 3, 5) for _ in range(120)]
    cases += ["".join((rnd.choices("abc", k=rnd.randrange(1, 20)) * 9)[: rnd.randrange(1, 150)] + rnd.choices("abc", k=9)) for _ in range(150)]
    monkeypatch.setattr(periods, "PROBES", probes)
    got = periods.text_runs([" ".join(t).encode() for t in cases], shortest)
    assert [r for _, r in got] == [all_runs(t, shortest) for t in cases]


def test_repeats_around_a_word_are_quick():
    """Two long runs of one period side by side: their words are compared once, not at every lag."""
    a, b = b"a b c " * 30_000, b"d "
    assert periods.text_runs([a + b + a])[0][1] == [(0, 90_000, 3), (90_001, 90_000, 3)]


def test_runs_query(spark, texts):
    rows = {r.doc_id: r for r in periods.op11_periods(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    tails = 0
    for i, text in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, tails = [w[j if j < a else a + (j - a) % p] for j in range(n)], tails + 1
        runs = all_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = rows[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(kept_words(w, runs)))
    assert tails > 10


def test_runs_keep_rows(spark):
    got = periods.find(messy(spark)).collect()
    assert len(got) == messy(spark).count() and all(r.tag == "z" for r in got)
    long = next(r for r in got if r.doc_id == 7)
    assert [tuple(x) for x in long.runs] == [(0, 40_000, 1)] and long.collapsed == "word"
    assert {r.collapsed for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert periods.find(messy(spark).limit(0)).collect() == []


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model())


def test_pieces_like_the_library(library):
    t, rnd = piece_bpe.PieceBpe(piece_bpe.model()), random.Random(4)
    parts = ["a", "b", " ", "  ", "the", "▁", "\n", "\t", "\0", "é", "日", "本", "\U0001f600", "0", "1", "in", "ing", "er", "ß", "ء", "\xa0", "̈", "<s>", "<0x0A>"]
    cases = ["".join(rnd.choices(parts, k=rnd.randrange(60))) for _ in range(4000)]
    cases += ["".join(rnd.choices("etaoins", k=rnd.randrange(40))) for _ in range(6000)]
    cases += ["".join(rnd.choices("abcdefghij", k=3000)), "a" * 5000, " " * 1000, "ab" * 2000, "=-" * 300, "", " "]
    cases += ["".join(chr(rnd.choice([rnd.randrange(32, 0x300), rnd.randrange(0x3040, 0x9FFF), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(1000)]
    want = library.encode(cases)
    assert t.encode(cases) == want
    assert t.encode(cases[::-1]) == want[::-1]  # from the words that are kept
    assert [t.decode(x) for x in want] == library.decode(want)
    ids = [[rnd.choice([rnd.randrange(32000), rnd.randrange(259)]) for _ in range(rnd.randrange(12))] for _ in range(6000)]
    assert [t.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_words_forgotten_and_long_ones_not_kept(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 40)
    t, rnd = piece_bpe.PieceBpe(piece_bpe.model()), random.Random(8)
    for _ in range(30):
        cases = ["".join(rnd.choices("abc ", k=50)) for _ in range(5)] + ["x" * 500]
        assert t.encode(cases) == library.encode(cases)
        assert max(map(len, t.done)) <= piece_bpe.LONGEST_KEPT


def test_pieces_query(spark, texts, library):
    rows = {r.doc_id: r for r in piece_bpe.op12_pieces(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text or "")
        assert rows[i][1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_keep_rows(spark, library):
    docs = messy(spark)
    got = piece_bpe.encode(docs, piece_bpe.model(), decoded="decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") and r.key == "z"
    back = piece_bpe.decode(spark.createDataFrame([([1526],), (None,), ([],)], "ids array<int>"), piece_bpe.model()).collect()
    assert [r.decoded for r in back] == [library.decode([1526]), "", ""]
    assert piece_bpe.encode(docs.limit(0), piece_bpe.model()).collect() == []


def transformed(i, text):
    """Row of the query by one plain pass over the text."""
    text = text or ""
    hex_ = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hex_[8 * k : 8 * k + 8], 16) for k in range(4)]
    got = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted(x % (len(got) + 1) for x in h[:2])
    pre, mid, suf = "".join(got[:a]), "".join(got[a:b]), "".join(got[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(got), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(got), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(got), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_infill_query(spark, texts):
    rows = {r.doc_id: r for r in infill.op13_infill(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        *want, out = transformed(i, text)
        assert rows[i][1:] == (*want, sha(out), sha(text or ""))
    assert {r.form for r in rows.values()} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("chunk", [1 << 16, 700, 5])
def test_infill_any_chunks(spark, chunk):
    """Texts scanned whole and by chunks that cut words and code points; repeated rows, marks, nulls, one giant."""
    rnd = random.Random(chunk)
    parts = ["a", "Zebra", " ", "é", "日本", "\U0001f600", "1", "\n", "<", "<P", "S>", "word", "\0"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randrange(30)))) for i in range(150)]
    rows += [(i, "x" * 40) for i in range(20)] * 2 + [(200 + i, t) for i, t in enumerate(["a <P> b", "", None, "<S>", "\U0001f600" * 30, "<<<M>>", "<M"])]
    rows += [(None, "no id"), (None, None), (300, "ab c" * (60_000 if chunk > 5 else 300))]
    got = infill.infill(plain(spark, rows), chunk=chunk)
    got = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    assert len(got) == len(rows)
    for r, (i, text) in zip(sorted(got, key=key), sorted(rows, key=key), strict=True):
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == transformed(i, text)
        assert r.back == (text or "")


def test_infill_keeps_rows(spark):
    docs = messy(spark)
    got = infill.infill(docs, chunk=50).collect()
    assert len(got) == docs.count() and all(r.tag == "z" and r.__getitem__("__k") == "z" for r in got)
    assert set(CLASHING) <= set(got[0].asDict())
    assert infill.infill(docs.limit(0)).collect() == []


def test_composition_is_associative():
    data = np.frombuffer("one, zwei — drei 日本x".encode(), np.uint8)
    whole = infill.Texts(data, np.array([0]), np.array([len(data)])).total()
    for k in range(len(data)):
        two = infill.Texts(data, np.array([0, k]), np.array([k, len(data) - k])).total()
        exits, counts = infill.compose(*two, np.zeros(2, np.int64))
        assert (exits[1] == whole[0][0]).all() and (counts[1] == whole[1][0]).all()
