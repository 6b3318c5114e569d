"""Pseudonyms against a plain Feistel network, and values of every length and format."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duolex.llm import pii

from .helpers import plain

RND = random.Random(21)


def feistel(values, radices, kind, key):
    """The network in plain Python."""
    state, n = list(values), len(values)
    half = n // 2
    for r in range(pii.ROUNDS):
        left = r % 2 == 0
        other = state[half:] if left else state[:half]
        seed = hashlib.sha256("|".join([key, kind, str(r), str(n), ",".join(map(str, other))]).encode()).hexdigest()
        stream = "".join(hashlib.sha512(f"{seed}|{b}".encode()).hexdigest() for b in range((n + 31) // 32))
        for i in range(n):
            if (i < half) == left:
                state[i] = (state[i] + int(stream[4 * i : 4 * i + 4], 16)) % radices[i]
    return state


def moved(spark, texts, key="k", back=False):
    rows = pii.pseudonymize(plain(spark, list(enumerate(texts))), key, back=back).orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_plain_network(spark):
    rows = []
    for i in range(60):
        radices = [RND.choice((2, 8, 10, 16, 26, 256, 4297)) for _ in range(RND.choice((1, 2, 3, 4, 16, 31, 32, 33, 70, 200)))]
        rows.append((i, [RND.randrange(x) for x in radices], radices))
    d = spark.createDataFrame(rows, "i int, v array<int>, r array<int>").withColumn("new", pii.feistel(F.col("v"), F.col("r"), "x", "k"))
    d = d.withColumn("old", pii.feistel(F.col("new"), F.col("r"), "x", "k", back=True)).collect()
    assert all(r.new == feistel(r.v, r.r, "x", "k") and r.old == r.v for r in d)


def test_plain_values(spark):
    """A whole value of each simple format, by the plain network."""
    sets = {"0123456789": "d", "abcdefghijklmnopqrstuvwxyz": "l", "ABCDEFGHIJKLMNOPQRSTUVWXYZ": "u"}
    of = lambda c: next(s for s in sets if c in s)

    def want(text, kind):
        letters = [c for c in text if c.isalnum()]
        new = feistel([of(c).index(c) for c in letters], [len(of(c)) for c in letters], kind, "k")
        new = iter(of(c)[v] for c, v in zip(letters, new, strict=True))
        return "".join(next(new) if c.isalnum() else c for c in text)

    secret, mail = "sk_Live-9aZ.q" * 9, "ann.b1@mail.Example"
    assert moved(spark, [f"token={secret} end"]) == [f"token={want(secret, 'secret')} end"]
    assert moved(spark, [f"to {mail}.com!"]) == [f"to {want(mail, 'email')}.com!"]
    octets = [10, 0, 200, 7]
    assert moved(spark, ["ip 10.0.200.7 x"]) == ["ip " + ".".join(map(str, feistel(octets, [256] * 4, "ip", "k"))) + " x"]


def test_long_secrets(spark):
    """No part of a long value stays, none of its places repeats the keystream, and megabytes pass."""
    same = "b" * 299 + "1"
    jwt = ".".join("".join(RND.choices("abcdefABCDEF0123456789_-", k=n)) for n in (40, 180, 43))
    huge = "x7" * 50_000
    a, b, c = moved(spark, [f"api_key: {same}", f"token={jwt}", f"secret={huge}"])
    new = a.removeprefix("api_key: ")
    assert len(new) == 300 and new[:32] != new[32:64] and max(new.count(x) for x in set(new)) < 40
    assert len(set(zip(jwt, b.removeprefix("token="), strict=True))) > 100
    parts = list(zip(jwt.split("."), b.removeprefix("token=").split("."), strict=True))
    assert all(len(x) == len(y) and sum(p == q for p, q in zip(x, y, strict=True)) < len(x) / 2 for x, y in parts)
    assert len(c) == len(huge) + 7 and sum(p == q for p, q in zip(c[7:], huge, strict=True)) < len(huge) / 8
    assert moved(spark, [a, b, c], back=True) == [f"api_key: {same}", f"token={jwt}", f"secret={huge}"]


@pytest.mark.parametrize("digits", ["0123456789abcdef", "0123456789ABCDEF"])
def test_hexadecimal_secrets(spark, digits):
    """None in clear, no two alike, and all found again."""
    some = set()
    while len(some) < 10_000:
        x = "".join(RND.choices(digits, k=8))
        if any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
            some.add(x)
    old = [f"password={x}" for x in sorted(some)]
    new = moved(spark, old)
    assert len(set(new)) == len(old) and not any(a == b for a, b in zip(old, new, strict=True))
    assert all(set(x.removeprefix("password=")) <= set(digits) and any(c.isdigit() for c in x) for x in new)
    assert moved(spark, new, back=True) == old


def test_more_formats(spark):
    old = ["call 743-555-3824 now", "call 743.555.3824 now", "on 12/31/2020 it", "on 31/12/2020 it", "on 02/03/2020 it", "amex 3782 822463 10005 x", "no 143-555-3824", "no 743-155-3824", "no 7435553824", "no 13/31/2020"]
    new = moved(spark, old)
    assert [a == b for a, b in zip(old, new, strict=True)] == [False] * 6 + [True] * 4
    assert all(len(a) == len(b) for a, b in zip(old, new, strict=True))
    assert int(new[2].split()[1].split("/")[1]) > 12 and int(new[2].split()[1].split("/")[0]) <= 12
    assert moved(spark, new, back=True) == old


def test_month_first_dates(spark):
    days = spark.range(0, 73049, 11).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d")).filter("day(d) > 12")
    old = [r[0] for r in days.select(F.date_format("d", "MM/dd/yyyy")).collect()]
    new = moved(spark, old)
    assert len(set(new)) == len(old) and all(int(x[3:5]) > 12 for x in new) and moved(spark, new, back=True) == old


def test_key(spark):
    """The setting rules; without one the key is random and holds for the session."""
    usual = spark.conf.get(pii.KEY_SETTING, None)
    try:
        spark.conf.set(pii.KEY_SETTING, "mine")
        assert pii.session_key(spark) == "mine"
        spark.conf.unset(pii.KEY_SETTING)
        made = pii.session_key(spark)
        assert len(made) == 64 and pii.session_key(spark) == made
    finally:
        spark.conf.unset(pii.KEY_SETTING)
        if usual:
            spark.conf.set(pii.KEY_SETTING, usual)


def test_clashing_column(spark):
    d = spark.createDataFrame([(1, "mail a@b.example.com", "p", "q")], "doc_id long, text string, __pii string, pseudonyms string")
    r = pii.pseudonymize(d, "k").first()
    assert r["__pii"] == "p" and r["pseudonyms"] == "q" and "a@b" not in r.text and len(r) == 4
