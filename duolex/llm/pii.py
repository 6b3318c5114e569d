"""Format-preserving pseudonyms for numbers, dates, addresses and secrets, by a keyed Feistel network, in built-in expressions.

A value is read as a list of digits in mixed radices: a decimal digit has radix 10 (8 where the numbering plan wants 2 to 9), a
letter 26, a hexadecimal digit 16, an octet 256, a date two digits of radices 17 and 4297, which make up the 73049 days from
1900 to 2099. In each of ROUNDS rounds one half of the list is shifted, digit by digit and modulo its radix, by a SHA-512
keystream of the key, the kind, the round and the other half; every place has its own part of the stream, however long the
value is. That is a permutation of all values of the format, so different values stay different, equal values stay equal in all
documents, and who has the key can go back (`restore`). Where a format is narrower than its radices (a hexadecimal secret with
a digit, a month-first date that can't be read day first), the permutation is repeated until it is met again.

Numbers are validated before: cards by length and Luhn sum (the pseudonym keeps the first digit and gets a valid check digit),
IPv4 addresses by octet, dates by calendar (day first if both readings are valid), social security numbers by their reserved
areas, ten-digit phone numbers by the numbering plan. What fails stays as it is, and so do numbers without any mark of their
kind: ten digits in a row, or in groups parted by spaces only.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Rounds of the network; how often a permutation is repeated at most (a value fails so often with a chance below 1e-12).
ROUNDS, WALKS = 8, 32
#: The setting with the key.
KEY_SETTING = "duolex.pii.key"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMED = r"(?i:(?:access[_-]?token|token|password|passwd|secret|api[_-]?key)[ \t]{0,8}[=:][ \t]{0,8}[\"']?)"
#: Patterns of the kinds, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": NAMED + r"(?=[A-Za-z+/_.=~-]*+[0-9])[A-Za-z0-9+/_.=~-]{8,}+",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+(?!1)[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])|(?<![0-9+.-])[2-9][0-9]{2}([.-])[2-9][0-9]{2}\1[0-9]{4}(?![0-9]|[.-][0-9])",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z]|\.[0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def feistel(values: Column, radices: Column, kind: str, key: str, back: bool = False) -> Column:
    """The permuted list of values, each below its radix."""
    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def network(state: Column, radices: Column, half: Column, blocks: Column) -> Column:
        def turn(state: Column, r: Column) -> Column:
            even = r % 2 == 0  # even rounds shift the left half
            other = F.array_join(F.when(even, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half)).cast("array<string>"), ",")
            seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.size(state).cast("string"), other).cast("binary"), 256)

            def shifted(h: Column) -> Column:
                def one(x: Column, i: Column) -> Column:
                    shift = F.conv(F.substring(F.get(h, F.floor(i / 32).cast("int")), (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
                    rad = F.element_at(radices, i + 1)
                    return F.when((i < half) == even, F.pmod(x - shift if back else x + shift, rad)).otherwise(x).cast("int")

                return F.transform(state, one)

            stream = let(seed, lambda s: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", s, b.cast("string")).cast("binary"), 512)))
            return let(stream, shifted)

        return F.aggregate(order, state, turn)

    def sized(v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / 32).cast("int"))
        return let(radices, lambda r: let(half, lambda h: let(blocks, lambda b: network(v, r, h, b))))

    return let(values.cast("array<int>"), sized)


def walked(value: Column, step, good) -> Column:  # noqa: ANN001
    """step(value), and step again while the result isn't good: a permutation of the good values if step is one of all."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), step(value), lambda v, _: F.when(good(v), v).otherwise(step(v)))


def filled(form: Column, letters: Column) -> Column:
    """form with its letters and digits replaced, in turn, by those of `letters`."""

    def put(chars: Column, new: Column) -> Column:
        placed = F.transform(chars, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        moved = F.transform(F.filter(placed, lambda x: x["c"].rlike("[0-9A-Za-z]")), lambda x, k: F.struct(x["i"].alias("i"), F.get(new, k).alias("c")))
        rest = F.filter(placed, lambda x: ~x["c"].rlike("[0-9A-Za-z]"))
        return F.array_join(F.transform(F.array_sort(F.concat(moved, rest)), lambda x: x["c"]), "")

    return let(F.split(form, ""), lambda a: let(F.split(letters, ""), lambda b: put(a, b)))


def plain(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9A-Za-z]", "")


def lettered(s: Column, kind: str, key: str, back: bool, alphabet=None) -> Column:  # noqa: ANN001
    """A string of letters and digits permuted, each character within its alphabet."""
    usual = lambda c, i: F.when(c.rlike("[0-9]"), F.lit(DIGITS)).when(c.rlike("[a-z]"), F.lit(LOWER)).otherwise(F.lit(UPPER))

    def on(chars: Column) -> Column:
        sets = F.transform(chars, alphabet or usual)

        def with_sets(a: Column) -> Column:
            values = F.transform(chars, lambda c, i: F.instr(F.element_at(a, i + 1), c) - 1)
            moved = feistel(values, F.transform(a, lambda x: F.length(x)), kind, key, back)
            return let(moved, lambda m: F.array_join(F.transform(m, lambda v, i: F.substring(F.element_at(a, i + 1), v + 1, F.lit(1))), ""))

        return let(sets, with_sets)

    return F.when(F.length(s) == 0, s).otherwise(let(F.split(s, ""), on))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, the last digit counted once."""
    def add(total: Column, d: Column) -> Column:
        return total + d

    def weighed(c: Column, i: Column) -> Column:
        v = c.cast("int") * (F.lit(1) + (F.length(digits) - 1 - i) % 2)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(digits, ""), weighed), F.lit(0), add)


def of_kind(m: Column, key: str, back: bool) -> Column:
    """struct(kind, new) of a match; kind is null and new the match itself if it isn't valid."""

    def made(kind: str, new: Column, valid: Column | None = None) -> Column:
        new = F.coalesce(new, m)
        return F.struct(F.when(valid if valid is not None else F.lit(True), F.lit(kind)).alias("kind"), (F.when(valid, new).otherwise(m) if valid is not None else new).alias("new"))

    def card(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), lettered(F.substring(d, F.lit(2), F.length(d) - 2), "card", key, back))
        return let(body, lambda b: F.concat(b, ((F.lit(10) - luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    def phone(d: Column) -> Column:
        code = F.when(F.length(d) == 10, F.lit("")).when(m.rlike(r"^\+1"), F.lit("1")).otherwise(F.substring(d, 1, 2))
        national = F.when(F.length(d) == 10, d).when(m.rlike(r"^\+1"), F.substring(d, F.lit(2), F.lit(20))).otherwise(F.substring(d, F.lit(3), F.lit(20)))
        plan = lambda c, i: F.when(((i == 0) | (i == 3)) & c.rlike("[2-9]"), F.lit("23456789")).when((i == 0) | (i == 3), F.lit("01")).otherwise(F.lit(DIGITS))
        return F.concat(code, let(national, lambda n: lettered(n, "phone", key, back, plan)))

    def ip() -> Column:
        return F.array_join(feistel(F.split(m, r"\.").cast("array<int>"), F.array(*[F.lit(256)] * 4), "ip", key, back).cast("array<string>"), ".")

    def date() -> Column:
        # the first format that the match is valid in; with slashes the month may come first
        form = F.coalesce(*[F.when(F.try_to_timestamp(m, F.lit(f)).isNotNull(), F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy")])
        start = F.lit("1900-01-01").cast("date")
        on = lambda v: F.date_add(start, v[0] * 4297 + v[1])
        step = lambda v: feistel(v, F.array(F.lit(17), F.lit(4297)), "date", key, back)

        def moved(f: Column) -> Column:
            n = F.datediff(F.try_to_timestamp(m, f).cast("date"), start)
            two = F.array(F.floor(n / 4297).cast("int"), (n % 4297).cast("int"))
            return let(walked(two, step, lambda v: (f != "MM/dd/yyyy") | (F.dayofmonth(on(v)) > 12)), lambda v: F.call_function("date_format", on(v).cast("timestamp"), f))

        return let(form, lambda f: made("date", F.when(f.isNotNull(), moved(f)), f.isNotNull()))

    def ssn() -> Column:
        # the area keeps its validity: its digits move within 1 to 8 first, so never 000, 666 or 9xx by the first digit alone
        plan = lambda c, i: F.when((i == 0) & c.rlike("[1-57-8]"), F.lit("1234578")).when(i == 0, c).when((i == 4) | (i == 8), F.when(c == "0", F.lit("0")).otherwise(F.lit("123456789"))).otherwise(F.lit(DIGITS))
        valid = ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
        return made("ssn", filled(m, lettered(plain(m), "ssn", key, back, plan)), valid)

    def secret() -> Column:
        head = F.regexp_extract(m, "^" + NAMED, 0)

        def value(h: Column) -> Column:
            v = F.substring(m, F.length(h) + 1, F.length(m))

            def hexes(low: Column) -> Column:
                hexed = lambda c, i: F.when(low, F.lit("0123456789abcdef")).otherwise(F.lit("0123456789ABCDEF"))
                # what is found again: a digit, and in capitals a letter too
                return walked(v, lambda x: lettered(x, "secret", key, back, hexed), lambda x: x.rlike("[0-9]") & (low | x.rlike("[A-F]")))

            is_hex = v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
            return F.concat(h, F.when(is_hex, let(v.rlike("^[0-9a-f]+$"), hexes)).otherwise(filled(v, lettered(plain(v), "secret", key, back))))

        return let(head, value)

    def email() -> Column:
        head = F.regexp_extract(m, r"^(.*)\.[A-Za-z]+$", 1)
        return F.concat(filled(head, lettered(plain(head), "email", key, back)), F.regexp_extract(m, r"\.[A-Za-z]+$", 0))

    is_ = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(is_("email"), made("email", email()))
        .when(is_("secret"), made("secret", secret()))
        .when(is_("ip"), made("ip", ip()))
        .when(is_("date"), date())
        .when(is_("ssn"), ssn())
        .when(is_("phone"), made("phone", let(digits, lambda d: filled(m, phone(d)))))
        .otherwise(let(digits, lambda d: made("card", filled(m, card(d)), luhn(d) % 10 == 0)))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str | None = None, back: bool = False) -> DataFrame:
    """docs with the values in column `text` replaced by their pseudonyms and, if asked for, the kinds replaced in array `found`.

    All other columns stay as they are. Null texts stay null, with no kinds. Texts without a value come back unchanged, byte for
    byte. Rows aren't moved, dropped or joined. A value that isn't valid for its format stays.
    """
    t = F.col(text)
    matches = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    pieces = F.split(t, ANY, -1)
    new = F.transform(matches, lambda m: of_kind(m, key, back))
    joined = let(new, lambda n: F.struct(F.array_join(F.zip_with(pieces, n, lambda p, x: F.concat(p, F.coalesce(x["new"], F.lit("")))), "").alias("text"), F.filter(F.transform(n, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))
    may = t.rlike("[0-9@]")
    name = fresh(docs, "pseudonyms")
    out = docs.withColumn(name, F.when(may, joined)).withColumn(text, F.when(F.col(name).isNull(), t).otherwise(F.col(f"{name}.text")))
    if found:
        out = out.withColumn(found, F.coalesce(F.col(f"{name}.kinds"), F.array().cast("array<string>")))
    return out.drop(name)


def restore(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The inverse of `pseudonymize` under the same key."""
    return pseudonymize(docs, key, text, back=True)


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting; where there is none, a random one that holds for the session."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pseudonymize(docs, session_key(spark), found="kinds")
    return got.select("doc_id", "text", F.size("kinds").cast("bigint").alias("n_values"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
