"""Small inputs that try every operator: nulls, blanks, repeats, a long text, columns whose names clash."""

CLASHING = ("key", "tag", "h", "id", "ids", "decoded", "n", "kinds", "x", "w", "l", "t", "bucket", "kept", "rule", "fp", "a", "b", "g", "size", "shard", "item_id", "score", "k", "prints", "words", "row", "digest", "toxic", "quality", "block", "n_words", "run", "i", "v", "__k", "__pii", "row_tag", "pseudonyms", "node", "par")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here today"),
    (1, "the quick brown fox jumps over the lazy dog and runs away from here today"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here today"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (None, "a row without an id but with words"),
    (None, None),
    (6, "one"),
    (7, "word " * 40_000),
    (8, "card 4111111111111111 phone +1 (743) 555-3824 mail a.b1@mail.example.com"),
    (9, "line\nline\n\x00\x1f odd   \U0001F600 İ Σ"),
    (10, "Released under the MIT License."),
]


def messy(spark):
    return spark.createDataFrame([(d, t, None, "s", None, *["z"] * len(CLASHING)) for d, t in TEXTS], SCHEMA)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
