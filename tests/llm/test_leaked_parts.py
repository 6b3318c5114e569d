"""Documents that hold only a part of a benchmark item."""

import random

from duolex.llm import decontaminate

from .helpers import plain


def test_any_part_of_an_item(spark):
    """Head, tail and middle, and copies of which one half is rewritten, also where the part leaked more often than the rest."""
    rnd = random.Random(6)
    word = lambda: f"v{rnd.getrandbits(30)}"
    around = lambda w: " ".join([*[word() for _ in range(40)], *w, *[word() for _ in range(40)]])
    items = {k: [f"i{k}x{j}" for j in range(38)] for k in range(12)}
    rows, want = [], set()
    for k, w in items.items():
        parts = [w, w[19:], w[:19], w[10:29], [*[word() for _ in range(19)], *w[19:]], [*w[:19], *[word() for _ in range(19)]]]
        for p in [*parts, *[w[19:]] * 5]:
            want.add((len(rows), k))
            rows.append((len(rows), around(p)))
    rows += [(5000 + i, around(rnd.choice(list(items.values()))[:10])) for i in range(20)]  # too little of an item
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.links(plain(spark, rows), table).collect()} == want


def test_letters_beyond_ascii(spark):
    """Words are told apart by case beyond ASCII, for the item as for the text; seeds don't mind."""
    item = "Größe Über ÉTÉ İstanbul ΑΣ K große über " * 3
    texts = [(1, f"before {item} after"), (2, item.upper()), (3, item.replace("Über", "über"))]
    got = {r.doc_id: r.identity for r in decontaminate.links(plain(spark, texts), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    words = decontaminate.words_of(item.encode())
    assert got[1] == 1.0 and got[3] == 1 - 3 / len(words) and got.get(2, 0.0) < 0.7
