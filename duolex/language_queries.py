"""Registered queries of versioned stores, folders of scripts, spellings, word splitting, inflection and trained alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import analyzers, context, text
from .operators import corpus, intervals, rules, store, versions
from .plans import lexicon, segment
from .registry import query, values
from .session import cut, shared_folder, table
from .sources import readers

# --- store -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderpriority AS source, o_custkey + (o_orderpriority = '5-LOW')::INT AS customer FROM orders WHERE o_orderpriority <> '1-URGENT' AND NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') UNION ALL SELECT -o_orderkey, 'new', o_custkey FROM orders WHERE o_orderstatus = 'P'")
def sk_versions(spark, sf_dir):  # noqa: ANN001, ANN201
    """A stored table after transactions: a source replaced, one emptied, one added, then a new base."""
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("customer"), "o_orderstatus")
    versions.create(o.drop("o_orderstatus"), path)
    low = o.filter("source = '5-LOW' and o_orderstatus <> 'F'").withColumn("customer", F.col("customer") + 1)
    versions.replace_source(low, path, "5-LOW")
    versions.replace_source(o.limit(0), path, "1-URGENT")
    at = versions.compact(spark, path)
    new = o.filter("o_orderstatus = 'P'").withColumns({"id": -F.col("id"), "source": F.lit("new")})
    versions.replace_source(new, path, "new", expected=at)
    versions.vacuum(spark, path)
    return versions.read(spark, path)


@query("SELECT 'g=' || (c_custkey % 25) AS folder, row_number() OVER (PARTITION BY c_custkey % 25 ORDER BY c_custkey) - 1 AS n, c_name AS text FROM customer")
def sc_script_folders(spark, sf_dir):  # noqa: ANN001, ANN201
    """Scripts of one name in several folders are read apart, each numbered by itself."""
    path = f"{shared_folder(spark)}/scripts-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").withColumn("g", F.col("c_custkey") % 25)
    lines = c.repartition(4, "g").sortWithinPartitions("g", "c_custkey").select("g", F.concat("c_name", F.lit("[np]")).alias("value"))
    lines.write.partitionBy("g").text(path)
    read = readers.text_lines(spark, f"{path}/*/*.txt")
    label = read.groupBy("file").agg(F.lit(-1).alias("line_ordinal"), F.lit("*start").alias("line"))
    got = readers.ks(label.unionByName(read), separators=("np",))
    number = F.regexp_extract("key", r"\[(\d+)\]$", 1).cast("bigint")
    return got.select(F.split("key", "/")[0].alias("folder"), number.alias("n"), "text")


# --- corpus ----------------------------------------------------------------------------------------------------------------


@query("WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS g FROM events), n AS (SELECT g, count(*) AS n FROM e GROUP BY g), w AS (SELECT g, sum(n) OVER () / (n * count(*) OVER ()) AS weight FROM n) SELECT event_id, round(weight, 9) AS weight FROM e JOIN w ON e.g IS NOT DISTINCT FROM w.g")
def ag_weight_null_group(spark, sf_dir):  # noqa: ANN001, ANN201
    """Weights by group where a group is null: its rows stay and have a weight of their own."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("g"))
    return corpus.with_weights(e, "g").select("event_id", F.round("weight", 9).alias("weight"))


_CONTEXT = "replace(lower(p_name), 'blue', 'blueOf') || p_size || 'X of THE ' || p_type || ' (a' || p_partkey || ')'"


@query(
    f"WITH a AS (SELECT p_partkey, regexp_replace({_CONTEXT}, '([a-z])([A-Z0-9])', '\\1 \\2', 'g') AS s FROM part), "
    "b AS (SELECT p_partkey, string_split(array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i = 1 OR s[i - 1] IN (' ', '(', '[') THEN upper(s[i]) ELSE s[i] END), ''), ' ') AS w FROM a) "
    f"SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND i < len(w) AND lower(w[i]) IN ({', '.join(repr(x) for x in context.SMALL_WORDS)}) THEN lower(w[i]) ELSE w[i] END), ' ') AS title FROM b"
)
def sf_titled(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contexts with words run together, put apart and in title case."""
    c = F.concat(F.replace(F.lower("p_name"), F.lit("blue"), F.lit("blueOf")), "p_size", F.lit("X of THE "), "p_type", F.lit(" (a"), "p_partkey", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", context.titled(c).alias("title"))


# --- models learned from the corpus ------------------------------------------------------------------------------------------

#: A Japanese letter for each Latin one, of three scripts. Texts lose their spaces, so that words have to be found.
_LATIN, _KANA = "abcdefghijklmnopqrstuvwxyz", "あカ祥てえフ鳳はいジ瑞らまなおパク鏡すとうヴわキやザ"


def japanese_texts(spark, sf_dir):  # noqa: ANN001, ANN201
    """(id, ja): whole conversations in Japanese letters, without the spaces between words."""
    ja = F.translate(F.lower(F.coalesce("text", F.lit(""))), f"{_LATIN} ", _KANA)
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), ja.alias("ja"))


@query()
def ft_ja_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    """Words of all texts in Japanese letters, by a model trained on them: number, distinct, longest, and whether spans ascend."""
    docs = japanese_texts(spark, sf_dir)
    model = segment.train(docs, "ja", longest=5, rounds=2)
    t = segment.words_of(F.col("ja"), model)
    rows = docs.select("id", t.alias("t"), "ja")
    ascending = F.aggregate("t", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, x: F.struct(x["end"].alias("at"), (a["ok"] & (x["start"] >= a["at"]) & (x["end"] > x["start"])).alias("ok")))["ok"]
    same = F.forall("t", lambda x: x["term"] == F.substring(F.col("ja"), x["start"] + 1, x["end"] - x["start"]))
    terms = F.transform("t", lambda x: x["term"])
    return rows.select("id", F.size("t").alias("words"), F.size(F.array_distinct(terms)).alias("distinct_words"), F.coalesce(F.array_max(F.transform(terms, F.length)), F.lit(0)).alias("longest"), (ascending & same).alias("good"))


@query()
def al_trained(spark, sf_dir):  # noqa: ANN001, ANN201
    """Sentences of benchmark items aligned with their words in Japanese letters, in reverse order, by a lexicon trained on them.

    right: alignments that take a word to its own translation, words: those to be aligned.
    """
    pieces = F.filter(F.split("text", r"[^A-Za-z ]+"), lambda x: F.trim(x) != "")
    s = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(pieces).alias("n", "en"))
    words = F.filter(F.split(F.lower("en"), " +"), lambda w: w != "")
    hira = F.transform(F.reverse(words), lambda w: F.translate(w, _LATIN, "あかさたなはまやらわいきしちにひみりうくすつぬふむゆ"))
    pairs = cut(s.select(F.concat_ws("-", "item_id", "n").alias("id"), "en", F.array_join(hira, "・").alias("ja"), F.size(words).alias("words")))
    got = lexicon.aligned(pairs.select("id", "en", "ja"), simplify=False, simple=3, jumping=2)
    both = pairs.join(got, "id")
    en = lambda a: F.lower(F.substring(F.col("en"), a["from_start"] + 1, a["from_end"] - a["from_start"]))
    ja = lambda a: F.substring(F.col("ja"), a["to_start"] + 1, a["to_end"] - a["to_start"])
    own = F.filter("alignment_data", lambda a: F.translate(en(a), _LATIN, "あかさたなはまやらわいきしちにひみりうくすつぬふむゆ") == ja(a))
    covered = F.size(F.array_distinct(F.transform(own, lambda a: a["from_start"])))
    return both.select("id", "words", F.size("alignment_data").alias("alignments"), F.size(own).alias("right"), covered.alias("words_right"))


# --- chains and picks ----------------------------------------------------------------------------------------------------------

_LISTED = (
    "n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN -o_custkey - 1 WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS p, CASE WHEN o_orderkey % 6 = 2 THEN o_orderpriority END AS v FROM orders), "
    "e AS (SELECT -o_custkey - 1 AS k, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS p FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey), a AS (SELECT * FROM n UNION ALL SELECT k, p, NULL FROM e)"
)


@query(f"WITH RECURSIVE {_LISTED}, w AS (SELECT k AS s, k, p, v, 0 AS i FROM a UNION ALL SELECT s, a.k, a.p, a.v, i + 1 FROM w JOIN a ON a.k = w.p WHERE w.v IS NULL AND i < 64) SELECT s AS npc, max(v) AS voice FROM w GROUP BY s")
def rc_levelled_chain(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first value along chains of templates, some of which are levelled lists that stand for their lowest entry; some end in cycles."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    parent = F.when(k % 4 == 0, -F.col("o_custkey") - 1).when(k % 4 == 1, k - 1)
    nodes = o.select(k.alias("npc"), parent.alias("template"), F.when(k % 6 == 2, F.col("o_orderpriority")).alias("voice"))
    entries = o.select((-F.col("o_custkey") - 1).alias("npc"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("level"), k.alias("item"))
    return rules.follow_chain(rules.levelled_nodes(nodes, entries, "npc", "template", ["voice"]), "npc", "template", ["voice"])


@query("WITH RECURSIVE a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey // 2 END AS t, CASE WHEN p_name LIKE 'red%' THEN 'player' WHEN p_partkey % 5 = 0 THEN p_type END AS d FROM part), w AS (SELECT k AS s, k, t, d, 0 AS i FROM a UNION ALL SELECT s, a.k, a.t, a.d, i + 1 FROM w JOIN a ON a.k = w.t WHERE w.d IS NULL AND w.t <> w.k AND i < 64) SELECT s AS id, max(d) AS display FROM w GROUP BY s")
def rc_display_name(spark, sf_dir):  # noqa: ANN001, ANN201
    """Display names of objects, else of their templates; an object whose name has the player's prefix is the player."""
    k = F.col("p_partkey")
    objects = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 9 != 0, F.floor(k / 2)).alias("template"), F.col("p_name").alias("name"), F.when(k % 5 == 0, F.col("p_type")).alias("display"))
    return rules.display_names(objects, "red", "player")


@query("SELECT l_orderkey, arg_min(l_partkey, (l_quantity, l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def ag_lowest_entry(spark, sf_dir):  # noqa: ANN001, ANN201
    """The entry of the lowest level of each list, of equal ones the first."""
    return rules.lowest_entry(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_partkey", "l_linenumber")


@query("SELECT topic, arg_min(npc, (('0x' || substr(md5('42|' || topic || '|' || npc), 1, 13))::BIGINT, npc)) AS npc FROM (SELECT DISTINCT l_orderkey AS topic, l_suppkey AS npc FROM lineitem) GROUP BY topic")
def rc_seeded_pick(spark, sf_dir):  # noqa: ANN001, ANN201
    """One of the distinct picks of each group, by a seeded hash."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("topic"), F.col("l_suppkey").alias("npc"))
    return rules.seeded_pick(rows, "topic", "npc")


@query("SELECT 'http://x/' || o_custkey || '#' || (o_orderkey % 3) AS uri, max(CASE WHEN o_orderstatus <> 'P' THEN 'n' || o_custkey || '-' || (o_orderkey % 3) END) OVER (PARTITION BY o_custkey, o_orderkey % 3) AS object_name, o_orderkey AS id FROM orders")
def sk_cached_download(spark, sf_dir):  # noqa: ANN001, ANN201
    """Wanted addresses with the name of what is cached under each, fragment included; null is to be fetched."""
    o = table(spark, sf_dir, "orders")
    uri, name = F.concat(F.lit("http://x/"), "o_custkey", F.lit("#"), F.col("o_orderkey") % 3), F.concat(F.lit("n"), "o_custkey", F.lit("-"), F.col("o_orderkey") % 3)
    cache = o.filter("o_orderstatus <> 'P'").select(uri.alias("original_uri"), name.alias("object_name")).distinct()
    return store.cached_or_missing(o.select(uri.alias("uri"), F.col("o_orderkey").alias("id")), cache)


# --- inflection ------------------------------------------------------------------------------------------------------------------


def paradigms() -> list[tuple[str, str]]:
    """(kanji, what follows): forms of godan verbs of all rows, ichidan verbs, adjectives and a noun with its verb."""
    out: list[tuple[str, str]] = []
    rows = {"書": "かきくけこいた", "泳": "がぎぐげごいだ", "話": "さしすせそした", "待": "たちつてとった", "死": "なにぬねのんだ", "呼": "ばびぶべぼんだ", "読": "まみむめもんだ", "走": "らりるれろった", "買": "わいうえおった"}
    polite, desire = ("ます", "ました", "ません", "ませんでした", "ましょう"), ("たい", "たかった", "たくない", "たくなかった")
    for kanji, (a, i, u, e, o, t, d) in rows.items():
        te = t + ("て" if d == "た" else "で")
        forms = [u, o + "う", e + "ば", e + "る", i + "ながら", t + d, t + d + "ら", te, te + "いる", te + "いなかった", te + "る"]
        forms += [i + x for x in polite + desire] + [a + x for x in ("ない", "なかった", "なければ", "れる", "れた", "せる", "せられた", "せられませんでした", "せたくなかった")]
        out += [(kanji, f) for f in forms]
    for stem in ("見", "食べ", "起き"):
        out += [(stem[0], stem[1:] + x) for x in ("る", "れば", "よう", "た", "て", "たら", "ている", "ていた", "ない", "なかった", "られる", "られない", "させる", "させられませんでした", *polite, *desire)]
    out += [("高", x) for x in ("い", "く", "くて", "かった", "ければ", "くない", "くなかった")]
    return out + [("勉強", x) for x in ("する", "します", "しました", "しない", "した", "している", "すれば", "される", "させられた", "したい")]


_FORMS = [(i, stem, rest) for i, (stem, rest) in enumerate(paradigms())]
_TENS = "concat(" + ", ".join(f"CASE WHEN d // {u} % 10 > 1 THEN substr('〇一二三四五六七八九', (d // {u} % 10 + 1)::INT, 1) ELSE '' END, CASE WHEN d // {u} % 10 > 0 THEN '{c}' ELSE '' END" for u, c in ((1000, "千"), (100, "百"), (10, "十"))) + ", CASE WHEN d % 10 > 0 THEN substr('〇一二三四五六七八九', (d % 10 + 1)::INT, 1) ELSE '' END)"


@query("WITH " + values("f", "k, stem, rest", _FORMS) + f", t AS (SELECT c_custkey AS id, stem, stem || rest || '。一万' || {_TENS} AS s, length(stem || rest) AS n, d FROM (SELECT *, c_custkey % 10000 AS d FROM customer) JOIN f ON f.k = c_custkey % {len(_FORMS)}) SELECT id, stem AS term, 0 AS pos, 0 AS start, CASE WHEN length(stem) > 1 THEN length(stem) ELSE n END::INT AS stop FROM t UNION ALL SELECT id, (10000 + d)::VARCHAR, 1, (n + 1)::INT, length(s)::INT FROM t")
def ft_ja_inflections(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every form of a word has the word's stem as its term, and its place, but that a noun's verb is left out; numbers in kanji are digits."""
    k, d = F.col("c_custkey"), F.col("c_custkey") % 10000
    at = (k % len(_FORMS) + 1).cast("int")
    word = F.concat(F.element_at(F.array(*[F.lit(x[1]) for x in _FORMS]), at), F.element_at(F.array(*[F.lit(x[2]) for x in _FORMS]), at))
    digit = lambda n: F.substring(F.lit("〇一二三四五六七八九"), (n + 1).cast("int"), F.lit(1))
    places = [x for u, c in ((1000, "千"), (100, "百"), (10, "十")) for n in [F.floor(d / u) % 10] for x in (F.when(n > 1, digit(n)).otherwise(""), F.when(n > 0, c).otherwise(""))]
    said = F.concat(word, F.lit("。一万"), *places, F.when(d % 10 > 0, digit(d % 10)).otherwise(""))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(analyzers.analyzed(said, "japanese_conjugations")).alias("t"))
    return rows.select("id", "t.term", "t.pos", "t.start", F.col("t.end").alias("stop"))


# --- the ranking experiment, ratios -------------------------------------------------------------------------------------------------

#: Rankings, and the places up to which sources are counted.
SEEDS = 1000
CUTS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 200, 300, 400, 500, 1000, 2000, 3000, 5000, 10000)


@query(
    "WITH w AS (SELECT source, sum(count(*)) OVER () / (count(*) * count(*) OVER ()) AS weight FROM documents GROUP BY source), "
    f"k AS (SELECT seed, doc_id, source, pow((('0x' || substr(md5(seed || '|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0), 1 / weight) AS key FROM documents JOIN w USING (source), range({SEEDS}) s(seed)), "
    "r AS (SELECT source, row_number() OVER (PARTITION BY seed ORDER BY key DESC, doc_id) AS r FROM k) "
    f"SELECT source, cut::INT AS cut, count(*) AS hits FROM r JOIN (SELECT unnest([{', '.join(map(str, CUTS))}]) AS cut) ON r <= cut GROUP BY ALL"
)
def ag_ranking_experiment(spark, sf_dir):  # noqa: ANN001, ANN201
    """A thousand weighted random rankings at once: how often each source is among the first 10 to 10,000."""
    d = corpus.with_weights(table(spark, sf_dir, "documents").select("doc_id", "source"), "source")
    return corpus.ranking_experiment(d, SEEDS, CUTS, id_="doc_id")


@query(f"SELECT p_partkey, round(len(regexp_extract_all(s, '{text.JAPANESE_LETTERS}')) / length(s), 6) AS ratio, len(regexp_extract_all(s, '{text.JAPANESE_LETTERS}')) > 0.5 * length(s) AS dropped FROM (SELECT p_partkey, p_brand || repeat('鳳あ', p_size) AS s FROM part)")
def fl_japanese_ratio(spark, sf_dir):  # noqa: ANN001, ANN201
    """English texts of which more than half is in Japanese letters are no English."""
    ratio = text.japanese_ratio(F.concat("p_brand", F.expr("repeat('鳳あ', p_size)")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ratio, 6).alias("ratio"), (ratio > 0.5).alias("dropped"))


# --- intervals -----------------------------------------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_suppkey END AS k, floor(l_extendedprice)::BIGINT AS s, floor(l_extendedprice + l_quantity * CASE WHEN l_orderkey % 100 = 1 THEN 40 ELSE 1 END)::BIGINT AS e FROM lineitem), "
    "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS k, floor(o_totalprice)::BIGINT AS s, floor(o_totalprice)::BIGINT + o_orderkey % 40 AS e FROM orders) "
    "SELECT o_orderkey, count(*) AS lines, min(l_orderkey) AS first_order FROM l JOIN o ON l.k = o.k AND l.e > o.s AND l.s < o.e GROUP BY o_orderkey"
)
def jn_intervals(spark, sf_dir):  # noqa: ANN001, ANN201
    """Orders and lines of one key whose ranges of prices overlap; a third of both sides has the same key."""
    long = F.when(F.col("l_orderkey") % 100 == 1, 40).otherwise(1)
    key = lambda k, other: F.when(F.col(k) % 3 == 0, F.lit(-1).cast("bigint")).otherwise(F.col(other)).alias("k")
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", key("l_orderkey", "l_suppkey"), F.floor("l_extendedprice").alias("start"), F.floor(F.col("l_extendedprice") + F.col("l_quantity") * long).alias("end"))
    b = table(spark, sf_dir, "orders").select("o_orderkey", key("o_orderkey", "o_custkey"), F.floor("o_totalprice").alias("start_r"), (F.floor("o_totalprice") + F.col("o_orderkey") % 40).alias("end_r"))
    return intervals.overlap_counts(a, b, ["k"], "o_orderkey", "l_orderkey").select("o_orderkey", F.col("n").alias("lines"), F.col("l_orderkey").alias("first_order"))
