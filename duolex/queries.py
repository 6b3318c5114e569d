"""Registered queries of the relational, search, span, rule and source operators, each with its statement in SQL where there is one.

The tables of the driver stand in for the corpus: `documents` for quotes (doc_id, source), `conversations` for paired lines
(role for language, conv_id and turn for the key), `customer`, `supplier`, `part`, `orders`, `lineitem` for stores and caches,
`events` for speakers. `search_queries` and `table_queries` hold those of the search engine, of spans, formats, rules and readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import language_queries, search_queries, table_queries  # noqa: F401
from .functions import ids, spans
from .functions import text as T
from .operators import corpus, rules, store
from .plans import search
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .search_queries import flagship  # noqa: F401
from .session import table
from .sources import html, readers

# --- aggregates, weights, sampling ------------------------------------------------------------------------------------

_WEIGHTS = "SELECT source, count(*) AS n, round(sum(count(*)) OVER () / (count(*) * count(*) OVER ()), 6) AS weight FROM documents GROUP BY source"


@query(_WEIGHTS)
def ag_source_weight(spark, sf_dir):  # noqa: ANN001, ANN201
    return corpus.weights(table(spark, sf_dir, "documents"), "source").withColumn("weight", F.round("weight", 6))


_U = "(('0x' || substr(md5('42|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"WITH k AS (SELECT doc_id, source, round(pow({_U}, 1 / weight), 9) AS key FROM documents JOIN (SELECT source, sum(count(*)) OVER () / (count(*) * count(*) OVER ()) AS weight FROM documents GROUP BY source) USING (source)) SELECT doc_id, source, key FROM k ORDER BY key DESC, doc_id LIMIT 39")
def sl_weighted_random_top39(spark, sf_dir):  # noqa: ANN001, ANN201
    d = corpus.with_weights(table(spark, sf_dir, "documents").select("doc_id", "source"), "source")
    return d.select("doc_id", "source", F.round(search.random_key("42", F.col("doc_id"), F.col("weight")), 9).alias("key")).orderBy(F.desc("key"), "doc_id").limit(39)


CUTS = (10, 20, 50, 100, 200, 500)


@query(f"WITH r AS (SELECT source, row_number() OVER (ORDER BY {_U}, doc_id) AS n FROM documents) SELECT source, {', '.join(f'count(*) FILTER (n <= {c}) AS top{c}' for c in CUTS)} FROM r GROUP BY source")
def ag_topn_by_source(spark, sf_dir):  # noqa: ANN001, ANN201
    """How often each source is among the first n of a random ranking. Only the first of the largest n are ranked."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    top = d.withColumn("u", search.uniform("42", F.col("doc_id"))).orderBy("u", "doc_id").limit(max(CUTS)).withColumn("n", F.row_number().over(Window.orderBy("u", "doc_id")))
    counts = top.groupBy("source").agg(*[F.count_if(F.col("n") <= c).alias(f"top{c}") for c in CUTS])
    return d.select("source").distinct().join(counts, "source", "left").na.fill(0)


@query("SELECT l_orderkey, min_by(l_partkey, (md5('42|' || l_orderkey || '|' || l_partkey))) AS l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def sl_seeded_pick(spark, sf_dir):  # noqa: ANN001, ANN201
    """One distinct part of each order, by hash."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return d.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.md5(F.concat_ws("|", F.lit("42"), "l_orderkey", "l_partkey").cast("binary"))).alias("l_partkey"))


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def ag_having_distinct(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("flags")).filter("flags > 1")


@query("SELECT p_partkey, p_name || p_type || p_size AS voice, p_brand FROM part WHERE p_name || p_type || p_size IN (SELECT p_name || p_type || p_size FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1)")
def ag_unique_voice(spark, sf_dir):  # noqa: ANN001, ANN201
    """Parts whose name belongs to one brand only, as a voice to one speaker."""
    got = rules.unique_voices(table(spark, sf_dir, "part").select(F.col("p_partkey"), F.concat("p_name", "p_type", "p_size").alias("voice"), F.col("p_brand").alias("name")))
    return got.select("p_partkey", "voice", F.col("name").alias("p_brand"))


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'view') AS first_type, arg_min(value, event_id) FILTER (value > 100) AS first_large FROM events GROUP BY user_id")
def ag_coalesce_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("first_type"), F.when(F.col("value") > 100, F.col("value")).alias("first_large"))
    return readers.coalesced(e, "user_id", ["first_type", "first_large"], "event_id")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1")
def ag_mode_by_group(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), "event_type")).alias("m")).select("user_id", "m.*")


@query("SELECT p_brand, min_by(p_partkey, (p_size, p_partkey)) AS p_partkey, min(p_size) AS p_size FROM part GROUP BY p_brand")
def ag_min_by(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("p_partkey"), F.min("p_size").alias("p_size"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(1 - avg((event_type <> 'error')::INT), 6) AS share, avg((event_type = 'error')::INT) > 0.5 AS mostly FROM events GROUP BY user_id")
def ag_generic_ratio(spark, sf_dir):  # noqa: ANN001, ANN201
    err = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(err).alias("errors"), F.round(1 - F.avg((~err).cast("int")), 6).alias("share"), (F.avg(err.cast("int")) > 0.5).alias("mostly"))


@query("SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def sk_analysis_sheet(spark, sf_dir):  # noqa: ANN001, ANN201
    d = table(spark, sf_dir, "documents").groupBy("source")
    return d.pivot("lang", ["en", "de", "fr", "es"]).count().na.fill(0).withColumn("n", F.col("en") + F.col("de") + F.col("fr") + F.col("es")).select("source", "n", "en", "de", "fr", "es")


@query("SELECT count(*) AS n, count(DISTINCT l_partkey) AS distinct_n, count(*) - count(DISTINCT l_partkey) AS removed, bool_and(l_quantity > 0) AS all_positive, bool_or(l_tax > 0.07) AS any_taxed FROM lineitem")
def ag_counts_and_flags(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("distinct_n"), (F.count("*") - F.count_distinct("l_partkey")).alias("removed"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.bool_or(F.col("l_tax") > 0.07).alias("any_taxed"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def ag_unique_key(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.duplicate_keys(table(spark, sf_dir, "orders"), "o_custkey").withColumnRenamed("count", "n")


# --- pairing, validation, duplicates, numbering ---------------------------------------------------------------------

def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines: a user's turn and the assistant's after it share a key."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 2)).alias("key"), F.when(F.col("role") == "user", "en").when(F.col("role") == "assistant", "ja").otherwise("other").alias("language"), "text", F.lit("").alias("speaker"), F.lit("").alias("context"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("audio_path"), F.lit(0).alias("weight"), F.col("conv_id").alias("file_ordinal"), F.col("turn").alias("line_ordinal"))


_PAIR = "SELECT conv_id || '-' || (turn // 2) AS key, min_by(text, (conv_id, turn)) FILTER (role = 'user') AS en, min_by(text, (conv_id, turn)) FILTER (role = 'assistant') AS ja, count(*) FILTER (role = 'user') AS n_en, count(*) FILTER (role = 'assistant') AS n_ja FROM conversations GROUP BY 1"


@query(_PAIR)
def jn_pair_by_key(spark, sf_dir):  # noqa: ANN001, ANN201
    return corpus.pair(talk(spark, sf_dir)).select("key", F.col("en.text").alias("en"), F.col("ja.text").alias("ja"), "n_en", "n_ja")


_EN_WORDS = r"\p{L}+(?:[''’]\p{L}+)*|\d+(?:[,.]\d+)*"
_REASON = f"CASE WHEN en IS NULL THEN 'no english' WHEN ja IS NULL THEN 'no japanese' WHEN trim(en) = '' THEN 'blank english' WHEN trim(ja) = '' THEN 'blank japanese' WHEN NOT regexp_matches(ja, '{T.KANJI_OR_HIRAGANA}') THEN 'not japanese' WHEN len(regexp_extract_all(en, '{_EN_WORDS}')) < 2 THEN 'too few words' WHEN len(regexp_extract_all(en, '{_EN_WORDS}')) > 100 THEN 'too many words' END"


@query(f"WITH p AS ({_PAIR}) SELECT key, {_REASON} AS reason FROM p")
def fl_validate_reason(spark, sf_dir):  # noqa: ANN001, ANN201
    return corpus.validated(corpus.pair(talk(spark, sf_dir))).select("key", "reason")


@query(f"SELECT conv_id, turn, len(regexp_extract_all(text, '{_EN_WORDS}'))::BIGINT AS words FROM conversations WHERE len(regexp_extract_all(text, '{_EN_WORDS}')) BETWEEN 2 AND 100")
def fl_word_count_range(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "conversations").withColumn("words", T.word_count(F.col("text")).cast("bigint"))
    return c.filter("words between 2 and 100").select("conv_id", "turn", "words")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_returnflag = 'N', l_quantity DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem) SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM r WHERE k = 1")
def wn_dedup_prefer_speaker(spark, sf_dir):  # noqa: ANN001, ANN201
    """One line of each pair: one with a flag before one without, then the largest, then the first."""
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_returnflag") == "N", "").otherwise("x").alias("speaker"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return corpus.deduplicated(d, "l_partkey", "l_suppkey", "speaker", "l_quantity", "ord").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id * 1000000 + turn) - 1 AS index FROM conversations WHERE role = 'user'")
def wn_running_index(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 1000000 + F.col("turn")).alias("ord"))
    return corpus.running_index(c, "ord").select("conv_id", "turn", "index")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index FROM conversations")
def wn_index_in_scene(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("bigint").alias("index"))


@query("SELECT event_type, min_by(event_id, event_id) AS event_id, list_sort(list(DISTINCT user_id)) AS children FROM events GROUP BY event_type")
def wn_winning_override(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("event_id").alias("priority"), F.array("user_id").alias("children"))
    pre = e.groupBy("event_type", "children").agg(F.min("event_id").alias("event_id"), F.min("priority").alias("priority"))
    return rules.winning(pre, "event_type").select("event_type", "event_id", "children")


@query("SELECT DISTINCT source, lang FROM documents")
def ag_distinct(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


# --- ids --------------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, (3::BIGINT << 48) | ((doc_id % 65536) << 32) | (doc_id % 7) AS pair_id, (1::BIGINT << 48) | (doc_id << 16) | (doc_id % 100) AS form_id, (5::BIGINT << 48) | doc_id AS index_id FROM documents")
def id_pack(spark, sf_dir):  # noqa: ANN001, ANN201
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", ids.pack_pair(F.lit(3), d % 65536, d % 7).alias("pair_id"), ids.pack_form(F.lit(1), d, d % 100).alias("form_id"), ids.pack_index(F.lit(5), d, reserved=(1, 3)).alias("index_id"))


@query("WITH p AS (SELECT doc_id, (1::BIGINT << 48) | (doc_id << 16) | (doc_id % 100) AS id FROM documents) SELECT doc_id, id >> 48 AS source, (id >> 16) & 4294967295 AS form, lpad(printf('%X', (id >> 16) & 4294967295), 8, '0') AS form_hex, id & 65535 AS response FROM p")
def id_unpack(spark, sf_dir):  # noqa: ANN001, ANN201
    d = table(spark, sf_dir, "documents").select("doc_id", ids.pack_form(F.lit(1), F.col("doc_id"), F.col("doc_id") % 100).alias("id"))
    form, response = ids.form_of(F.col("id"))
    return d.select("doc_id", ids.source_of(F.col("id")).alias("source"), form.alias("form"), ids.form_hex(form).alias("form_hex"), response.alias("response"))


# --- store --------------------------------------------------------------------------------------------------------------

@query("WITH s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'), i AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW') SELECT coalesce(s.id, i.id) AS id, CASE WHEN s.id IS NULL THEN 'I' WHEN i.id IS NULL THEN 'D' ELSE 'U' END AS action FROM s FULL JOIN i ON s.id = i.id")
def sk_merge_reconcile(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), "o_orderpriority")
    return store.reconcile(o.filter("o_orderpriority <> '1-URGENT'"), o.filter("source = 'O' and o_orderpriority <> '5-LOW'"), "O")


@query("SELECT o_orderkey AS id, o_orderstatus AS source FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '1-URGENT' OR o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'")
def sk_replace_source(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), "o_orderpriority")
    return store.replaced(o.filter("o_orderpriority <> '1-URGENT'"), o.filter("source = 'O' and o_orderpriority <> '5-LOW'"), "O").select("id", "source")


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jn_anti_cache(spark, sf_dir):  # noqa: ANN001, ANN201
    """Customers that have no object in a bucket, the order status."""
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"))
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("bucket"), F.col("o_custkey").alias("object_name"))
    return store.not_uploaded(files, objects, "F")


@query("SELECT o_custkey || '.' || o_orderkey || '.m4a' AS object_name FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn_anti_basename(spark, sf_dir):  # noqa: ANN001, ANN201
    objects = table(spark, sf_dir, "orders").select(F.concat_ws(".", "o_custkey", "o_orderkey", F.lit("m4a")).alias("object_name"))
    files = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".mp3")).alias("name"))
    return store.stale_objects(objects, files)


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)")
def jn_orphans(spark, sf_dir):  # noqa: ANN001, ANN201
    q = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.struct(F.col("l_partkey").alias("audio_file")).alias("english"), F.struct(F.col("l_suppkey").alias("audio_file")).alias("japanese"))
    return store.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name")), q)


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS batch FROM orders")
def sk_batches_1000(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def sk_upsert_latest(spark, sf_dir):  # noqa: ANN001, ANN201
    """A cache and newer rows for some of its keys: newer rows win, of each the latest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    cols = ["o_custkey", "o_orderkey", "o_orderpriority"]
    return store.upsert_cache(o.filter("o_orderstatus <> 'O'").select(*cols), o.filter("o_orderstatus = 'O'").select(*cols), "o_custkey", "o_orderkey")


@query("SELECT s_suppkey AS name, unnest(CASE WHEN s_suppkey % 2 = 0 THEN [s_suppkey || '.mp3'] ELSE [s_suppkey || '.ogg', s_suppkey || '.m4a'] END) AS target FROM supplier")
def sk_upload_manifest(spark, sf_dir):  # noqa: ANN001, ANN201
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".mp3").otherwise(".ogg")).alias("name"))
    return store.upload_manifest(s).select(F.split("name", r"\.")[0].cast("bigint").alias("name"), "target")


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'MACHINERY' LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn_lookup_left(spark, sf_dir):  # noqa: ANN001, ANN201
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c.filter("c_mktsegment <> 'MACHINERY'"), o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    return j.select("o_orderkey", "c_name", "n_name")


@query("SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY l_partkey")
def jn_collect_voices(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("SELECT user_id, event_type FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c_acctbal > 0)")
def jn_existence(spark, sf_dir):  # noqa: ANN001, ANN201
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return e.join(c, e.user_id == c.c_custkey, "left_semi").select("user_id", "event_type")


# --- spans -----------------------------------------------------------------------------------------------------------


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_quantity + 5 > b.l_quantity AND a.l_quantity < b.l_quantity + 5")
def jn_interval_overlap(spark, sf_dir):  # noqa: ANN001, ANN201
    """Intervals [quantity, quantity + 5) of an order's lines that overlap: an array for each order, so only orders meet."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("x"))
    a = d.select("l_orderkey", F.explode("x").alias("a"), "x")
    hit = F.filter("x", lambda b: (F.col("a.l_linenumber") < b["l_linenumber"]) & spans.overlap(F.col("a.l_quantity"), F.col("a.l_quantity") + 5, b["l_quantity"], b["l_quantity"] + 5))
    return a.select("l_orderkey", F.col("a.l_linenumber"), F.explode(hit).alias("b")).select("l_orderkey", "l_linenumber", F.col("b.l_linenumber").alias("other"))


_ENCODED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), QFOUR, '&#39;')".replace("QFOUR", "'" * 4)


@query(f"SELECT doc_id, '<mark>' || {_ENCODED.format('substr(t, 1, 5)')} || '</mark>' || {_ENCODED.format('substr(t, 6)')} AS html FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def ft_apply_marks(spark, sf_dir):  # noqa: ANN001, ANN201
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", spans.marked(F.col("text"), F.array(spans.span(F.lit(0), F.lit(5)))).alias("html"))


# --- sets --------------------------------------------------------------------------------------------------------------

@query("SELECT n_nationkey AS key FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def st_union_distinct(spark, sf_dir):  # noqa: ANN001, ANN201
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).distinct(), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).distinct()
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key")).unionByName(c).unionByName(s).distinct()


@query("WITH a AS (SELECT l_partkey, list(DISTINCT l_suppkey) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey, list(DISTINCT l_suppkey) AS y FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_partkey, list_sort(list_intersect(x, y)) AS both FROM a JOIN b USING (l_partkey) WHERE len(list_intersect(x, y)) > 0")
def st_intersect_voice(spark, sf_dir):  # noqa: ANN001, ANN201
    """Suppliers of a part in both archives: one aggregation, no join."""
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    d = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.array_sort(F.array_intersect(of("A"), of("R"))).alias("both"))
    return d.filter(F.size("both") > 0)


@query("SELECT c_nationkey AS key FROM customer WHERE c_nationkey <> 3 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def st_except(spark, sf_dir):  # noqa: ANN001, ANN201
    c = table(spark, sf_dir, "customer").filter("c_nationkey <> 3").select(F.col("c_nationkey").alias("key")).distinct()
    return c.join(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("key")), "key", "left_anti")


@query("SELECT text FROM (SELECT 'a' AS tag, p_name AS text FROM part UNION ALL SELECT 'b', c_mktsegment FROM customer) GROUP BY text HAVING count(DISTINCT tag) = 1")
def st_only_in_one(spark, sf_dir):  # noqa: ANN001, ANN201
    a = table(spark, sf_dir, "part").select(F.lit("a").alias("tag"), F.col("p_name").alias("text"))
    b = table(spark, sf_dir, "customer").select(F.lit("b").alias("tag"), F.col("c_mktsegment").alias("text"))
    return a.unionByName(b).groupBy("text").agg(F.count_distinct("tag").alias("n")).filter("n = 1").select("text")


# --- scalar functions ---------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_EN_WORDS}'))::BIGINT AS n_tokens, list_extract(regexp_extract_all(coalesce(text, ''), '{_EN_WORDS}'), 1) AS first FROM documents")
def sf_english_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    t = table(spark, sf_dir, "documents").select("doc_id", T.english_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.get("t", F.lit(0)).alias("first"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_UNWRAPPED = f"SELECT doc_id, CASE WHEN regexp_matches(t, '(?s)^[\"“「『].*[\"”」』]$') THEN {_TRIM.format('substr(t, 2, length(t) - 2)')} ELSE t END AS t FROM (SELECT doc_id, {_TRIM.format('q')} AS t FROM (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN ' 「' || coalesce(text, '') || '” ' ELSE coalesce(text, '') END AS q FROM documents))"


@query(rf"SELECT doc_id, md5(regexp_replace(t, '\s+', ' ', 'g')) AS english, md5(regexp_replace(t, '[\r\n]', '', 'g')) AS japanese FROM ({_UNWRAPPED})")
def sf_format_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """All documents, those of an even length in quotation marks."""
    t = F.coalesce("text", F.lit(""))
    q = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit(" 「"), t, F.lit("” "))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.format_english(q).cast("binary")).alias("english"), F.md5(T.format_japanese(q).cast("binary")).alias("japanese"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS similarity FROM part")
def sf_levenshtein(spark, sf_dir):  # noqa: ANN001, ANN201
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"), F.round(T.similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("SELECT s_suppkey, substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || substr(h, 5) || '.mp3' AS path FROM (SELECT s_suppkey, sha1(s_name) AS h FROM supplier)")
def sf_sha1_path(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.sha1_path(F.col("s_name").cast("binary"), F.lit("mp3")).alias("path"))


@query("SELECT a.n_regionkey, min(round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6)) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY 1")
def sf_similarity_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    """The least similarity of two names of a group, pairs inside small groups only."""
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return j.groupBy(F.col("a.n_regionkey").alias("n_regionkey")).agg(F.min(F.round(T.similarity(F.col("a.n_name"), F.col("b.n_name")), 6)).alias("similarity"))


@query("SELECT event_id, to_timestamp(epoch(date_trunc('second', ts))::BIGINT)::TIMESTAMP AS at, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def sf_unix_seconds(spark, sf_dir):  # noqa: ANN001, ANN201
    e = table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds"))
    return e.select("event_id", F.timestamp_seconds("seconds").cast("timestamp_ntz").alias("at"), "seconds")


@query("SELECT o_orderkey, 'file:///orders/' || replace(o_orderpriority, chr(92), '/') || '#' || o_orderkey AS uri, split_part(o_orderpriority, '-', 1) AS base, upper(substr(o_orderpriority, 1, 1)) || substr(o_orderpriority, 2) AS title FROM orders")
def sf_uri_and_title(spark, sf_dir):  # noqa: ANN001, ANN201
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.file_uri(F.lit("orders"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("uri"), F.split("o_orderpriority", "-")[0].alias("base"), T.scene_title(F.col("o_orderpriority"), F.lit("en")).alias("title"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') ORDER BY c_custkey LIMIT 50")
def sl_autocomplete(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "customer").filter(T.kana_folded(F.col("c_name")).contains("12")).orderBy("c_custkey").limit(50).select("c_custkey", "c_name")


@query("SELECT doc_id, to_json({'docId': doc_id, 'source': source, 'lang': lang}) AS j FROM documents")
def sf_quote_json(spark, sf_dir):  # noqa: ANN001, ANN201
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("docId"), "source", "lang")).alias("j"))


# --- sources -----------------------------------------------------------------------------------------------------------------

@query("SELECT page_id, 0 AS row, replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, len(regexp_extract_all(h, '<a\\s[^>]*href'))::INT AS n_links, len(regexp_extract_all(h, '<p[\\s>]'))::INT AS n_paragraphs, len(regexp_extract_all(h, '<li[\\s>]'))::INT AS n_items FROM (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script[^>]*>.*?</script>', '', 'g') AS h FROM pages)")
def sc_html_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return html.read_rows(table(spark, sf_dir, "pages"), html.page_outline, html.OUTLINE)


@query("SELECT source, lang FROM documents WHERE lang IN ('en', 'fr') AND source <> 'src0'")
def sc_projected_scan(spark, sf_dir):  # noqa: ANN001, ANN201
    """Two columns of all rows: the filters reach the scan, no other column is read."""
    return table(spark, sf_dir, "documents").filter("lang in ('en', 'fr') and source <> 'src0'").select("source", "lang")
