import pytest
from pyspark.sql import functions as F

from duolex.operators import corpus, rules, store, versions
from duolex.plans import align, growing
from duolex.plans.index import MARKER, build_index, read_index
from duolex.plans.search import search
from duolex.sources import html, readers
from duolex.streaming.validate import valid_pairs_stream

LINE = "key string, language string, text string, speaker string, context string, notes string, audio_path string, weight int, file_ordinal int, line_ordinal int"


def lines(spark, rows):
    return spark.createDataFrame([(k, lang, t, s, "", "", None, w, 0, i) for i, (k, lang, t, s, w) in enumerate(rows)], LINE)


def corpus_rows():
    return [("a", "en", "Reporting for duty today", "Ann", 0), ("a", "ja", "着任しました", "アン", 0), ("b", "en", "Reporting  for duty today", "", 5), ("b", "ja", "着任しました", "", 5), ("c", "en", "Only english here", "", 0), ("d", "en", "One", "", 0), ("d", "ja", "一つ", "", 0)]


def test_import(spark):
    q = corpus.import_corpus(lines(spark, corpus_rows()), "game", 5, align=lambda p: p.withColumn("alignment_data", F.array().cast("array<struct<from_start:int,from_end:int,to_start:int,to_end:int>>")))
    rows = q.collect()
    assert len(rows) == 1 and rows[0].english.speaker_name == "Ann" and rows[0].id >> 48 == 5 and rows[0].english.word_count == 4


def test_reasons(spark):
    got = {r.key: r.reason for r in corpus.validated(corpus.pair(lines(spark, corpus_rows()))).collect()}
    assert got == {"a": None, "b": None, "c": "no japanese", "d": "too few words"}


def test_hard_failures(spark):
    twice = lines(spark, [("a", "en", "x y", "", 0), ("a", "en", "z y", "", 0), ("a", "ja", "あ", "", 0)])
    with pytest.raises(Exception, match="twice"):
        corpus.checked(corpus.pair(twice)).collect()
    assert corpus.checked(corpus.pair(twice), fail_on_duplicates=False).first().en.text == "x y"
    with pytest.raises(Exception, match="one language only"):
        corpus.checked(corpus.pair(lines(spark, [("a", "en", "x y", "Ann", 0), ("a", "ja", "あ", "", 0)]))).collect()


def test_running_index_spreads(spark):
    d = spark.range(1000).select((999 - F.col("id")).alias("o"))
    got = corpus.running_index(d, "o").collect()
    assert all(r["index"] == r.o for r in got)


def test_weights(spark):
    d = spark.createDataFrame([("a",)] * 3 + [("b",)], "s string")
    assert {r.s: r.weight for r in corpus.weights(d, "s").collect()} == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_merge_and_orphans(spark):
    s = spark.createDataFrame([(100, "A"), (101, "A"), (200, "B")], "id int, source string")
    i = spark.createDataFrame([(100, "A"), (102, "A")], "id int, source string")
    assert {r.id: r.action for r in store.reconcile(s, i, "A").collect()} == {100: "U", 101: "D", 102: "I"}
    assert sorted(r.id for r in store.replaced(s, i, "A").collect()) == [100, 102, 200]
    with pytest.raises(Exception, match="another source"):
        store.reconcile(s, s, "A").collect()


def test_audio_import(spark):
    f = spark.createDataFrame([(bytearray.fromhex("fffb39393939"), "u1"), (bytearray.fromhex("fffb39393939"), "u2"), (bytearray.fromhex("49443301"), "u3")], "data binary, uri string")
    got = store.import_audio(spark.createDataFrame([], "name string"), f).collect()
    assert len(got) == 2 and all(r.name.endswith(".mp3") for r in got)
    cache = spark.createDataFrame([("http://x/a#1", "n1", 0)], "original_uri string, object_name string, ord int")
    new = spark.createDataFrame([("http://x/a#1", "n2", 0), ("http://x/a#2", "n3", 1)], "original_uri string, object_name string, ord int")
    assert {r.original_uri: r.object_name for r in store.upsert_cache(cache, new).collect()} == {"http://x/a#1": "n2", "http://x/a#2": "n3"}
    want = spark.createDataFrame([("http://x/a#1",), ("http://x/a",)], "uri string")
    assert {r.uri: r.object_name for r in store.cached_or_missing(want, cache).collect()} == {"http://x/a#1": "n1", "http://x/a": None}
    ext = store.first_extension(spark.createDataFrame([("v/1",), ("v/2",)], "path string"), spark.createDataFrame([("v/1.mp3",), ("v/1.ogg",)], "path string"))
    assert {r.path: r.found for r in ext.collect()} == {"v/1": "v/1.ogg", "v/2": None}


def test_save_source(spark, tmp_path):
    p = str(tmp_path / "store")
    spark.createDataFrame([(1, "A"), (2, "B"), (4, "C/d")], "id int, source string").write.partitionBy("source").parquet(p)
    rows = lambda *r: spark.createDataFrame(list(r), "id int, source string")
    store.save_source(rows((3, "A")), p, "A")
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="another source"):
        store.save_source(rows((5, "B"), (6, "A")), p, "B")
    store.save_source(rows(), p, "A")
    store.save_source(rows(), p, "C/d")
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [2]


def test_versions(spark, tmp_path):
    p = str(tmp_path / "versions")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, source string, text string")
    ids = lambda n=None: sorted((r.id, r.text) for r in versions.read(spark, p, n).collect())
    assert versions.create(rows((1, "A", "a"), (2, "A", "b"), (3, "B", "c")), p) == 1
    assert versions.replace_source(rows((2, "A", "new"), (4, "A", "d")), p, "A") == 2
    assert ids() == [(2, "new"), (3, "c"), (4, "d")] and ids(1) == [(1, "a"), (2, "b"), (3, "c")]
    assert versions.replace_source(rows(), p, "A") == 3  # a source that comes without rows leaves none
    assert ids() == [(3, "c")]
    before = sorted(x.name for x in (tmp_path / "versions" / "data").iterdir())
    for bad, why in ((rows((5, "B", "x"), (6, "A", "y")), "another source"), (rows((5, "B", "x"), (5, "B", "y")), "twice"), (rows((None, "B", "x")), "without a key"), (rows((5, None, "x")), "another source")):
        with pytest.raises(Exception, match=why):
            versions.replace_source(bad, p, "B")
        assert versions.version(spark, p) == 3 and ids() == [(3, "c")]  # a failed write leaves the table as it was
    assert sorted(x.name for x in (tmp_path / "versions" / "data").iterdir()) == before
    with pytest.raises(versions.Conflict):  # somebody else wrote since version 2
        versions.replace_source(rows((9, "B", "z")), p, "B", expected=2)
    assert ids() == [(3, "c")]
    assert versions.compact(spark, p) == 4 and ids() == [(3, "c")]
    assert versions.replace_source(rows((7, "C", "e")), p, "C", expected=4) == 5
    assert versions.vacuum(spark, p) and ids() == [(3, "c"), (7, "e")]
    with pytest.raises(versions.Conflict):
        versions.create(rows(), p)


def test_files_of_one_name(spark, tmp_path):
    for folder, text in (("x 1", "a\nb"), ("y", "c\nd")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.ks").write_text(text)
    got = sorted((r.file, r.line_ordinal, r.line) for r in readers.text_lines(spark, f"{tmp_path}/*/*.ks").collect())
    assert got == [("x 1/s.ks", 0, "a"), ("x 1/s.ks", 1, "b"), ("y/s.ks", 0, "c"), ("y/s.ks", 1, "d")]
    assert {r.file for r in readers.text_lines(spark, str(tmp_path / "y")).collect()} == {"s.ks"}
    assert {r.file for r in readers.text_lines(spark, str(tmp_path / "y" / "s.ks")).collect()} == {"s.ks"}


def test_chains(spark):
    """Chains of every length to 40, cycles, parents that are no nodes, levelled lists; the plan of a round has one join."""
    n = "id int, up int, v string, w string"
    rows = [(i, i + 1 if i < 40 else None, "end" if i == 40 else None, f"w{i}" if i % 7 == 0 else None) for i in range(41)]
    rows += [(50, 51, None, None), (51, 52, None, "c"), (52, 50, None, None), (60, 60, None, None), (61, 999, None, "x"), (70, -1, None, None), (71, None, "list", None)]
    d = spark.createDataFrame(rows, n)
    entries = spark.createDataFrame([(-1, 5, 0, 40), (-1, 1, 2, 71), (-1, 1, 1, 10), (-1, None, 0, 50)], "id int, level int, ord int, item int")
    all_nodes = rules.levelled_nodes(d, entries, "id", "up", ["v", "w"], order="ord")
    got = {r.id: (r.v, r.w) for r in rules.follow_chain(all_nodes, "id", "up", ["v", "w"]).collect()}
    for i in range(41):
        first = next((f"w{j}" for j in range(i, 41) if j % 7 == 0), None)
        assert got[i] == ("end", first)
    assert [got[k] for k in (50, 51, 52, 60, 61)] == [(None, "c"), (None, "c"), (None, "c"), (None, None), (None, "x")]
    assert got[-1] == got[70] == got[10]  # the first of the lowest entries goes on
    objects = spark.createDataFrame([(1, None, "Tav_1", "own"), (2, 1, None, None), (3, None, "x", "three"), (4, 3, None, None)], "id int, template int, name string, display string")
    assert {r.id: r.display for r in rules.display_names(objects, "Tav", "you").collect()} == {1: "you", 2: "you", 3: "three", 4: "three"}


def test_winning_children_once(spark):
    r = spark.createDataFrame([("k", 2, "late", ["a", "b"]), ("k", 1, "early", ["b", "c"]), ("k", 3, "x", None), ("m", 1, "y", []), (None, 1, "z", ["q"])], "form_key string, priority int, name string, children array<string>")
    got = {x.form_key: (x.name, x.children) for x in rules.winning(r).collect()}
    assert got == {"k": ("early", ["a", "b", "c"]), "m": ("y", []), None: ("z", ["q"])}


def test_weights_of_a_null_group(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, g string")
    assert {r.id: r.weight for r in corpus.with_weights(d, "g").collect()} == {1: 1.5, 2: 0.75, 3: 0.75}


def quotes(spark):
    t = "struct<speaker_name:string,context:string,text:string,word_count:int,notes:string,audio_file:string>"
    rows = [
        (1, "A", ("Zuihou", "", "Reporting for duty.", 3, "", None), ("瑞鳳", "", "着任しました。", 2, "", None), [(0, 9, 0, 2), (10, 18, 2, 6)]),
        (2, "A", ("Tama", "", "Duty reports are boring, not for me", 7, "", None), ("多摩", "", "報告は退屈", 3, "", None), []),
        (3, "B", ("Hachi Roku", "", "No match at all", 4, "", None), ("ハチ", "", "鏡を見る", 3, "", None), []),
    ]
    return spark.createDataFrame(rows, f"id long, source string, english {t}, japanese {t}, alignment_data array<struct<from_start:int,from_end:int,to_start:int,to_end:int>>")


def test_growing_index(spark, tmp_path):
    """Documents added, changed and dropped: every table, and a search, are those of an index built anew."""
    p, q = str(tmp_path / "growing"), quotes(spark)
    changed = q.filter("id = 2").withColumn("source", F.lit("C")).withColumn("english", F.col("english").withField("text", F.lit("Reporting late, Tama")))
    new = q.filter("id = 3").withColumn("id", F.lit(4).cast("long"))
    growing.put(q.filter("id <> 3"), p)
    growing.put(q.filter("id = 3"), p)
    growing.put(changed.unionByName(new), p)
    growing.drop(spark.createDataFrame([(3,), (99,)], "id long"), p)
    whole = build_index(q.filter("id = 1").unionByName(changed).unionByName(new))
    rows = lambda t, *c: sorted(map(str, t.select(*c).collect()))

    def same():
        got = growing.read(spark, p)
        assert rows(got.docs, "id", "source", "weight", "english") == rows(whole.docs, "id", "source", "weight", "english")
        assert rows(got.postings, "field", "term", "id", "tf", "positions") == rows(whole.postings, "field", "term", "id", "tf", "positions")
        assert rows(got.stats, "field", "term", "df") == rows(whole.stats, "field", "term", "df")
        assert rows(got.sizes, "field", "n") == rows(whole.sizes, "field", "n")
        assert rows(search(got, "reporting"), "id", "score", "english_highlights") == rows(search(whole, "reporting"), "id", "score", "english_highlights")

    same()
    before = versions.version(spark, p)
    assert growing.drop(spark.createDataFrame([(3,)], "id long"), p) == before  # nothing to drop
    with pytest.raises(ValueError, match="twice"):
        growing.put(new.unionByName(new), p)
    assert versions.version(spark, p) == before
    growing.compact(spark, p)
    same()


def test_search(spark, tmp_path):
    index = build_index(quotes(spark))
    got = search(index, "reporting for duty").collect()
    assert [r.id for r in got][:2] == [1, 2] and [tuple(s) for s in got[0].english_highlights] == [(0, 18)]
    assert [tuple(s) for s in got[0].japanese_highlights] == [(0, 6)]
    assert [r.id for r in search(index, "鏡").collect()] == [3]
    assert [r.id for r in search(index, "@Hachi_Roku").collect()] == [3]
    assert [r.id for r in search(index, "duty @Tama").collect()] == [2]
    assert search(index, "aa @" + "x" * 31).count() == 0
    assert [tuple(s) for s in search(index, "着任").collect()[0].japanese_highlights] == [(0, 2)]
    build_index(quotes(spark), path=str(tmp_path / "ix"), partitions=3)
    again = read_index(spark, str(tmp_path / "ix"))
    assert [r.id for r in search(again, "reporting for duty").collect()] == [r.id for r in got]


def test_postings_stay_with_their_documents(spark, tmp_path):
    """A document's postings of a field are in one file, whatever their terms: they were sorted where they were made."""
    path = str(tmp_path / "ix")
    index = build_index(quotes(spark), path=path, partitions=3)
    at = index.postings.withColumn("f", F.input_file_name()).groupBy("field", "id").agg(F.count_distinct("f").alias("n"), F.count("*").alias("terms"))
    assert at.filter("n > 1").isEmpty() and at.agg(F.max("terms")).first()[0] > 1
    assert index.postings.filter("term is null").isEmpty() and index.stats.filter("term is null").isEmpty()


def test_phrase_counts(spark):
    """In a row, as by the places; the phrase with a word twice too."""
    from duolex.plans.search import phrase, phrase_counts

    texts = ["a b a b", "b a", "a a a", "a b", "x a b a"]
    q = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, source string, t string")
    side = lambda t: F.struct(F.lit("").alias("speaker_name"), F.lit("").alias("context"), t.alias("text"), F.lit(0).alias("word_count"), F.lit("").alias("notes"), F.lit(None).cast("string").alias("audio_file"))
    index = build_index(q.select("id", "source", side(F.col("t")).alias("english"), side(F.lit("")).alias("japanese"), F.array().cast("array<struct<from_start:int,from_end:int,to_start:int,to_end:int>>").alias("alignment_data")), fields=(("english.text", "english", "default"),))
    for terms, want in (("a b", {0: 2, 3: 1, 4: 1}), ("a a", {2: 2}), ("a b a", {0: 1, 4: 1})):
        words = [(t, i) for i, t in enumerate(terms.split())]
        assert {r.id: r.tf for r in phrase_counts(index, "english.text", words).collect()} == want
        scores = lambda d: {r.id: round(r.score, 9) for r in d.collect()}
        assert scores(phrase(index, "english.text", words, places=False)) == scores(phrase(index, "english.text", words))


def test_marker_guard(spark):
    bad = quotes(spark).withColumn("english", F.col("english").withField("text", F.lit("a" + MARKER)))
    with pytest.raises(Exception, match="marker"):
        build_index(bad)


def test_align(spark):
    p = spark.createDataFrame([(1, "aa bb", "犬ねこ"), (2, "", "")], "id int, en string, ja string")
    got = {r.id: r.alignment_data for r in align.align_symmetric(p, align.same_place).collect()}
    assert got[1] and got[2] == []
    tokens = spark.createDataFrame([("a cat", [("a", 0, 0, 1), ("cat", 1, 2, 5)])], "t string, k array<struct<term:string,pos:int,start:int,end:int>>")
    assert tokens.select(align.questions(F.col("t"), F.col("k"))).first()[0] == [" ¶ a ¶  cat", "a  ¶ cat ¶ "]


def test_threshold(spark):
    p = spark.createDataFrame([(1, "aa", "犬")], "id int, en string, ja string")
    low = lambda ask: [(0.05, 0, 1) for _ in ask]
    assert align.align_symmetric(p, low).first().alignment_data == []
    with pytest.raises(Exception, match="number of answers"):
        align.align_symmetric(p, lambda ask: []).collect()


def test_rule_helpers(spark):
    npcs = spark.createDataFrame([("n1", "v1", "A", [("F", 0)]), ("n2", "v1", "B", [("F", -1)]), ("n3", "v2", "C", [])], "npc string, voice string, name string, factions array<struct<faction:string,rank:int>>")
    extra = spark.createDataFrame([("F", "n3")], "faction string, npc string")
    assert sorted(r.npc for r in rules.faction_members(npcs, extra).collect()) == ["n1", "n2", "n3"]
    assert sorted(r.npc for r in rules.faction_members(npcs, extra, negated_rank=True).collect()) == ["n1"]
    assert [r.npc for r in rules.unique_voices(npcs).collect()] == ["n3"]
    v = spark.createDataFrame([("en", 1, 1, "v1"), ("ja", 1, 1, "V1"), ("en", 1, 2, "v1"), ("ja", 1, 2, "v1"), ("en", 1, 1, "v2")], "archive string, form int, response int, voice string")
    r = spark.createDataFrame([(1, 1), (1, 2)], "form int, response int")
    named = npcs.select("npc", F.lit("x").alias("name_en"), F.lit("y").alias("name_ja"), "voice")
    assert sorted(x.npc for x in rules.valid_speakers(named, r, v).collect()) == ["n1", "n2"]
    own = spark.createDataFrame([(1, 1, "a"), (1, 2, "zz")], "info int, response int, voice string")
    there = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "info int, response int, voice string")
    assert [x.voice for x in rules.choose_voices(own, there).orderBy("response").collect()] == ["a", "b"]
    al = spark.createDataFrame([("q", "1", [], [], ["n1"], ["n2"]), ("q", "2", [], [], [], []), ("q", "3", [], [], [], [])], "quest string, alias string, created array<string>, forced array<string>, unique array<string>, conditions array<string>")
    ex = spark.createDataFrame([("q", "2", "q", "1"), ("q", "3", "q", "3")], "quest string, alias string, to_quest string, to_alias string")
    assert sorted((x.alias, x.npc) for x in rules.resolve_aliases(al, ex).collect()) == [("1", "n1"), ("2", "n1")]
    sc = rules.scene_speakers(spark.createDataFrame([("t",)], "topic string"), spark.createDataFrame([("t", "s", "1")], "topic string, scene string, alias string"), spark.createDataFrame([("s", "1", "n9")], "scene string, alias string, npc string"))
    assert sc.first().npc == "n9"
    fb = rules.with_fallback(spark.createDataFrame([("t", "n")], "topic string, npc string"), spark.createDataFrame([("t", "x"), ("u", "y")], "topic string, npc string"))
    assert {x.topic: x.npc for x in fb.collect()} == {"t": "n", "u": "y"}
    inf = spark.createDataFrame([("i", "p1", "p2"), ("j", "p2", "p1")], "info string, plugin string, topic_plugin string")
    assert [x.info for x in rules.current_infos(inf, spark.createDataFrame([("p1", 0), ("p2", 1)], "plugin string, ord int")).collect()] == ["j"]


def test_sources(spark, tmp_path):
    xml = tmp_path / "l.xml"
    xml.write_text('<contentList><content contentuid="h1">A &amp; b</content><content contentuid="h2">x</content></contentList>')
    assert {r.id: r.text for r in readers.localized(spark, str(xml)).collect()} == {"h1": "A & b", "h2": "x"}
    xml.write_text('<contentList><content contentuid="h1">A</content><content contentuid="h1">x</content></contentList>')
    with pytest.raises(Exception, match="twice"):
        readers.localized(spark, str(xml)).collect()
    js = tmp_path / "o.lsj"
    js.write_text('{"save":{"regions":{"Templates":{"GameObjects":[{"MapKey":{"value":"AB"},"Name":{"value":"n"}},{"MapKey":{"value":"ab"},"DisplayName":{"handle":"h1"}}]},"VoiceMetaData":{"VoiceSpeakerMetaData":[{"MapKey":{"value":"AB"},"MapValue":[{"VoiceTextMetaData":[{"MapKey":{"value":"h1"},"MapValue":[{"Source":{"value":"a.wem"}}]}]}]}]}}}}')
    files = readers.lsj(spark, str(js))
    assert [tuple(r) for r in readers.lsj_objects(files).collect()] == [("ab", "h1", None, "n")]
    assert [tuple(r) for r in readers.lsj_lines(files).collect()] == [("ab", "h1", "a.wem")]
    f = tmp_path / "a.tsv"
    f.write_text("1\tx\n2\ty\n")
    t = readers.tsv(readers.text_lines(spark, str(f)), ["IntKey", "Text"])
    assert [(r.key_int, r.text) for r in t.orderBy("line_ordinal").collect()] == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="line 1"):
        readers.tsv(readers.text_lines(spark, str(f)), ["IntKey", "Text", "Notes"]).collect()
    ls = spark.createDataFrame([("a/B.ks",), ("a/skip.ks",), ("b.txt",)], "path string")
    assert [r.path for r in readers.pick_files(ls, ["*.KS", "!*skip*"]).collect()] == ["a/B.ks"]
    with pytest.raises(ValueError, match="archive"):
        readers.voice_files(spark.createDataFrame([("x", 0)], "path string, ord int"), excluded=("nope",))


def test_html():
    assert html.sanitize('<b>x</b><script>bad()</script><a href="javascript:1">y</a><br>') == 'x<a target="_blank" rel="external nofollow noreferrer">y</a><br>'
    page = '<table><tr><td>12</td><td><a href="/s">Ship</a> 船</td></tr><tr><td>12</td><td><a href="/s">Ship</a></td></tr></table>'
    assert html.table_links(page) == [{"number": 12, "href": "/s", "name": "Ship", "other_name": "船"}]


def test_long_pages():
    """A page of very many rows: time and memory follow its length, rows within rows and after others stay in order."""
    import time
    import tracemalloc

    pair = '<tr><td rowspan="2"><b>E {}</b></td><td>en</td></tr><tr><td>ja</td></tr>'
    took = []
    for n in (1000, 8000):
        page = '<div class="mw-parser-output"><table>' + "".join(pair.format(i) for i in range(n)) + "</table></div>"
        t = time.process_time()
        assert [r["scenario"] for r in html.quote_rows(page)] == [f"E {i}" for i in range(n)]
        took.append(time.process_time() - t)
    assert took[1] < 30 * took[0]  # 8 times the rows; 64 times the time if each row looked through all
    page = "<table>" + "".join(f'<tr><td>{i}</td><td><a href="/n{i}">C</a> c</td></tr>' for i in range(20_000)) + "</table>"
    tracemalloc.start()
    assert len(html.table_links(page)) == 20_000
    assert tracemalloc.get_traced_memory()[1] < 24e6  # 37 MB as a whole tree
    tracemalloc.stop()
    inner = '<div class="mw-parser-output"><table>' + pair.format(2) + "</table></div>"
    page = '<div class="mw-parser-output"><table>' + pair.format(1) + f"<tr><td>{inner}</td></tr>" + pair.format(3) + "</table></div>"
    assert [r["scenario"] for r in html.quote_rows(page)] == ["E 1", "E 2", "E 3"]


def test_kept_levels(spark):
    """A side of many lengths keeps few levels, and its highest."""
    from duolex.operators import intervals

    d = spark.range(1000).selectExpr("cast(log2(id + 1) as int) as _own")
    got = intervals.kept_levels(d)
    assert len(got) <= 2 and got[-1] == 9 and intervals.kept_levels(d.limit(0)) == []


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("k1\tReporting for duty\t着任しました\nk2\tOne\t一つ\n")
    q = valid_pairs_stream(spark, str(src)).writeStream.format("memory").queryName("pairs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert [r.key for r in spark.sql("select * from pairs").collect()] == ["k1"]


def test_remap(spark):
    d = lines(spark, [("a", "en", "x", "Guard01", 0), ("a", "ja", "y", "Guard01", 0)])
    got = corpus.remap_speakers(d, spark.createDataFrame([("en", "Guard01", "Guard")], "language string, name string, new_name string"))
    assert {r.language: r.speaker for r in got.collect()} == {"en": "Guard", "ja": "Guard01"}


def test_dialogue_reason(spark):
    rows = [("(sigh)", "（ため息）", ["a"], ["a"]), ("Go now", "行け", ["a"], ["b"]), ("Go", "行け", ["a"], ["a"]), ("Go now", "行け", ["a"], ["a"]), ("", "行け", ["a"], ["a"])]
    d = spark.createDataFrame(rows, "en string, ja string, x array<string>, y array<string>")
    got = [r[0] for r in d.select(corpus.dialogue_reason(F.col("en"), F.col("ja"), F.col("x"), F.col("y"))).collect()]
    assert got == ["in parentheses", "no voice", "one word", None, "blank"]


def test_journal(spark):
    o = "array<struct<en:string,ja:string>>"
    rows = [([("a", "あ"), ("b", "い")], "main"), ([("a", "あ"), ("b", "い")], "misc"), ([("a", None)], "main"), ([("<a>", "あ")], "main"), ([], "main")]
    got = [r[0] for r in spark.createDataFrame(rows, f"o {o}, k string").select(rules.journal_entry(F.col("o"), F.col("k"))).collect()]
    assert [g and g.en for g in got] == ["b", "a", None, None, None]


def test_with_texts(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, text string")
    ln = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "text_id string")
    got = readers.with_texts(ln, t([("1", "a"), ("2", "b [x]"), ("3", "c")]), t([("1", "あ"), ("2", "い"), ("4", "う")]))
    assert {r.text_id: r.reason for r in got.collect()} == {"1": None, "2": "interpolated", "3": "no japanese", "4": "no english"}


def test_small_text_functions(spark):
    from duolex.functions import text as T

    d = spark.createDataFrame([("", "en", " *(x)* ", "b"), ("Ann", "ja", "y", "A")], "n string, l string, s string, t string")
    got = d.select(T.speaker_or_placeholder(F.col("n"), F.col("l")).alias("n"), T.stage_trim(F.col("s")).alias("s"), T.blank_to_null(F.col("n")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Unknown", "x", None), ("Ann", "y", "Ann")]
    assert [r.t for r in d.orderBy(T.title_order(F.col("t"))).collect()] == ["A", "b"]


def test_intervals_by_all_pairs(spark):
    """Intervals of all lengths, empty ones, negative places, null keys and ends; one key has a third of the rows."""
    import random

    from duolex.operators import intervals

    rnd = random.Random(5)

    def made(n):
        out = []
        for i in range(n):
            s = rnd.randrange(-200, 3000)
            out.append((i, None if i % 50 == 7 else 0 if i % 3 == 0 else rnd.randrange(5), s, None if i % 60 == 11 else s + rnd.choice([0, 1, 2, 3, 8, 9, 50, 700, 5000])))
        return [*out, out[3]]

    a, b = made(200), made(150)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and x[3] is not None and y[3] is not None and x[3] > y[2] and x[2] < y[3])
    left = spark.createDataFrame(a, "i int, k int, start long, end long")
    right = spark.createDataFrame(b, "j int, k int, start_r long, end_r long")
    got = intervals.overlapping(left, right, ["k"])
    assert sorted((r.i, r.j) for r in got.collect()) == want and set(got.columns) == {"i", "j", "k", "start", "end", "start_r", "end_r"}
    assert intervals.overlapping(left.limit(0), right, ["k"]).collect() == []
