"""Readers of dialogue files. Each gives lines (key, language, text, speaker, audio_path, file_ordinal, line_ordinal ...)."""

from __future__ import annotations

import re
from fnmatch import translate as glob_pattern

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def pick_files(listing: DataFrame, include: list[str], path: str = "path") -> DataFrame:
    """Rows of a listing whose path matches a glob, case-insensitively, and none of those that begin with an exclamation mark."""
    match = lambda g: F.lower(path).rlike("^" + glob_pattern(g.lower()).removesuffix(r"\z").removesuffix(r"\Z") + "$")
    yes, no = F.lit(False), F.lit(False)
    for g in include:
        if g.startswith("!"):
            no = no | match(g[1:])
        else:
            yes = yes | match(g)
    return listing.filter(yes & ~no)


def relative_file(spark: SparkSession, path: str) -> Column:
    """The path of a read file below the folder that was asked for (up to the first wildcard); a single file's own name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(re.split(r"[*?\[{]", path)[0])
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = store.makeQualified(at).toUri().getPath()
    if re.search(r"[*?\[{]", path):
        root = root if re.split(r"[*?\[{]", path)[0].endswith("/") else root.rpartition("/")[0]
    elif store.exists(at) and store.getFileStatus(at).isFile():
        root = root.rpartition("/")[0]
    whole = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:(//[^/]*)?", "")
    return F.substring(whole, F.lit(len(root.rstrip("/")) + 2), F.length(whole))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in order: file (below the folder, so files of one name stay apart), line_ordinal, line.

    A file is read whole, so its order doesn't depend on splits.
    """
    whole = spark.read.text(path, wholetext=True).withColumn("file", relative_file(spark, path))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_ordinal", "line"))


def tsv(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Lines by tab into the configured columns (IntKey, StringKey, Language, Text, AudioFilePath, SpeakerName, Context, Notes).

    There is no header and no quoting. Columns that aren't configured get their default; a line with too few parts, or a
    language that isn't known, is an error that names the line.
    """
    part = {c: F.get(F.col("_p"), F.lit(i)) for i, c in enumerate(columns)}
    rows = lines.filter(F.col("line") != "").withColumn("_p", F.split("line", "\t", -1))
    language = F.lower(part["Language"]) if "Language" in part else F.lit("multilingual")
    short = F.concat(F.lit("too few columns in line "), (F.col("line_ordinal") + 1).cast("string"))
    unknown = F.concat(F.lit("unknown language in line "), (F.col("line_ordinal") + 1).cast("string"))
    get = lambda c, d=None: part[c] if c in part else F.lit(d).cast("string")
    checked = F.when(F.size("_p") < len(columns), F.raise_error(short)).when(~language.isin("english", "japanese", "en", "ja", "multilingual"), F.raise_error(unknown)).otherwise(F.substring(language, 1, 2))
    return rows.select("file", "line_ordinal", checked.alias("language"), get("IntKey").try_cast("bigint").alias("key_int"), get("StringKey").alias("key_str"), F.coalesce(get("Text"), F.lit("")).alias("text"), get("AudioFilePath").alias("audio_path"), F.coalesce(get("SpeakerName"), F.lit("")).alias("speaker"), F.coalesce(get("Context"), F.lit("")).alias("context"), F.coalesce(get("Notes"), F.lit("")).alias("notes"))


def ks(lines: DataFrame, separators: tuple[str, ...] = ("np", "r", "l"), stops: tuple[str, ...] = (), voiced_only: bool = False, unify: tuple[str, str] | None = ("page", "p"), default_speakers: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Dialogue of script files: code blocks, blank, command and comment lines are skipped, labels begin with a star.

    The text of a label is cut at separator tags; the pieces are numbered by label over the file, repeats of a label going on
    counting. Two name tags in a piece are an error. default_speakers: (prefix of the sound, name) where there is no name.
    """
    line = F.regexp_replace("line", r"^\t+", "")
    file_order = Window.partitionBy("file").orderBy("line_ordinal")
    rows = lines.withColumn("line", line)
    opens, closes = F.col("line").isin("@iscript", "[iscript]"), F.col("line").isin("@endscript", "[endscript]")
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(file_order)
    rows = rows.withColumn("_code", F.coalesce(state, F.lit(False)) | closes)
    rows = rows.filter(~F.col("_code") & (F.col("line") != "") & ~F.col("line").rlike("^[@;]"))
    label = F.when(F.col("line").startswith("*"), F.split("line", r"\|")[0])
    if unify:
        label = F.replace(label, F.lit(unify[0]), F.lit(unify[1]))
    rows = rows.withColumn("_is", F.col("line").startswith("*")).withColumn("label", F.coalesce(F.last(label, ignorenulls=True).over(file_order), F.lit("")))
    rows = rows.withColumn("_block", F.sum(F.col("_is").cast("int")).over(file_order))
    block = rows.filter(~F.col("_is")).groupBy("file", "label", "_block").agg(F.min("line_ordinal").alias("line_ordinal"), F.array_sort(F.collect_list(F.struct("line_ordinal", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    sep = r"(?i)(?<!\[)\[\s*(?:" + "|".join(map(re.escape, separators)) + r")\s*\]"
    pieces = block.select("file", "label", "_block", "line_ordinal", F.posexplode(F.split(body, sep, -1)).alias("_n", "piece")).filter(T.trim_unicode(F.col("piece")) != "")
    audio, speaker = T.ks_attribute(F.col("piece"), "s"), T.ks_attribute(F.col("piece"), "t")
    for prefix, name in default_speakers:
        speaker = F.coalesce(speaker, F.when(audio.startswith(prefix), F.lit(name)))
    pieces = pieces.withColumns({"audio_path": audio, "speaker": F.coalesce(speaker, F.lit(""))})
    if voiced_only:
        pieces = pieces.filter("audio_path is not null")
    number = F.row_number().over(Window.partitionBy("file", "label").orderBy("_block", "_n")) - 1
    text = F.regexp_replace("piece", r"(?is)(?<!\[)\[\s*(?:" + "|".join(map(re.escape, stops)) + r")\s*\].*", "") if stops else F.col("piece")
    return pieces.select("file", F.concat("file", "label", F.lit("["), number.cast("string"), F.lit("]")).alias("key"), T.ks_plain(text).alias("text"), "speaker", "audio_path", "line_ordinal")


SCN = "scenes array<struct<label:string,title:string,texts:array<string>>>"


def _as_text(v: Column) -> Column:
    return F.when(v.isNotNull(), v)


def scn(docs: DataFrame, english: int = 1, japanese: int = 0, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Two lines, English and Japanese, for each voiced text of scene files (file, value: JSON).

    A text is a positional array: name, display name, translations [[name, text] ...], voices. Scenes that are excluded
    and texts with several voices are skipped; numbering within a scene counts the texts that stay.
    """
    scenes = docs.select("file", F.posexplode(F.from_json("value", SCN)["scenes"]).alias("_s", "scene")).filter(~F.col("scene.label").isin(*excluded) if excluded else F.lit(True))
    titles = F.from_json(F.col("scene.title"), "array<string>")
    texts = scenes.select("file", "_s", F.col("scene.label").alias("label"), F.coalesce(titles, F.array(F.coalesce("scene.title", F.lit("")), F.coalesce("scene.title", F.lit("")))).alias("titles"), F.posexplode("scene.texts").alias("_t", "raw"))
    cell = F.from_json("raw", "array<string>")
    texts = texts.withColumn("c", cell).withColumns({"name": F.col("c")[0], "tl": F.from_json(F.col("c")[2], "array<array<string>>"), "voices": F.coalesce(F.from_json(F.col("c")[3], "array<struct<voice:string>>"), F.array().cast("array<struct<voice:string>>"))})
    one = texts.filter(F.size("voices") <= 1).withColumn("n", F.row_number().over(Window.partitionBy("file", "_s").orderBy("_t")) - 1)
    side = lambda lang, i: F.struct(F.lit(lang).alias("language"), F.coalesce(F.get(F.get("tl", F.lit(i)), F.lit(0)), "name", F.lit("")).alias("speaker"), F.get(F.get("tl", F.lit(i)), F.lit(1)).alias("raw_text"), F.get("titles", F.lit(i)).alias("title"))
    rows = one.select("file", "_s", "_t", F.concat("label", F.lit("["), F.col("n").cast("string"), F.lit("]")).alias("key"), F.get("voices", F.lit(0))["voice"].alias("audio_path"), F.explode(F.array(side("en", english), side("ja", japanese))).alias("r"))
    return rows.select("file", "key", "r.language", T.scn_plain(F.col("r.raw_text"), F.col("key")).alias("text"), "r.speaker", T.scene_title(F.col("r.title"), F.col("r.language")).alias("context"), "audio_path", (F.col("_s") * 1000000 + F.col("_t")).cast("int").alias("line_ordinal"))


def cst(commands: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Voiced dialogue of instruction lists (file, ord, kind sound/name/message/input/page, value).

    Input and page end a dialogue; several sounds, none, or no message drop it. A message that nothing ends is an error.
    """
    w = Window.partitionBy("file").orderBy("ord")
    ends = F.col("kind").isin("input", "page")
    rows = commands.withColumn("_end", ends.cast("int")).withColumn("grp", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "value")))), lambda x: x["value"])
    made = rows.groupBy("file", "grp").agg(pick("sound").alias("sounds"), pick("message").alias("messages"), pick("name").alias("names"), F.max("_end").alias("ended"), F.min("ord").alias("line_ordinal"))
    bad = (F.col("ended") == 0) & (F.size("messages") > 0)
    made = made.withColumn("_e", F.assert_true(~bad, "a dialogue that nothing ends")).filter(F.col("_e").isNull())
    names = F.filter("names", lambda n: n != "")
    good = made.filter((F.size("sounds") == 1) & (F.size("messages") > 0))
    good = good.filter(~F.col("sounds")[0].isin(*excluded)) if excluded else good
    return good.select("file", F.col("sounds")[0].alias("key"), F.array_join("messages", "").alias("text"), F.coalesce(T.name_before_mark(F.get(names, F.size(names) - 1)), F.lit("")).alias("speaker"), F.col("sounds")[0].alias("audio_path"), "line_ordinal")


LSJ = "save struct<regions:struct<Templates:struct<GameObjects:array<struct<MapKey:struct<value:string>,DisplayName:struct<handle:string>,TemplateName:struct<value:string>,Name:struct<value:string>>>>,Origins:struct<Origin:array<struct<GlobalTemplate:struct<value:string>,DisplayName:struct<handle:string>,Name:struct<value:string>>>>,VoiceMetaData:struct<VoiceSpeakerMetaData:array<struct<MapKey:struct<value:string>,MapValue:array<struct<VoiceTextMetaData:array<struct<MapKey:struct<value:string>,MapValue:array<struct<Source:struct<value:string>>>>>>>>>>>>"


def lsj(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LSJ).json(path, multiLine=True)


def lsj_objects(files: DataFrame) -> DataFrame:
    """(guid, display, template, name): game objects with a key and a name or template, and origins, merged by first value."""
    t, o = "save.regions.Templates.GameObjects", "save.regions.Origins.Origin"
    a = files.select(F.posexplode(t).alias("ord", "g")).select(F.lower("g.MapKey.value").alias("guid"), F.col("g.DisplayName.handle").alias("display"), F.lower("g.TemplateName.value").alias("template"), F.col("g.Name.value").alias("name"), "ord").filter("guid is not null and (display is not null or template is not null or name is not null)")
    b = files.select(F.posexplode(o).alias("ord", "g")).select(F.lower("g.GlobalTemplate.value").alias("guid"), F.col("g.DisplayName.handle").alias("display"), F.lit(None).cast("string").alias("template"), F.col("g.Name.value").alias("name"), (F.col("ord") + (1 << 20)).alias("ord")).filter("guid is not null")
    return coalesced(a.unionByName(b), "guid", ["display", "template", "name"], "ord")


def coalesced(rows: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """The first non-null of each value by order, for each key."""
    return rows.groupBy(key).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def lsj_lines(files: DataFrame) -> DataFrame:
    """(speaker_guid, text_id, audio): voice metadata, flattened."""
    s = files.select(F.explode("save.regions.VoiceMetaData.VoiceSpeakerMetaData").alias("s")).select(F.lower("s.MapKey.value").alias("speaker_guid"), F.explode("s.MapValue").alias("v"))
    t = s.select("speaker_guid", F.explode("v.VoiceTextMetaData").alias("t")).select("speaker_guid", F.col("t.MapKey.value").alias("text_id"), F.explode("t.MapValue").alias("f"))
    return t.select("speaker_guid", "text_id", F.col("f.Source.value").alias("audio"))


def localized(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of content lists; an id that comes twice is an error."""
    rows = spark.read.format("xml").option("rowTag", "content").schema("_contentuid string, _VALUE string").load(path).select(F.col("_contentuid").alias("id"), F.coalesce("_VALUE", F.lit("")).alias("text"))
    return rows.groupBy("id").agg(F.count("*").alias("_n"), F.first("text").alias("text")).withColumn("_e", F.assert_true(F.col("_n") == 1, "an id twice")).filter(F.col("_e").isNull()).select("id", "text")


def with_texts(lines: DataFrame, en: DataFrame, ja: DataFrame) -> DataFrame:
    """lines (text_id, ...) with both texts and the reason why one can't be used: missing in a language, or interpolated."""
    j = lines.join(en.select(F.col("id").alias("text_id"), F.col("text").alias("en")), "text_id", "left").join(ja.select(F.col("id").alias("text_id"), F.col("text").alias("ja")), "text_id", "left")
    return j.withColumn("reason", F.when(F.col("en").isNull(), "no english").when(F.col("ja").isNull(), "no japanese").when(F.col("en").contains("[") | F.col("ja").contains("["), "interpolated"))


# Fixed value: places of voice files in an archive: mod, voice type, form and response number.
VOICE_FILE = r"(?i)^sound[\\/]voice[\\/]([^\\/]+)[\\/]([^\\/]+)[\\/].*_([0-9a-f]{8})_(\d+)\.fuz$"


def voice_files(listing: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(mod, voice, form, response, path) of an archive's listing (path, ord): the first file of each; an exclusion that matches nothing is an error."""
    part = lambda i: F.regexp_extract("path", VOICE_FILE, i)
    norm = lambda c: F.lower(F.translate(c, "\\", "/"))
    if excluded:
        hit = listing.filter(norm(F.col("path")).isin(*[e.lower().replace("\\", "/") for e in excluded])).select(F.count_distinct(norm(F.col("path")))).first()[0]
        if hit != len({e.lower().replace("\\", "/") for e in excluded}):
            raise ValueError("an excluded voice file isn't in the archive")
        listing = listing.filter(~norm(F.col("path")).isin(*[e.lower().replace("\\", "/") for e in excluded]))
    rows = listing.filter(F.col("path").rlike(VOICE_FILE)).select(part(1).alias("mod"), part(2).alias("voice"), F.conv(part(3), 16, 10).cast("bigint").alias("form"), part(4).cast("int").alias("response"), "path", "ord")
    return rows.groupBy("form", "response", F.lower("voice").alias("_v")).agg(F.min_by(F.struct("mod", "voice", "path"), "ord").alias("r")).select("form", "response", "r.*")
