"""Rule and graph resolvers: chains, OR-groups over conditions, candidates, choice of a speaker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.search import uniform
from ..session import cut, partitions

#: Candidates of a task.
EACH = 500_000


def follow_chain(nodes: DataFrame, key: str, parent: str, values: list[str], depth: int | None = None) -> DataFrame:
    """Each node with the first non-null of each value along its chain of parents, itself first.

    Pointers jump: a round joins the nodes that still lack a value with what their pointer's node knows and where that points,
    so what is known of a chain doubles, and a chain of n nodes takes log2(n) joins. Only nodes that others point to take part;
    what is settled is kept once and not written again. The others take their parent's values at the end. A chain is followed
    to its end, or for `depth` nodes at least. A node knows the smallest key between itself and its pointer: if its pointer's
    node has the same one, the chain came to a node again and all of it is known, so a cycle ends with its length's log2.
    A parent that is no node ends a chain.
    """
    lacks = reduce(Column.__or__, [F.col(v).isNull() for v in values]) & F.col(parent).isNotNull()

    def jumped(rows: DataFrame, known: DataFrame) -> DataFrame:
        up = known.select(F.col(key).alias("_k"), F.col(parent).alias("_p"), F.col("_least").alias("_l"), *[F.col(v).alias(f"_{v}") for v in values])
        to = F.when(F.col("_least") == F.col("_l"), None).otherwise(F.col("_p")).alias(parent)
        return rows.join(up, F.col(parent) == F.col("_k"), "left").select(key, to, F.least("_least", "_l").alias("_least"), *[F.coalesce(v, f"_{v}").alias(v) for v in values])

    up = F.when(~F.col(parent).eqNullSafe(F.col(key)), F.col(parent))
    every = cut(nodes.select(key, up.alias(parent), up.alias("_least"), *values))
    named = every.filter(lacks).select(F.col(parent).alias("_to")).distinct()
    part = cut(every.join(named, F.col(key) == F.col("_to"), "left_semi"))
    moving, known = part.filter(lacks), [part.filter(~lacks)]
    for _ in range(((depth or part.count()) - 1).bit_length()):
        if moving.isEmpty():
            break
        part = cut(jumped(moving, reduce(DataFrame.unionByName, known, moving)))
        moving, known = part.filter(lacks), [*known, part.filter(~lacks)]
    ends = jumped(every.filter(lacks), reduce(DataFrame.unionByName, known, moving))
    return ends.unionByName(every.filter(~lacks)).select(key, *values)


def levelled_nodes(nodes: DataFrame, entries: DataFrame, key: str, parent: str, values: list[str], level: str = "level", item: str = "item", order: str | None = None) -> DataFrame:
    """nodes together with the levelled lists of entries (key, level, item), each a node without values whose parent is its lowest entry.

    A chain that leads to a list goes on with the entry of the lowest level, of equal ones the first; entries without a level
    don't count.
    """
    lists = lowest_entry(entries.filter(F.col(level).isNotNull()), key, level, item, order).withColumnRenamed(item, parent)
    return nodes.select(key, parent, *values).unionByName(lists.select(key, parent, *[F.lit(None).cast(dict(nodes.dtypes)[v]).alias(v) for v in values]))


def display_names(objects: DataFrame, prefix: str, player, key: str = "id", template: str = "template", name: str = "name", display: str = "display") -> DataFrame:  # noqa: ANN001
    """(key, display) of game objects: the player's text for one whose name has the prefix, else its own, else its template's."""
    own = F.when(F.coalesce(F.col(name).startswith(prefix), F.lit(False)), F.lit(player)).otherwise(F.col(display))
    return follow_chain(objects.select(key, template, own.alias(display)), key, template, [display])


def chain_end(links: DataFrame, key: str, to: str, depth: int = 32) -> DataFrame:
    """(key, end): where the links from each key lead; a cycle ends at its last new node, a longer chain after `depth` links.

    Only walks that still move are joined again; their number falls with each round.
    """
    hop = links.select(F.col(key).alias("_k"), F.col(to).alias("_to")).filter("_to is not null")
    walk = links.select(F.col(key).alias("_s"), F.col(key).alias("_at"), F.array(key).alias("_seen"))
    done = None
    for _ in range(depth):
        step = cut(walk.join(hop, walk["_at"] == hop["_k"], "left").select("_s", "_at", "_seen", F.when(~F.array_contains("_seen", F.col("_to")), F.col("_to")).alias("_to")))
        part = step.filter("_to is null").select("_s", "_at")
        done = part if done is None else done.unionByName(part)
        walk = step.filter("_to is not null").select("_s", F.col("_to").alias("_at"), F.array_append("_seen", F.col("_to")).alias("_seen"))
        if walk.isEmpty():
            break
    return done.unionByName(walk.select("_s", "_at")).select(F.col("_s").alias(key), F.col("_at").alias("end"))


def lowest_entry(entries: DataFrame, list_key: str, level: str, item: str, order: str | None = None) -> DataFrame:
    """The lowest-level entry of each levelled list; of equal levels the first in an order, that of the item unless given."""
    return entries.groupBy(list_key).agg(F.min_by(item, F.struct(level, *([order] if order else []), item)).alias(item))


def negated(op: Column, value: Column) -> Column:
    """Whether a comparison of a truth value asks for false; every other operator than these four does."""
    return (
        F.when(op == "=", value != 1)
        .when(op == "<>", value != 0)
        .when(op == ">", (value >= 1) | (value < 0))
        .when(op == ">=", (value > 1) | (value <= 0))
        .otherwise(True)
    )


def or_groups(conditions: DataFrame, topic: str = "topic") -> DataFrame:
    """conditions (topic, set, ord, or_flag, ...) with grp: a group ends after a condition without the OR flag and at the end of its set."""
    w = Window.partitionBy(topic).orderBy("set", "ord")
    ends = ~F.col("or_flag") | (F.coalesce(F.lead("set").over(w), F.lit(-1)) != F.col("set"))
    return conditions.withColumn("_end", ends.cast("int")).withColumn("grp", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_end")


def evaluate(conditions: DataFrame, members: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(topic, npc) of the candidates that satisfy the conditions.

    conditions: topic, grp, cond, negated, producer (whether it can seed candidates), ignored. members: cond, npc, the
    candidates that match a condition before negation. Where `initial` (topic, npc) has none for a topic, the first group of
    producers only, or else the first with any, seeds it. Groups with an ignored condition are dropped; the others must
    each hold for a candidate, by any of their conditions.

    A topic's groups are one row, and so are the conditions that an NPC matches: a candidate meets both once and is judged
    within its row. Candidates are counted before they are made, so a task holds a number of them however many there are.
    """
    use = F.collect_set(F.when(F.col("negated").isNotNull(), F.struct("cond", "negated"))).alias("use")
    groups = conditions.groupBy("topic", "grp").agg(F.bool_and("producer").alias("all_p"), F.bool_or("producer").alias("any_p"), F.bool_or("ignored").alias("drop"), use, F.collect_set(F.when(F.col("producer"), F.col("cond"))).alias("seeds"))
    seeds = F.min_by("seeds", F.when(F.col("any_p"), F.struct(~F.col("all_p"), F.col("grp")))).alias("seeds")
    kept = F.collect_list(F.when(~F.col("drop") & (F.size("use") > 0), F.col("use"))).alias("groups")
    topics = cut(groups.groupBy("topic").agg(seeds, kept))
    members = members.filter("cond is not null").select("cond", "npc").distinct()
    matched = members.groupBy("npc").agg(F.collect_set("cond").alias("conds"))
    seeded = topics if initial is None else topics.join(initial.select("topic").distinct(), "topic", "left_anti")
    seeded = seeded.select("topic", F.explode("seeds").alias("cond"))
    sizes = seeded.groupBy("cond").agg(F.count("*").alias("a")).join(members.groupBy("cond").agg(F.count("*").alias("b")), "cond")
    n = partitions(seeded, EACH, sizes.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0])
    candidates = seeded.join(members.join(matched, "npc"), "cond").select("topic", "npc", "conds")
    if initial is not None:
        candidates = candidates.unionByName(initial.select("topic", "npc").join(matched, "npc", "left"))
    is_one = lambda c: F.coalesce(F.array_contains("conds", c["cond"]), F.lit(False)) != c["negated"]
    judged = candidates.repartition(n, "topic").distinct().join(topics.select("topic", "groups"), "topic", "left")
    return judged.filter(F.forall(F.coalesce("groups", F.array().cast(dict(topics.dtypes)["groups"])), lambda g: F.exists(g, is_one))).select("topic", "npc")


def faction_members(npcs: DataFrame, extra: DataFrame, negated_rank: bool = False) -> DataFrame:
    """(faction, npc): exploded memberships and extra members; under negation members of rank -1 don't count and extras don't either."""
    own = npcs.select(F.col("npc"), F.inline("factions"))
    own = (own.filter("rank <> -1") if negated_rank else own).select("faction", "npc")
    return (own if negated_rank else own.unionByName(extra.select("faction", "npc"))).distinct()


def unique_voices(npcs: DataFrame) -> DataFrame:
    """NPCs whose voice type belongs to one name only."""
    only = npcs.groupBy("voice").agg(F.count_distinct("name").alias("names")).filter("names = 1").select("voice")
    return npcs.join(only, "voice", "left_semi")


def valid_speakers(npcs: DataFrame, responses: DataFrame, voices: DataFrame) -> DataFrame:
    """npcs (npc, name_en, name_ja, voice) who have both names and a voice file for all responses (form, response) of a form in both archives.

    voices: archive, form, response, voice. Returns (form, npc)."""
    need = responses.groupBy("form").agg((2 * F.count_distinct("response")).alias("need"))
    have = voices.join(responses, ["form", "response"], "left_semi").groupBy("form", F.lower("voice").alias("v")).agg(F.count_distinct("archive", "response").alias("have"))
    full = have.join(need, "form").filter("have = need").select("form", "v")
    good = npcs.filter("name_en is not null and name_ja is not null and voice is not null").withColumn("v", F.lower("voice"))
    return good.join(full, "v").select("form", "npc")


def winning(records: DataFrame, key: str = "form_key", priority: str = "priority") -> DataFrame:
    """The record of the highest priority (lowest number) of each key, with the union of the children of all its overrides.

    Children are told apart as rows before any are gathered, so a key's row holds each child once, however many overrides repeat it.
    """
    rest = [c for c in records.columns if c not in (key, priority, "children")]
    best = records.groupBy(key).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), priority).alias("_r")).select(key, *[f"_r.{c}" for c in rest])
    one = winning_children(records, key).groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    return best.join(one, best[key].eqNullSafe(one["_k"]), "left").drop("_k").withColumn("children", F.coalesce("children", F.array()))


def winning_children(records: DataFrame, key: str = "form_key") -> DataFrame:
    """(key, child): the distinct children of all overrides of a key, a row each."""
    return records.select(key, F.explode("children").alias("child")).distinct()


def current_infos(infos: DataFrame, order: DataFrame) -> DataFrame:
    """infos (info, plugin, topic_plugin) not older than their topic: order (plugin, ord) is the load order."""
    a, b = order.select(F.col("plugin"), F.col("ord").alias("_a")), order.select(F.col("plugin").alias("topic_plugin"), F.col("ord").alias("_b"))
    return infos.join(a, "plugin").join(b, "topic_plugin").filter("_a >= _b").select(*infos.columns)


def seeded_pick(rows: DataFrame, by: str, pick: str, seed: str = "42") -> DataFrame:
    """One row of the distinct picks of each group, each as likely as the others, by a seeded hash of the group and the pick."""
    key = uniform(seed, F.concat_ws("|", F.col(by).cast("string"), F.col(pick).cast("string")))
    return rows.select(by, pick).distinct().groupBy(by).agg(F.min_by(pick, F.struct(key, F.col(pick))).alias(pick))


def choose_speakers(candidates: DataFrame, names: DataFrame, voices: DataFrame, seed: str = "42") -> DataFrame:
    """One speaker for each topic of candidates (topic, npc, name, voice, is_unique, factions).

    names (faction, wanted): override by name or, with a colon, by key. voices (faction, voice): override by voice type. Both
    together intersect unless one is empty. Without an override by name, topics of which over half are generic keep the
    most frequent name. Of distinct (name, voice) one is picked by a seeded hash.
    """
    flat = candidates.select("topic", "npc", "name", "voice", F.explode_outer("factions").alias("faction"))
    topics = flat.select("topic", "faction").distinct()
    wanted = topics.join(names, "faction").select("topic", "wanted").distinct()
    by_name = candidates.join(wanted, "topic").filter(F.when(F.col("wanted").contains(":"), F.col("wanted") == F.col("npc")).otherwise(F.col("wanted") == F.col("name"))).select("topic", "npc").distinct()
    by_voice = candidates.join(topics.join(voices, "faction").select("topic", F.lower("voice").alias("_v")).distinct(), "topic").filter(F.lower("voice") == F.col("_v")).select("topic", "npc").distinct()
    marked = candidates.join(by_name.withColumn("_n", F.lit(1)), ["topic", "npc"], "left").join(by_voice.withColumn("_v", F.lit(1)), ["topic", "npc"], "left")
    state = marked.groupBy("topic").agg(F.max("_n").alias("any_n"), F.max("_v").alias("any_v"), F.max(F.col("_n") * F.col("_v")).alias("any_both"))
    j = marked.join(state, "topic")
    over = F.when(F.col("any_v").isNull(), F.col("_n")).when(F.col("any_n").isNull(), F.col("_v")).otherwise(F.col("_n") * F.col("_v"))
    any_over = F.when(F.col("any_v").isNull(), F.col("any_n")).when(F.col("any_n").isNull(), F.col("any_v")).otherwise(F.col("any_both"))
    left = j.filter(any_over.isNull() | (over == 1))
    generic = left.groupBy("topic").agg((1 - F.avg(F.col("is_unique").cast("double"))).alias("share"), F.max("any_n").alias("named"))
    top = left.groupBy("topic", "name").count().groupBy("topic").agg(F.min_by("name", F.struct(-F.col("count"), F.col("name"))).alias("top"))
    kept = left.select("topic", "npc", "name", "voice").join(generic, "topic").join(top, "topic").filter(F.col("named").isNotNull() | (F.col("share") <= 0.5) | (F.col("name") == F.col("top")))
    one = kept.groupBy("topic", "name", "voice").agg(F.min("npc").alias("npc"))
    key = uniform(seed, F.concat_ws("|", F.col("topic").cast("string"), F.col("npc").cast("string")))
    return one.groupBy("topic").agg(F.min_by(F.struct("npc", "name", "voice"), F.struct(key, F.col("npc"))).alias("s")).select("topic", "s.*")


def choose_voices(lines: DataFrame, available: DataFrame, seed: str = "42") -> DataFrame:
    """lines (info, response, voice) and available (info, response, voice): the line's own voice where it is there, else a
    seeded pick for the info among those it has for the response."""
    own = lines.join(available.withColumn("_has", F.lit(True)), ["info", "response", "voice"], "left")
    key = uniform(seed, F.concat_ws("|", F.col("info").cast("string"), F.col("voice")))
    other = available.groupBy("info", "response").agg(F.min_by("voice", F.struct(key, F.col("voice"))).alias("_o"))
    return own.join(other, ["info", "response"], "left").select("info", "response", F.when(F.col("_has"), F.col("voice")).otherwise(F.col("_o")).alias("voice"))


def with_fallback(resolved: DataFrame, declared: DataFrame, key: str = "topic", value: str = "npc") -> DataFrame:
    """declared (key, value) where resolving found nothing."""
    return declared.select(key, F.col(value).alias("_d")).join(resolved.select(key, value), key, "full_outer").select(key, F.coalesce(value, "_d").alias(value))


def scene_speakers(topics: DataFrame, actions: DataFrame, aliases: DataFrame) -> DataFrame:
    """topics (topic) through actions (topic, scene, alias) and aliases (scene, alias, npc) to (topic, npc); a topic in two actions fails."""
    n = actions.groupBy("topic").agg(F.count("*").alias("_n"), F.first("scene").alias("scene"), F.first("alias").alias("alias"))
    one = n.withColumn("_e", F.assert_true(F.col("_n") == 1, "a topic in two actions")).filter(F.col("_e").isNull()).drop("_e", "_n")
    return topics.join(one, "topic").join(aliases, ["scene", "alias"]).select("topic", "npc")


def resolve_aliases(aliases: DataFrame, external: DataFrame, depth: int | None = None) -> DataFrame:
    """(quest, alias) to npc by the first strategy that gives any: created, forced, unique, conditions (columns of arrays), then
    the alias of another quest (external: quest, alias, to_quest, to_alias). A cycle gives none."""
    arrays = [F.when(F.size(c) > 0, F.col(c)) for c in ("created", "forced", "unique", "conditions")]
    own = aliases.select(F.concat_ws("#", "quest", "alias").alias("k"), F.coalesce(*arrays).alias("npcs"))
    links = external.select(F.concat_ws("#", "quest", "alias").alias("k"), F.concat_ws("#", "to_quest", "to_alias").alias("p"))
    found = follow_chain(own.join(links, "k", "left"), "k", "p", ["npcs"], depth)
    return found.select(F.split("k", "#")[0].alias("quest"), F.split("k", "#")[1].alias("alias"), F.explode("npcs").alias("npc"))


def journal_entry(objectives: Column, kind: Column) -> Column:
    """The text of the first objective of a miscellaneous quest, else of the last; null if none has both texts, or it is blank or markup."""
    both = F.filter(objectives, lambda o: o["en"].isNotNull() & o["ja"].isNotNull())
    at = F.when(kind == "misc", F.get(both, F.lit(0))).otherwise(F.get(both, F.size(both) - 1))
    return F.when((F.trim(at["en"]) != "") & ~at["en"].contains("<") & ~at["ja"].contains("<"), at)
