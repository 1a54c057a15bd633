"""Which exports are the same conversation.

Edges come from three rules: the same title, the same two people, or enough
common messages together with a close title or the same people.  The first two
are star edges to the smallest export of a key.  The third is found through the
messages themselves, never by comparing all exports:

* a pair must share a message that is among the rarer ones of its smaller
  export (if 15 % of a set is shared, a common element cannot be missing from the
  85 % rarest ones), so very common messages propose no pairs for larger exports;
* the exports that share a message are put in lines of equal people and of equal
  titles, and only those in one line are tried: neighbours first, then doubling
  distances, and a line drops out as soon as all its exports are one chat.  Copies and
  overlapping re-exports therefore join after a round of linear size;
* exports with different titles that are nearly the same stand in lines of a message and a rare
  piece of the title, both shared, so neither a template of titles nor a message
  of very many exports puts exports together.

A message that many exports of other people and titles hold, such as a service
notice, brings no pair about.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions import patterns as p
from threadlake.functions import text as X
from threadlake.functions.fuzzy import similarity
from threadlake.operators.components import star_components
from threadlake.operators.dedup import with_keys
from threadlake.operators.ranking import bucketed_index, dense_index
from threadlake.session import materialize

#: Characters of a piece of a title.
GRAM = 3


@dataclass
class Stitched:
    """``unit_chat``: one row per export; ``edges``: what joined them."""

    unit_chat: DataFrame
    edges: DataFrame


def set_fingerprint(member: Column) -> Column:
    """An aggregate that is equal for equal sets of distinct members, null without any.

    The number of members with the sum and the exclusive or of two independent hashes: all three
    are merged before a shuffle, so a set of any size is a few numbers and never
    a list.  Unlike sets agree in all of them once in about 2 ** 124 pairs.
    """
    first_bits = F.conv(F.substring(F.sha2(member, 256), 1, 15), 16, 10).cast("decimal(20, 0)")
    mixed = F.bit_xor(F.when(member.isNotNull(), F.xxhash64(member)))
    parts = [F.count(member), F.sum(first_bits), mixed]
    return F.when(F.count(member) > 0, F.sha1(F.concat_ws(" ", *[x.cast("string") for x in parts]).cast("binary")))


def unit_profiles(units: DataFrame, raw: DataFrame) -> DataFrame:
    """Per export: normal title, caseless people, and whether it looks like a group."""
    notice = (F.col("kind") == "system") & F.col("text").rlike(p.GROUP_HINTS)
    sender = F.nullif(F.col("sender"), F.lit(""))
    per_sender = raw.groupBy("unit_idx", sender.alias("sender")).agg(
        F.max(notice).alias("noticed"), F.count(F.lit(1)).alias("n")
    )
    # One row for each person: spellings that differ in case only are one.
    per_person = per_sender.groupBy("unit_idx", X.casefold(F.col("sender")).alias("person")).agg(
        F.count("sender").alias("spellings"), F.max("noticed").alias("noticed"), F.sum("n").alias("n")
    )
    per_unit = per_person.groupBy("unit_idx").agg(
        set_fingerprint(F.col("person")).alias("_people"),
        F.sum("spellings").alias("n_senders"),
        F.max("noticed").alias("_noticed"),
        F.sum("n").alias("n_messages"),
    )
    people = F.col("_people")
    return (
        units.select("unit_idx", "title")
        .join(per_unit, "unit_idx", "left")
        .select(
            "unit_idx",
            "title",
            X.normalize_title(F.col("title")).alias("norm_title"),
            X.is_placeholder_title(F.col("title")).alias("placeholder"),
            people.alias("people_key"),
            F.coalesce(F.col("n_senders"), F.lit(0)).alias("n_senders"),
            (
                (F.coalesce(F.col("n_senders"), F.lit(0)) > 2)
                | F.coalesce(F.col("_noticed"), F.lit(False))
            ).alias("groupish"),
            F.coalesce(F.col("n_messages"), F.lit(0)).alias("n_messages"),
        )
    )


def _star_edges(members: DataFrame, key: str, reason: str) -> DataFrame:
    """Link every export of a key to the smallest one."""
    hubs = members.groupBy(key).agg(F.min("unit_idx").alias("hub"))
    return (
        members.join(hubs, key)
        .filter(F.col("unit_idx") > F.col("hub"))
        .select("unit_idx", "hub", F.lit(reason).alias("reason"))
    )


def same_title_edges(profiles: DataFrame) -> DataFrame:
    named = profiles.filter(~F.col("placeholder") & (F.col("norm_title") != ""))
    return _star_edges(named.select("unit_idx", "norm_title"), "norm_title", "same title")


def same_people_edges(profiles: DataFrame) -> DataFrame:
    """Two-person chats with equal people, whatever their titles are."""
    direct = profiles.filter(~F.col("groupish") & F.col("people_key").isNotNull())
    return _star_edges(direct.select("unit_idx", "people_key"), "people_key", "same people")


def message_keys(raw: DataFrame) -> DataFrame:
    """Distinct ``(unit_idx, key)``: the set of message identities of each export."""
    keyed = raw if "body_hash" in raw.columns else with_keys(raw)
    identity = F.concat_ws("\x1f", F.col("minute").cast("string"), "body_hash", "who")
    return keyed.select(
        "unit_idx", F.unhex(F.sha1(identity.cast("binary"))).alias("key")
    ).distinct()


def overlap(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Shared identities of ``(a, b)`` pairs as a share of the smaller set."""
    sizes = keys.groupBy("unit_idx").agg(F.count(F.lit(1)).alias("size"))
    shared = shared_keys(pairs, keys)
    return (
        pairs.join(sizes.toDF("a", "size_a"), "a", "left")
        .join(sizes.toDF("b", "size_b"), "b", "left")
        .join(shared, ["a", "b"], "left")
        .select(
            "a",
            "b",
            F.coalesce("shared", F.lit(0)).alias("shared"),
            overlap_ratio(
                F.coalesce("shared", F.lit(0)),
                F.coalesce(F.least("size_a", "size_b"), F.lit(0)),
            ).alias("overlap"),
        )
    )


def overlap_ratio(shared: Column, smaller: Column) -> Column:
    return F.when(smaller == 0, F.lit(0.0)).otherwise(
        shared.cast("double") / smaller.cast("double")
    )


def shared_keys(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    left = pairs.select("a", "b").join(keys.select(F.col("unit_idx").alias("a"), "key"), "a")
    return (
        left.join(keys.select(F.col("unit_idx").alias("b"), "key"), ["b", "key"])
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
    )


def close_titles(pairs: DataFrame, left: str = "title_a", right: str = "title_b") -> DataFrame:
    """Keep the pairs whose titles are nearly the same (earlier export on the left)."""
    return pairs.withColumn("ratio", similarity(left, right)).filter(
        F.col("ratio") > p.CLOSE_TITLE_RATIO
    )


def _differences(length: Column, other: Column) -> Column:
    """Nearly equal titles of these lengths differ by fewer characters, counted in both."""
    return (length + other) * (1 - p.CLOSE_TITLE_RATIO) + 1e-9


def title_grams(titles: DataFrame) -> DataFrame:
    """``norm_title, gram``: the rarer pieces of each title, of which nearly equal ones share one.

    A character that is in only one of two titles spoils at most ``GRAM`` pieces of so many
    characters.  So titles with at most d differences have all but ``GRAM * d`` pieces of
    either in common, and then also one of the first ``GRAM * d + 1``, in any order that is the same
    for all titles: here rare pieces come first.  The n-th equal piece of a title
    is a piece of its own.  Titles too short to be nearly equal to another one have no row.
    """
    r = p.CLOSE_TITLE_RATIO
    n = F.length("norm_title")
    # The other title is at most (2 - r) / r as long.
    most = F.ceil(n * (2 * (1 - r) / r) + 1e-9) - 1
    known = titles.select("norm_title").distinct().filter((most > 0) & (n >= GRAM))
    at = F.sequence(F.lit(1), n - GRAM + 1)
    pieces = F.transform(at, lambda i: F.substring(F.col("norm_title"), i, F.lit(GRAM)))
    nth = lambda x, i: F.size(F.filter(F.slice("pieces", F.lit(1), i + 1), lambda y: y == x))
    named = F.transform("pieces", lambda x, i: F.concat(nth(x, i).cast("string"), F.lit(" "), x))
    spread = (
        known.select("norm_title", most.alias("most"), pieces.alias("pieces"))
        .select("norm_title", "most", F.explode(named).alias("gram"))
    )
    times = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rarity = F.row_number().over(Window.partitionBy("norm_title").orderBy("times", "gram"))
    return (
        spread.join(times, "gram")
        .withColumn("rarity", rarity)
        .filter(F.col("rarity") <= GRAM * F.col("most") + 1)
        .select("norm_title", "gram")
    )


def with_near_titles(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Of the export pairs ``a, b`` (a before b) those with different, nearly equal titles.

    Adds ``title_a, title_b, ratio``.  Lengths and edit distance, bounds that lose nothing, come
    first; the ratio is computed once for two titles.
    """
    title = lambda side: facts.select(F.col("unit_idx").alias(side), F.col("norm_title").alias(f"title_{side}"))
    named = pairs.join(title("a"), "a").join(title("b"), "b")
    na, nb = F.length("title_a"), F.length("title_b")
    most = _differences(na, nb)
    could = named.filter((F.col("title_a") != F.col("title_b")) & (F.abs(na - nb) < most)).filter(
        F.levenshtein("title_a", "title_b") < most
    )
    could = materialize(could, "maybe-near-titles")
    near = close_titles(could.select("title_a", "title_b").distinct())
    return could.join(near, ["title_a", "title_b"])


def close_title_pairs(keys: DataFrame, profiles: DataFrame) -> DataFrame:
    """``a, b, title_a, title_b, ratio`` of exports that share a message and have nearly equal titles.

    One equi-join on a message and a rare piece of the title: neither titles of
    one template nor a message that very many exports hold make pairs by themselves.
    """
    facts = profiles.select("unit_idx", "norm_title")
    grams = materialize(title_grams(facts), "title-grams")
    lines = materialize(keys.join(facts, "unit_idx").join(grams, "norm_title").select("key", "gram", "unit_idx"), "title-lines")
    right = lines.withColumnRenamed("unit_idx", "b")
    met = lines.withColumnRenamed("unit_idx", "a").join(right, ["key", "gram"]).filter("a < b")
    return with_near_titles(met.select("a", "b").distinct(), facts)


def _rarest_first(keys: DataFrame) -> DataFrame:
    """Keys held by several exports, each flagged if it may propose its export.

    Adds the number of keys of the export.
    """
    holders = keys.groupBy("key").agg(F.count(F.lit(1)).alias("holders"))
    sizes = keys.groupBy("unit_idx").agg(F.count(F.lit(1)).alias("size"))
    held = keys.join(holders.filter("holders > 1"), "key")
    n_common = held.groupBy("unit_idx").agg(F.count(F.lit(1)).alias("n_common"))
    # Keys are hashes, so their first bits cut even one very large export evenly.
    first_bits = F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("bigint")
    common = bucketed_index(
        held.join(sizes.join(n_common, "unit_idx"), "unit_idx"),
        ["unit_idx"],
        F.col("holders") * 16 + F.floor(first_bits / 16),
        ["holders", "key"],
        "rarity",
        start=1,
    )
    # Fewest shared keys that can reach the threshold when this export is the
    # smaller one; rounding is to the safe side, the final test is exact.
    needed = F.ceil(F.col("size") * p.OVERLAP_THRESHOLD - 1e-9)
    rank_of_all = F.col("size") - F.col("n_common") + F.col("rarity")
    proposing = rank_of_all <= F.col("size") - F.greatest(needed, F.lit(1)) + 1
    return materialize(
        common.select("key", "unit_idx", "size", proposing.alias("proposes")), "holders"
    )


def _alike(holders: DataFrame, facts: DataFrame) -> DataFrame:
    """Holders of a key with equal people, and those with equal titles, in a line each.

    ``alike`` names the people or the title, ``pos`` is the place in the line.
    Exports that have neither in common are never in one line, so a message that very
    many unrelated exports hold brings none of them together.
    """
    marks = F.array_compact(
        F.array(
            F.when(F.col("people_key").isNotNull(), F.concat(F.lit("people "), "people_key")),
            F.when(F.col("norm_title") != "", F.concat(F.lit("title "), "norm_title")),
        )
    )
    lines = holders.join(facts, "unit_idx").select(
        "key", "unit_idx", "size", "proposes", F.explode(marks).alias("alike")
    )
    return materialize(dense_index(lines, ["key", "alike"], "unit_idx", "pos"), "alike")


def _nearly_alike(holders: DataFrame, facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Lines of the exports that hold a message and have a rare piece of the title in common.

    Only messages count that exports of several chats hold and that may propose one of them.
    """
    known = holders.join(roots, "unit_idx")
    apart = known.groupBy("key").agg(
        F.min("root").alias("r1"), F.max("root").alias("r2"), F.max("proposes").alias("any")
    )
    open_keys = apart.filter(F.col("any") & (F.col("r1") != F.col("r2"))).select("key")
    grams = materialize(title_grams(facts), "title-grams")
    lines = (
        holders.join(open_keys, "key")
        .join(facts.select("unit_idx", "norm_title"), "unit_idx")
        .join(grams, "norm_title")
        .select("key", "unit_idx", "size", "proposes", F.col("gram").alias("alike"))
    )
    return materialize(dense_index(lines, ["key", "alike"], "unit_idx", "pos"), "nearly-alike")


def _pair_columns(right: DataFrame) -> DataFrame:
    return right.select(
        *[F.col(c) for c in right.columns if c not in ("unit_idx", "size", "proposes", "root", "pos")],
        F.col("unit_idx").alias("v"),
        F.col("size").alias("size_v"),
        F.col("proposes").alias("proposes_v"),
        F.col("root").alias("root_v"),
    )


def _proposed(pairs: DataFrame, same_people: Column) -> DataFrame:
    """Distinct pairs of open exports that the rarer keys of the smaller one propose."""
    smaller_proposes = F.when(
        F.struct("size", "unit_idx") < F.struct("size_v", "v"), F.col("proposes")
    ).otherwise(F.col("proposes_v"))
    first = F.col("unit_idx") < F.col("v")

    def ordered(x: str, y: str, low_name: str, high_name: str) -> list[Column]:
        return [
            F.when(first, F.col(x)).otherwise(F.col(y)).alias(low_name),
            F.when(first, F.col(y)).otherwise(F.col(x)).alias(high_name),
        ]

    return (
        pairs.filter(F.col("root") != F.col("root_v"))
        .filter(smaller_proposes)
        .select(
            *ordered("unit_idx", "v", "a", "b"),
            *ordered("root", "root_v", "root_a", "root_b"),
            F.least("size", "size_v").alias("smaller"),
            same_people.alias("same_people"),
        )
        .groupBy("a", "b", "root_a", "root_b", "smaller")
        .agg(F.max("same_people").alias("same_people"))
    )


def _in_line(current: DataFrame, low: int, high: int, same_people: Column) -> DataFrame:
    """Pairs at distances ``low..high-1`` in the lines; ``n`` is a line's length."""
    right = _pair_columns(current.withColumn("at", F.col("pos")).drop("n"))
    steps = F.explode(F.sequence(F.col("pos") + low, F.least(F.col("pos") + high, "n") - 1))
    left = current.filter(F.col("pos") + low < F.col("n")).select("*", steps.alias("at"))
    return _proposed(left.join(right, ["key", "alike", "at"]), same_people)


def _enough_in_common(found: DataFrame, known: DataFrame) -> DataFrame:
    return materialize(
        found.join(shared_keys(found, known), ["a", "b"])
        .filter(overlap_ratio(F.col("shared"), F.col("smaller")) >= p.OVERLAP_THRESHOLD)
        .select("a", "b", "root_a", "root_b", "same_people"),
        "overlap-edges",
    )


def _joined_roots(roots: DataFrame, new: DataFrame) -> DataFrame:
    moved = star_components(new, "root_a", "root_b")
    return materialize(
        roots.join(moved.toDF("root", "to"), "root", "left").select(
            "unit_idx", F.coalesce("to", "root").alias("root")
        ),
        "roots",
    )


def _walk(lines: DataFrame, roots: DataFrame, known: DataFrame, same_people: Column, also=None) -> tuple:
    """Try the exports of each line, neighbours first and then doubling distances.

    A line drops out once its exports are one chat or none of them may propose.  ``also``
    filters proposed pairs.  Returns the new roots and the edges found.
    """
    edges, low = [], 1
    while True:
        current = lines.join(roots, "unit_idx")
        open_lines = (
            current.groupBy("key", "alike")
            .agg(
                F.min("root").alias("r1"), F.max("root").alias("r2"),
                F.max("pos").alias("n"), F.max("proposes").alias("any"),
            )
            .filter(F.col("any") & (F.col("r1") != F.col("r2")) & (F.col("n") >= low))
            .select("key", "alike", (F.col("n") + 1).alias("n"))
        )
        open_lines = materialize(open_lines, "open-lines")
        if open_lines.isEmpty():
            return roots, edges
        met = _in_line(current.join(open_lines, ["key", "alike"]), low, low * 2, same_people)
        found = materialize(met if also is None else also(materialize(met, "met")), "proposals")
        new = _enough_in_common(found, known)
        if not new.isEmpty():
            edges.append(new)
            roots = _joined_roots(roots, new)
        low *= 2


def _overlap_edges(keys: DataFrame, profiles: DataFrame, roots: DataFrame) -> tuple:
    """Edges by common messages; returns the final roots and the edge tables."""
    holders = _rarest_first(keys)
    known = holders.select("unit_idx", "key")
    facts = profiles.select("unit_idx", "people_key", "norm_title")
    roots, edges = _walk(_alike(holders, facts), roots, known, F.col("alike").startswith("people "))

    # What is left are different titles that are nearly the same.
    def near(met: DataFrame) -> DataFrame:
        return with_near_titles(met, facts).select(*met.columns)

    roots, more = _walk(_nearly_alike(holders, facts, roots), roots, known, F.lit(False), near)
    return roots, edges + more


def stitch(units: DataFrame, raw: DataFrame, mode: str = "full") -> Stitched:
    """Group exports into chats.

    ``mode="titles"`` joins equal titles only.  The chat id is the smallest
    export of the chat.
    """
    profiles = materialize(unit_profiles(units, raw), "profiles")
    if mode == "titles":
        named = profiles.filter(~F.col("placeholder")).select("unit_idx", "norm_title")
        edges = _star_edges(named, "norm_title", "same title")
    elif mode == "full":
        edges = same_title_edges(profiles).unionByName(same_people_edges(profiles))
    else:
        raise ValueError(f"unknown stitch mode: {mode}")
    edges = materialize(edges, "star-edges")
    grouped = star_components(edges, "unit_idx", "hub")
    roots = profiles.join(
        grouped.withColumnRenamed("node", "unit_idx"), "unit_idx", "left"
    ).select("unit_idx", F.coalesce("root", "unit_idx").alias("root"))
    if mode == "full":
        keys = materialize(message_keys(raw), "message-keys")
        roots, found = _overlap_edges(keys, profiles, materialize(roots, "roots"))
        for extra in found:
            reason = F.when(F.col("same_people"), "same people and messages").otherwise(
                "close title and messages"
            )
            edges = edges.unionByName(
                extra.select(F.col("b").alias("unit_idx"), F.col("a").alias("hub"), reason.alias("reason"))
            )
    chats = profiles.join(roots, "unit_idx").select(
        "unit_idx",
        F.col("root").alias("chat_id"),
        "title",
        "placeholder",
        "groupish",
    )
    return Stitched(chats, edges)
