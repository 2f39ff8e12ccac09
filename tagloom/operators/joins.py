"""Joins over notes, sessions, calls and log events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tagloom.functions.time import micros
from tagloom.operators.running import running
from tagloom.session import broadcast_if_fits


def as_of_last(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, value: Column, out: str) -> DataFrame:
    """Latest right value at or before each left row, per key. Days are the slices of hot keys."""
    both = left.select(*keys, time, F.col(left_id).alias("_id"), F.lit(1).alias("_side"), F.lit(None).alias("_v")).unionByName(
        right.select(*keys, time, F.lit(None).cast("bigint").alias("_id"), F.lit(0).alias("_side"), value.alias("_v"))
    )
    seen = running(both, keys, [time, "_side"], F.date_trunc("day", F.col(time)), {out: ("last", F.col("_v"))})
    return seen.filter(F.col("_side") == 1).select(*keys, F.col("_id").alias(left_id), time, out)


def interval_match(
    calls: DataFrame, events: DataFrame, keys: list[str], before_s: float, after_s: float
) -> DataFrame:
    """One-to-one match of log events to calls inside [t - before, t + after].

    Both inputs hold (keys, id, t, label). A call with the same label beats any other, then the nearest in time.
    Only four candidates per event are ever built (nearest on each side, with and without the label), so busy
    keys do not multiply. Pairs that choose each other match.
    """
    events = events.select(*keys, "id", "t", "label", F.lit(1).alias("side"))
    calls = calls.select(*keys, "id", "t", "label", F.lit(0).alias("side"))
    both = events.unionByName(calls).withColumn("us", micros(F.col("t")))
    day = F.floor(F.col("us") / F.lit(86_400_000_000))
    point = F.when(F.col("side") == 0, F.struct("us", "id", "label"))
    for name, group in (("same", [*keys, "label"]), ("any", keys)):
        both = running(both, group, ["us", "side", "id"], day, {f"p_{name}": ("last", point)})
        both = both.withColumn("_e", -F.col("side"))
        both = running(both, group, ["us", "_e", "id"], day, {f"n_{name}": ("last", point)}, descending=True).drop("_e")
    options = F.filter(
        F.array("p_same", "n_same", "p_any", "n_any"),
        lambda c: c.isNotNull()
        & (F.col("us") - c["us"] >= -int(after_s * 1e6))
        & (F.col("us") - c["us"] <= int(before_s * 1e6)),
    )
    scored = F.transform(
        options,
        lambda c: F.struct(
            (c["label"] != F.col("label")).cast("int").alias("other"),
            F.abs(F.col("us") - c["us"]).alias("gap_us"),
            c["id"].alias("call_id"),
        ),
    )
    best = both.filter("side = 1").select(*keys, F.col("id").alias("event_id"), F.array_min(scored).alias("b"))
    chosen = best.filter(F.col("b").isNotNull()).select(*keys, "event_id", "b.*")
    return (
        chosen.groupBy(*keys, "call_id")
        .agg(F.min(F.struct("other", "gap_us", "event_id")).alias("m"))
        .select(*keys, "m.event_id", "call_id", (F.col("m.other") == 0).alias("same_label"), (F.col("m.gap_us") / 1e6).alias("gap_s"))
    )


def interval_match_in_order(calls: DataFrame, events: DataFrame, keys: list[str], before_s: float, after_s: float) -> DataFrame:
    """One-to-one match in which events choose in order of (t, id) among the calls no earlier event has taken.

    Inputs and preferences are those of `interval_match`: a call with the same label first, then the nearest in time,
    then the earlier one. A key's rows stream through a task by time; only open calls of one window are kept.
    """
    before, after = int(before_s * 1e6), int(after_s * 1e6)
    rows = events.select(*keys, "id", "t", "label", F.lit(1).alias("side")).unionByName(calls.select(*keys, "id", "t", "label", F.lit(0).alias("side")))
    rows = rows.withColumn("us", micros(F.col("t"))).drop("t")
    # an event is decided once every call it may take has been seen
    rows = rows.withColumn("due", F.col("us") + F.col("side") * after).repartition(*keys).sortWithinPartitions(*keys, "due", "side", "id")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([*(rows.schema[k] for k in keys), StructField("event_id", kinds["id"]), StructField("call_id", kinds["id"]), StructField("same_label", BooleanType()), StructField("gap_s", DoubleType())])

    def match(batches):
        key, open_calls = None, []
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                own = tuple(r[k] for k in keys)
                if own != key:
                    key, open_calls = own, []
                if r["side"] == 0:
                    open_calls.append(r)
                    continue
                open_calls = [c for c in open_calls if c["us"] >= r["us"] - before]
                if open_calls:
                    best = min(open_calls, key=lambda c: (c["label"] != r["label"], abs(c["us"] - r["us"]), c["us"], c["id"]))
                    open_calls.remove(best)
                    found.append((*own, r["id"], best["id"], best["label"] == r["label"], abs(best["us"] - r["us"]) / 1e6))
            columns = list(zip(*found, strict=True)) if found else [[] for _ in out.fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, out.fields, strict=True)], names=out.names)

    return rows.mapInArrow(match, out)


def interval_match_rounds(calls: DataFrame, events: DataFrame, keys: list[str], before_s: float, after_s: float) -> DataFrame:
    """Repeat `interval_match` on what is left until no pair is found: best pairs first, every call used once."""
    from tagloom.session import cut_lineage

    found = None
    while True:
        hit = cut_lineage(interval_match(calls, events, keys, before_s, after_s), "interval-match")
        found = hit if found is None else found.unionByName(hit)
        if hit.isEmpty():
            return found
        calls = cut_lineage(calls.join(hit.select(F.col("call_id").alias("id")), "id", "left_anti"), "calls-left")
        events = cut_lineage(events.join(hit.select(F.col("event_id").alias("id")), "id", "left_anti"), "events-left")


def notes_sharing_a_tag(file_tags: DataFrame, direct_above: int = 12) -> DataFrame:
    """(file_id, shared): how many other notes share at least one tag with each note.

    Notes carry few tags, so the size of the union is counted from tag subsets (inclusion and exclusion); a hub
    tag held by a third of all notes costs one row per note, never one per pair. A subset no other note has adds
    nothing, nor do its supersets, so larger subsets are built only from pairs that occur twice. The few notes with
    more tags than `direct_above` are joined directly.
    """
    order = Window.partitionBy("file_id").orderBy("tag_id")
    lists = (
        file_tags.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") <= direct_above + 1)
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list("tag_id")).alias("ts"))
        .withColumn("n", F.size("ts"))
    )
    small = lists.filter(F.col("n") <= direct_above).select("file_id", "ts", "n")
    wide = lists.filter(F.col("n") > direct_above).select("file_id")

    def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
        """Rows whose key occurs in another note too, with the number of other notes."""
        counts = rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
        return rows.join(counts, key)

    singles = repeated(small.select("file_id", F.explode("ts").alias("a")), ["a"])
    pairs = small.select("file_id", "ts", "n", F.posexplode("ts").alias("i", "a")).select(
        "file_id", "a", F.explode(F.expr("slice(ts, i + 2, n)")).alias("b")
    )
    pairs = repeated(pairs, ["a", "b"])
    linked = pairs.groupBy("file_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("ts"))
    masks = F.expr("sequence(1, cast(shiftleft(1, size(ts)) as int) - 1)")
    larger = (
        linked.filter(F.size("ts") >= 3)
        .select("file_id", "ts", F.explode(masks).alias("mask"))
        .filter(F.bit_count("mask") >= 3)
        .select("file_id", F.bit_count("mask").alias("k"), F.expr("array_join(transform(filter(ts, (t, i) -> (shiftright(mask, i) & 1) = 1), t -> cast(t as string)), ',')").alias("key"))
    )
    larger = repeated(larger, ["key"])
    signed = (
        singles.select("file_id", F.col("others").alias("x"))
        .unionByName(pairs.select("file_id", (-F.col("others")).alias("x")))
        .unionByName(larger.select("file_id", F.when(F.col("k") % 2 == 1, F.col("others")).otherwise(-F.col("others")).alias("x")))
    )
    wide_tags = file_tags.join(wide, "file_id", "left_semi")
    touching = (
        wide_tags.select(F.col("file_id").alias("wide_id"), "tag_id").join(file_tags.select("file_id", "tag_id"), "tag_id")
        .filter(F.col("wide_id") != F.col("file_id")).select("wide_id", "file_id").distinct()
    )
    for_wide = touching.groupBy(F.col("wide_id").alias("file_id")).agg(F.count(F.lit(1)).alias("x"))
    for_narrow = touching.join(wide, "file_id", "left_anti").groupBy("file_id").agg(F.count(F.lit(1)).alias("x"))
    everyone = file_tags.select("file_id").distinct().withColumn("x", F.lit(0).cast("bigint"))
    return everyone.unionByName(signed).unionByName(for_wide).unionByName(for_narrow).groupBy("file_id").agg(F.sum("x").cast("bigint").alias("shared"))


def orphan_tags(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    return tags.join(file_tags.select("tag_id"), "tag_id", "left_anti")


def resolve_ids(ids: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, file_id, how): an id means a file first, then a chunk of a file."""
    as_file = files.select(F.col("file_id").alias("id"), F.col("file_id").alias("_f"))
    as_chunk = chunks.groupBy(F.col("chunk_id").alias("id")).agg(F.min("file_id").alias("_c"))
    return ids.join(as_file, "id", "left").join(as_chunk, "id", "left").select(
        "id",
        F.coalesce("_f", "_c").alias("file_id"),
        F.when(F.col("_f").isNotNull(), "file").when(F.col("_c").isNotNull(), "chunk").otherwise("missing").alias("how"),
    )


def find_by_substring(needles: DataFrame, titles: DataFrame) -> DataFrame:
    """(needle, matches, title, status): titles containing each needle.

    Candidates meet on the first three characters of the needle, found among the short grams of the title, and
    are then verified.
    """
    wanted = needles.select("needle", F.substring("needle", 1, 3).alias("gram")).filter(F.length("needle") > 0)
    grams = F.expr(
        "array_distinct(flatten(transform(sequence(1, 3), w -> transform(sequence(1, length(title)), i -> substring(title, i, w)))))"
    )
    indexed = titles.select("title", F.explode(grams).alias("gram")).distinct()
    hits = wanted.join(indexed, "gram").filter(F.contains("title", "needle")).groupBy("needle").agg(
        F.count_distinct("title").alias("matches"), F.min("title").alias("title")
    )
    return needles.select("needle").join(hits, "needle", "left").select(
        "needle",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.when(F.col("matches") == 1, F.col("title")).alias("title"),
        F.when(F.col("matches") == 1, "unique").when(F.col("matches") > 1, "ambiguous").otherwise("missing").alias("status"),
    )


def corpus_state_at(files: DataFrame, events: DataFrame) -> DataFrame:
    """(bucket, event_id, visible, state): how many notes existed at each event, and a key naming exactly that set.

    The key is a running sum of note hashes, so two events share it when they see the same notes; no list of
    notes is ever built.
    """
    hashed = F.conv(F.substring(F.sha2(F.col("file_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    both = files.select("bucket", F.col("updated_at").alias("t"), F.lit(None).cast("bigint").alias("event_id"), F.lit(0).alias("side"), hashed.alias("h")).unionByName(
        events.select("bucket", "t", "event_id", F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("h"))
    )
    one = F.when(F.col("side") == 0, F.lit(1)).otherwise(F.lit(0))
    seen = running(
        both, ["bucket"], ["t", "side"], F.date_trunc("month", F.col("t")),
        {"visible": ("sum", one), "state": ("sum", F.coalesce(F.col("h"), F.lit(0)))},
    )
    return seen.filter("side = 1").select("bucket", "event_id", "visible", "state")


def compare_by_key(baseline: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): same, drift, missing or added."""
    a = baseline.select(key, F.col(value).alias("_a"), F.lit(True).alias("_ia"))
    b = live.select(key, F.col(value).alias("_b"), F.lit(True).alias("_ib"))
    return a.join(b, key, "full_outer").select(
        key,
        F.when(F.col("_ib").isNull(), "missing")
        .when(F.col("_ia").isNull(), "added")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same")
        .otherwise("drift")
        .alias("state"),
    )


def session_tree(sessions: DataFrame, levels: int = 4) -> DataFrame:
    """(session_id, root_id, depth): walk up at most `levels` parents, never through a session twice."""
    current = sessions.select("session_id", F.col("parent_id").alias("up"), F.array("session_id").alias("path"))
    parents = sessions.select(F.col("session_id").alias("up"), F.col("parent_id").alias("next"))
    for _ in range(levels):
        step = current.join(parents, "up", "left")
        moved = F.col("up").isNotNull() & ~F.array_contains("path", F.col("up")) & (F.size("path") <= levels)
        current = step.select(
            "session_id",
            F.when(moved, F.col("next")).alias("up"),
            F.when(moved, F.concat("path", F.array("up"))).otherwise(F.col("path")).alias("path"),
        )
    return current.select("session_id", F.element_at("path", -1).alias("root_id"), (F.size("path") - 1).cast("bigint").alias("depth"))


def inherited_bucket(sessions: DataFrame, levels: int = 4) -> DataFrame:
    """(session_id, bucket, depth): own bucket, else the nearest ancestor's within `levels` steps."""
    table = sessions.select(F.col("session_id").alias("up"), F.col("parent_id").alias("next"), F.col("bucket").alias("b"))
    current = sessions.select("session_id", F.col("session_id").alias("up"), F.lit(None).cast("string").alias("found"), F.lit(0).cast("bigint").alias("depth"))
    for level in range(levels + 1):
        step = current.join(table, "up", "left")
        open_ = F.col("found").isNull()
        current = step.select(
            "session_id",
            F.when(open_ & F.col("b").isNull(), F.col("next")).alias("up"),
            F.coalesce("found", "b").alias("found"),
            F.when(open_ & F.col("b").isNotNull(), F.lit(level)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
        )
    return current.select("session_id", F.col("found").alias("bucket"), "depth")


def resolve_bucket(requests: DataFrame, registry: DataFrame, shortest: int = 2) -> DataFrame:
    """(request, bucket, status): by exact name, else by unambiguous hash prefix."""
    prefixes = registry.select("bucket", F.expr(f"explode(transform(sequence({shortest}, length(hash)), n -> substring(hash, 1, n)))").alias("request"))
    by_hash = prefixes.groupBy("request").agg(F.count_distinct("bucket").alias("n"), F.min("bucket").alias("hashed"))
    by_name = registry.select(F.col("bucket").alias("request"), F.col("bucket").alias("named"))
    return requests.join(by_name, "request", "left").join(by_hash, "request", "left").select(
        "request",
        F.coalesce("named", F.when(F.col("n") == 1, F.col("hashed"))).alias("bucket"),
        F.when(F.col("named").isNotNull(), "name").when(F.col("n") == 1, "hash").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"),
    )


def effective_parameters(defaults: DataFrame, presets: DataFrame, overrides: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, name, value, origin): session value, else preset, else default; values out of bounds are skipped.

    `defaults` (name, value, low, high) is one row per parameter; every session gets every parameter.
    """
    bounds = broadcast_if_fits(defaults.select("name", "low", "high"))

    def legal(df, column):
        return df.join(bounds, "name").filter(F.col(column).between(F.col("low"), F.col("high"))).drop("low", "high")

    names = defaults.agg(F.collect_list(F.struct("name", "value")).alias("all")).scalar()
    grid = sessions.select("session_id", "preset").withColumn("d", F.explode(names)).select("session_id", "preset", "d.name", F.col("d.value").alias("base"))
    p = legal(presets.select("preset", "name", F.col("value").alias("pv")), "pv")
    o = legal(overrides.select("session_id", "name", F.col("value").alias("ov")), "ov")
    return grid.join(p, ["preset", "name"], "left").join(o, ["session_id", "name"], "left").select(
        "session_id", "name", F.coalesce("ov", "pv", "base").alias("value"),
        F.when(F.col("ov").isNotNull(), "session").when(F.col("pv").isNotNull(), "preset").otherwise("default").alias("origin"),
    )
