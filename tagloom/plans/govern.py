"""Corpus governance: admission gates, hubs, duplicates, merge candidates, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.neighbours import top_neighbours
from tagloom.params import GovernanceParams

DAY_US = 86_400_000_000


def merge_candidates(
    notes: DataFrame, recalls: DataFrame, now: Column, min_age_days: float = 14.0, max_recalls: int = 1, overlap: float = 0.90
) -> DataFrame:
    """Old, rarely recalled notes that a newer note of the bucket covers.

    Notes (file_id, bucket, vector, stamp in microseconds). The age and recall filters run before the search.
    """
    old = (
        notes.withColumn("_now", now)
        .filter(F.col("_now") - F.col("stamp") >= int(min_age_days * DAY_US))
        .join(recalls, "file_id", "left")
        .withColumn("recalls", F.coalesce("recalls", F.lit(0)).cast("bigint"))
        .filter(F.col("recalls") <= max_recalls)
    )
    queries = old.select(F.col("file_id").alias("query_id"), "bucket", "vector", "stamp")
    corpus = notes.select(F.col("file_id").alias("item_id"), "bucket", "vector", "stamp")
    best = top_neighbours(queries, corpus, 1, group="bucket", min_cos=overlap, distinct=True, later=True)
    return best.join(old.select(F.col("file_id").alias("query_id"), "recalls"), "query_id").select(
        F.col("query_id").alias("file_id"), F.col("item_id").alias("overlap_id"), "score", "recalls"
    )


__all__ = ["GovernanceParams", "merge_candidates"]


def admission(notes: DataFrame, p: GovernanceParams = GovernanceParams()) -> DataFrame:
    """Adds reject_reason from the ordered rules; null means admitted so far. Notes carry content, title, tags, new_tags, new_tag_reason."""
    c = F.col
    long_tag = F.exists("tags", lambda t: F.length(t) > p.max_tag_length)
    reason = (
        F.when(F.length(F.trim(F.coalesce("content", F.lit("")))) == 0, "empty-content")
        .when(F.length(F.trim(F.coalesce("title", F.lit("")))) == 0, "missing-title")
        .when(F.size("tags") == 0, "missing-tag-line")
        .when(F.size("tags") > p.max_tags, "too-many-tags")
        .when(F.size("tags") < p.min_tags, "too-few-tags")
        .when(long_tag, "tag-too-long")
        .when((F.size("new_tags") > 0) & (F.length(F.trim(F.coalesce("new_tag_reason", F.lit("")))) == 0), "unconfirmed-new-tags")
    )
    return notes.withColumn("reject_reason", reason).select(*notes.columns, c("reject_reason"))


def hub_gate(candidate_tags: DataFrame, counts: DataFrame, modes: DataFrame, own: DataFrame | None = None, ratio: float = 1 / 3) -> DataFrame:
    """(note_id, verdict, tag, files, total): first hub tag a note would add to its bucket.

    candidate_tags (note_id, bucket, tag_id); counts (bucket, tag_id, files, total); modes (note_id, mode) off, suggest or
    enforce; `own` (note_id, tag_id) are tags an updated note already carries.
    """
    hubs = counts.filter(F.col("files") / F.col("total") >= ratio).select("bucket", "tag_id", "files", "total")
    new = candidate_tags if own is None else candidate_tags.join(own, ["note_id", "tag_id"], "left_anti")
    hit = new.join(hubs, ["bucket", "tag_id"]).groupBy("note_id").agg(F.min(F.struct("tag_id", "files", "total")).alias("h"))
    return modes.join(hit, "note_id", "left").select(
        "note_id",
        F.when(F.col("h").isNull() | (F.col("mode") == "off"), "pass").when(F.col("mode") == "enforce", "reject").otherwise("observe").alias("verdict"),
        "h.tag_id", "h.files", "h.total",
    )


def synonym_drift(new_tags: DataFrame, existing: DataFrame, limit: float = 0.92) -> DataFrame:
    """(query_id, item_id, score, drift): closest existing tag of each new one."""
    best = top_neighbours(new_tags, existing, 1)
    return best.select("query_id", "item_id", "score", (F.col("score") > limit).alias("drift"))


def hub_alternatives(rejected: DataFrame, vocabulary: DataFrame, ratio: float = 1 / 3, k: int = 5) -> DataFrame:
    """Nearest non-hub tags of the bucket for each rejected tag.

    rejected (query_id, bucket, vector, tag_id); vocabulary (item_id, bucket, vector, files, total).
    """
    pool = vocabulary.filter(F.col("files") / F.col("total") < ratio)
    return top_neighbours(rejected, pool, k, group="bucket")


def frequent_alternatives(rejected: DataFrame, vocabulary: DataFrame, ratio: float = 1 / 3, k: int = 5) -> DataFrame:
    """Without vectors: the most frequent non-hub tags of the bucket, ranked once per bucket, then attached."""
    from tagloom.operators.running import top_n

    pool = top_n(vocabulary.filter(F.col("files") / F.col("total") < ratio), ["bucket"], [F.desc("files"), F.asc("tag_id")], k + 1)
    order = [F.desc("files"), F.asc("alternative")]
    rows = rejected.join(pool.select("bucket", F.col("tag_id").alias("alternative"), "files"), "bucket").filter("alternative <> tag_id")
    return top_n(rows, ["bucket", "tag_id"], order, k).select("bucket", "tag_id", "alternative", "files", "rank")


def cold_tags(suggested: DataFrame, counts: DataFrame, limit: int = 4) -> DataFrame:
    """(note_id, tags): suggested non-hub tags in order, topped up with the bucket's most frequent non-hub tags.

    suggested (note_id, bucket, position, tag_id); counts (bucket, tag_id, files, total).
    """
    from tagloom.operators.running import top_n

    hub = (F.col("files") >= 3) & (F.col("files") >= F.col("total") / 3)
    judged = suggested.join(counts, ["bucket", "tag_id"], "left").withColumn("hub", F.coalesce(hub, F.lit(False)))
    kept = judged.filter("NOT hub").select("note_id", "bucket", "tag_id", F.lit(0).alias("tier"), "position")
    spare = top_n(counts.filter(~hub & (F.col("files") >= 1)), ["bucket"], [F.desc("files"), F.asc("tag_id")], 2 * limit)
    notes = suggested.select("note_id", "bucket").distinct()
    filler = notes.join(spare.select("bucket", "tag_id", F.col("rank").alias("position")), "bucket").join(kept.select("note_id", "tag_id"), ["note_id", "tag_id"], "left_anti")
    both = kept.unionByName(filler.select("note_id", "bucket", "tag_id", F.lit(1).alias("tier"), "position"))
    best = top_n(both, ["note_id"], [F.asc("tier"), F.asc("position"), F.asc("tag_id")], limit)
    return best.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tag_id")))["tag_id"].alias("tags"))


def same_axis(suggested: DataFrame, recent_tags: DataFrame, minimum: int = 2) -> DataFrame:
    """(note_id, hit, overlap): the recent note of the bucket sharing most suggested tags.

    recent_tags (bucket, file_id, tag_id) of the newest few notes per bucket.
    """
    shared = suggested.join(recent_tags, ["bucket", "tag_id"]).filter("note_id <> file_id").groupBy("note_id", "file_id").agg(F.count_distinct("tag_id").alias("overlap"))
    return shared.filter(F.col("overlap") >= minimum).groupBy("note_id").agg(
        F.max_by("file_id", F.struct("overlap", -F.col("file_id"))).alias("hit"), F.max("overlap").alias("overlap")
    )


def draft_precheck(drafts: DataFrame, tag_hits: DataFrame, hubs: DataFrame, twins: DataFrame, p: GovernanceParams = GovernanceParams()) -> DataFrame:
    """(draft_id, state, tags): discard near-duplicates, ask a person when fewer than three usable tags are left, else ok.

    tag_hits (draft_id, tag_id, rank) nearest tags; hubs (tag_id); twins (draft_id, score) closest existing note.
    """
    usable = tag_hits.join(hubs, "tag_id", "left_anti").groupBy("draft_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tag_id")))["tag_id"].alias("tags"))
    x = drafts.join(usable, "draft_id", "left").join(twins.select("draft_id", "score"), "draft_id", "left")
    n = F.coalesce(F.size("tags"), F.lit(0))
    state = F.when(F.col("score") > p.near_duplicate, "discard").when(n < p.min_tags, "manual").otherwise("ok")
    return x.select("draft_id", state.alias("state"), F.when(n >= p.min_tags, F.col("tags")).alias("tags"), "score")


def health(files: DataFrame, file_tags: DataFrame, components: DataFrame, omega: DataFrame, uncovered: DataFrame, p: GovernanceParams = GovernanceParams()) -> DataFrame:
    """One row per bucket: components, largest tag share, observability mean, uncovered share, warnings, ok.

    components (bucket, components); omega (bucket, mean); uncovered (bucket, ratio).
    """
    from tagloom.operators.ledger import bucket_tag_counts

    counts = bucket_tag_counts(files, file_tags)
    hub = counts.groupBy("bucket").agg(F.max_by(F.struct("tag_id", "files", "ratio"), F.struct("files", -F.col("tag_id"))).alias("h"))
    totals = files.groupBy("bucket").agg(F.count(F.lit(1)).alias("files"))
    x = totals.join(components, "bucket", "left").join(hub, "bucket", "left").join(omega, "bucket", "left").join(uncovered, "bucket", "left")
    warnings = F.filter(
        F.array(
            F.when(F.col("components") > 1, F.lit("components")),
            F.when(F.col("h.ratio") >= p.hub_ratio, F.lit("hub")),
            F.when(F.col("ratio") > p.uncovered_warn, F.lit("uncovered")),
        ),
        lambda w: w.isNotNull(),
    )
    return x.select(
        "bucket", "files", "components", F.col("h.tag_id").alias("hub_tag"), F.col("h.files").alias("hub_files"), F.col("h.ratio").alias("hub_ratio"),
        F.col("mean").alias("omega_mean"), F.col("ratio").alias("uncovered"), F.array_join(warnings, ",").alias("warnings"), (F.size(warnings) == 0).alias("ok"),
    )


def patrol_hubs(counts: DataFrame, files: DataFrame, file_tags: DataFrame, ratio: float = 1 / 3) -> DataFrame:
    """Findings: hub tags with the number of affected notes and all of them."""
    hubs = counts.filter(F.col("ratio") >= ratio).select("bucket", "tag_id", F.col("files").alias("affected"), "ratio")
    hit = file_tags.join(files.select("file_id", "bucket"), "file_id").join(hubs, ["bucket", "tag_id"])
    return hit.groupBy("bucket", "tag_id", "affected", "ratio").agg(F.array_sort(F.collect_list("file_id")).alias("notes"))


def patrol_untitled(notes: DataFrame) -> DataFrame:
    """Notes (file_id, bucket, content) without a heading or with a placeholder one."""
    from tagloom.functions.text import heading, is_untitled

    title = heading(F.col("content"))
    return notes.filter(title.isNull() | is_untitled(title)).select("file_id", "bucket", title.alias("title"))


def retag_check(plan: DataFrame, files: DataFrame, limit: float = 1 / 3) -> DataFrame:
    """Per bucket and tag of a retag plan (file_id, tag_id): share of notes and whether it stays below the limit."""
    from tagloom.operators.ledger import bucket_tag_counts

    return bucket_tag_counts(files, plan).withColumn("allowed", F.col("files") < F.col("total") * limit)


def corpus_criteria(components: DataFrame, counts: DataFrame, orphans: DataFrame, drift: DataFrame, report: DataFrame) -> DataFrame:
    """One row per criterion with value and pass flag: one component, no hub, no orphan tags, bodies intact, report agrees."""
    def row(name, df, value, ok):
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("criterion"), "value", ok.alias("passed"))

    v = F.col("value")
    return (
        row("components", components, F.count_distinct("component"), v == 1)
        .unionByName(row("hub", counts, F.max("ratio"), v < 1 / 3))
        .unionByName(row("orphans", orphans, F.count(F.lit(1)), v == 0))
        .unionByName(row("bodies", drift, F.count_if(F.col("state") != "same"), v == 0))
        .unionByName(row("report", report, F.count_if(~F.col("agrees")), v == 0))
    )


def approve(
    drafts: DataFrame, tables: dict[str, DataFrame], counts: DataFrame, mode: str = "suggest", p: GovernanceParams = GovernanceParams()
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Admit a batch of drafts and write the ones that pass. Returns (outcome per draft, new tables).

    Drafts are an upsert batch (file_id, path, bucket, checksum, updated_at, content, vector, tags) plus title,
    new_tag_reason. Gates run in order: shape, hub tags, synonyms of existing tags are left to `synonym_drift`,
    near-duplicates of the bucket last. One bad draft never stops the others.
    """
    from tagloom.sinks.notes import upsert_notes

    names = tables["tags"].select("name")
    fresh = drafts.select("file_id", F.explode("tags").alias("name")).join(names, "name", "left_anti").groupBy("file_id").agg(F.collect_set("name").alias("new_tags"))
    shaped = admission(drafts.join(fresh, "file_id", "left").withColumn("new_tags", F.coalesce("new_tags", F.array().cast("array<string>"))), p)
    ids = tables["tags"].select("tag_id", "name")
    wanted = drafts.select(F.col("file_id").alias("note_id"), "bucket", F.explode("tags").alias("name")).join(ids, "name").select("note_id", "bucket", "tag_id")
    hubs = hub_gate(wanted, counts, drafts.select(F.col("file_id").alias("note_id"), F.lit(mode).alias("mode"))).select(F.col("note_id").alias("file_id"), "verdict")
    stored = tables["chunks"].join(tables["files"].select("file_id", "bucket"), "file_id").select(F.col("chunk_id").alias("item_id"), "bucket", "vector")
    twins = top_neighbours(drafts.select(F.col("file_id").alias("query_id"), "bucket", "vector"), stored, 1, group="bucket").select(F.col("query_id").alias("file_id"), F.col("score").alias("twin_score"))
    judged = shaped.join(hubs, "file_id", "left").join(twins, "file_id", "left").withColumn(
        "outcome",
        F.coalesce("reject_reason", F.when(F.col("verdict") == "reject", "hub-tag"), F.when(F.col("twin_score") > p.near_duplicate, "near-duplicate"), F.lit("written")),
    )
    passed = judged.filter("outcome = 'written'").select("file_id", "path", "bucket", "checksum", "updated_at", "content", "vector", "tags")
    return judged.select("file_id", "outcome"), upsert_notes(tables, passed)


def position_after_write(file_tags: DataFrame, before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes sharing tags per note, change of the health numbers per bucket) after a batch of writes."""
    from tagloom.operators.joins import notes_sharing_a_tag
    from tagloom.operators.ledger import summary_delta

    return notes_sharing_a_tag(file_tags), summary_delta(before, after, "bucket", ["files", "components", "hub_ratio", "uncovered"])
