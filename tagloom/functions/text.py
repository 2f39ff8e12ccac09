"""Text column expressions: tag lines, titles, excerpts, token estimates, hash embeddings.

Patterns, limits and marks below are fixed values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TAG_LINE = r"(?im)^Tag[ \t]*[:：][ \t]*(.+)$"
TAG_LINE_STRICT = r"(?m)^[ \t]*Tag[：:][ \t]*(.+)$"
TAG_SPLIT = "[,，、]"
CJK_WIDE = "[⺀-鿿豈-﫿＀-￯]"
CJK = "[一-鿿]"
SENTENCE_END = "[。！？!?]"
UNTITLED = "未命名"
WORD = "[a-z0-9_]{2,}"
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_SPACE = 4294967296


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_tags(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, TAG_SPLIT), strip), lambda t: F.length(t) > 0)


def parse_tag_line(content: Column) -> Column:
    """Tags of the first tag line; empty array without one."""
    return split_tags(F.regexp_extract(content, TAG_LINE, 1))


def parse_last_tag_line(content: Column) -> Column:
    lines = F.regexp_extract_all(content, F.lit(TAG_LINE_STRICT), F.lit(1))
    return split_tags(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))


def strip_tag_line(content: Column) -> Column:
    """Drop the first tag line, squeeze blank runs, trim the right end."""
    line = F.regexp_extract(content, TAG_LINE, 0)
    at = F.instr(content, line)
    cut = F.when(
        F.length(line) > 0,
        F.concat(F.substring(content, F.lit(1), at - 1), F.substring(content, at + F.length(line), F.length(content))),
    ).otherwise(content)
    return F.regexp_replace(F.regexp_replace(cut, r"\n{3,}", "\n\n"), r"\s+$", "")


def lines_of(content: Column) -> Column:
    return F.transform(F.split(content, r"\r?\n"), strip)


def heading(content: Column) -> Column:
    """First non-empty line without its '# ' mark; null when it is not a heading."""
    first = F.try_element_at(F.filter(lines_of(content), lambda x: F.length(x) > 0), F.lit(1))
    title = strip(F.substring(first, F.lit(3), F.length(first)))
    return F.when(first.startswith("# ") & (F.length(title) > 0), title)


def is_untitled(title: Column) -> Column:
    return title.rlike(rf"^(\d{{4}}-\d{{2}}-\d{{2}} )?{UNTITLED}$")


def title_chain(explicit: Column, content: Column, fallback: Column) -> Column:
    def usable(c):
        return F.when(F.length(strip(c)) > 0, strip(c))

    return F.coalesce(usable(explicit), heading(content), F.when(~is_untitled(fallback), usable(fallback)))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, 40)
    return F.when(F.length(s) > 0, s).otherwise(F.lit("diary"))


def date_prefix(text: Column) -> Column:
    return F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def in_time_range(stamp: Column, spec: Column) -> Column:
    """Spec `a~b` with either side optional; both ends inclusive by day."""
    low = F.try_to_date(F.regexp_extract(spec, r"^\s*([0-9-]*)\s*~", 1), "yyyy-MM-dd")
    high = F.try_to_date(F.regexp_extract(spec, r"~\s*([0-9-]*)\s*$", 1), "yyyy-MM-dd")
    day = F.to_date(stamp)
    return (low.isNull() | (day >= low)) & (high.isNull() | (day <= high))


def prose_text(body: Column) -> Column:
    kept = F.filter(
        lines_of(body),
        lambda x: (F.length(x) > 0) & ~x.startswith("#") & ~x.rlike(r"(?i)^Tag\s*[:：]"),
    )
    return strip(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def _cut(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def excerpt(body: Column, limit: int = 120) -> Column:
    return _cut(prose_text(body), limit)


def first_sentence(body: Column, limit: int = 120, minimum: int = 20) -> Column:
    """Shortest run of whole sentences reaching the minimum, else the longest run, else everything; cut to the limit."""
    flat = prose_text(body)

    def found(pattern):
        hit = F.regexp_extract(flat, pattern, 0)
        return F.when(F.length(hit) > 0, hit)

    head = F.coalesce(
        found(rf"(?s)^.{{{minimum - 1},}}?{SENTENCE_END}"), found(rf"(?s)^.*{SENTENCE_END}"), flat
    )
    return _cut(head, limit)


def estimate_tokens(text: Column) -> Column:
    other = F.length(F.regexp_replace(text, CJK_WIDE, ""))
    return (F.length(text) - other + F.ceil(other / 4)).cast("bigint")


def continuation_tail(content: Column, limit: int = 36) -> Column:
    kept = F.filter(lines_of(content), lambda x: (F.length(x) > 0) & ~x.rlike(r"(?i)^tag\s*[:：]"))
    return _cut(F.try_element_at(kept, F.lit(-1)), limit)


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def technical_name(text: Column, allow_space: bool = True) -> Column:
    """Identifier-like names: longer than three characters, ascii letters, digits and joiner marks only."""
    extra = r"\s" if allow_space else ""
    return (F.length(text) > 3) & text.rlike(rf"^[A-Za-z0-9\-_.{extra}]+$")


def citations(text: Column, digits: int | None = 3) -> Column:
    """Cited note numbers of up to `digits` digits, which suits corpora with few notes; None takes numbers of any length."""
    count = "+" if digits is None else f"{{1,{digits}}}"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\bD(\d{count})\b"), F.lit(1)))


def text_hash(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def query_fields(turns: DataFrame, lookback: int = 6, limit: int = 4000) -> DataFrame:
    """Per message: the last `lookback` non-empty messages up to it, joined, right-most characters kept.

    `turns` holds (session_id, turn, text). Sessions are cut into turn blocks; each block keeps its last few
    messages, and the blocks before hand theirs on, so no task sees a whole session and nothing is missed when
    turn numbers have gaps.
    """
    texts = turns.select("session_id", "turn", strip(F.col("text")).alias("text")).filter(F.length("text") > 0)
    texts = texts.withColumn("_b", F.floor(F.col("turn") / 256))
    keep = lookback - 1
    newest = Window.partitionBy("session_id", "_b").orderBy(F.desc("turn"))
    tails = (
        texts.withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= keep)
        .groupBy("session_id", "_b")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"].alias("_tail"))
    )
    earlier = Window.partitionBy("session_id").orderBy("_b").rowsBetween(-keep, -1)
    carry = tails.select("session_id", "_b", F.flatten(F.collect_list("_tail").over(earlier)).alias("_carry"))
    recent = Window.partitionBy("session_id", "_b").orderBy("turn").rowsBetween(-keep, 0)
    seen = texts.withColumn("_own", F.collect_list("text").over(recent)).join(carry, ["session_id", "_b"], "left")
    picked = F.concat(F.coalesce("_carry", F.array().cast("array<string>")), "_own")
    picked = F.slice(picked, F.greatest(F.size(picked) - (lookback - 1), F.lit(1)), F.lit(lookback))
    return seen.select("session_id", "turn", F.array_join(picked, "\n").alias("_t")).select(
        "session_id", "turn", F.expr(f"right(_t, {limit})").alias("query_text")
    )


def _fnv_step(h: Column, code: Column) -> Column:
    return (h.bitwiseXOR(code) * F.lit(FNV_PRIME)) % F.lit(FNV_SPACE)


def hash_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, count): lower-case ascii words, plus CJK single head and adjacent pairs; a null token without any."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({WORD})"), F.lit(1))
    chars = F.regexp_extract_all(F.col(text), F.lit(f"({CJK})"), F.lit(1))
    pairs = F.when(
        F.size(chars) > 1,
        F.zip_with(
            F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))),
            F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))),
            lambda a, b: F.concat(a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    everything = F.filter(F.concat(words, F.slice(chars, 1, 1), pairs), lambda t: t.isNotNull())
    return df.select(key, F.explode_outer(everything).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("count"))


def hash_slots(df: DataFrame, key: str, text: str, dim: int = 3072) -> DataFrame:
    """Sparse unit vectors (key, slot, weight) of a bag-of-words hash embedding.

    Tokens are counted before they are hashed. Texts without tokens get slot 0.
    """
    codes = F.transform(F.split(F.col("token"), ""), lambda c: F.ascii(c).cast("bigint"))
    full = F.filter(codes, lambda c: c > 0)
    h1 = F.aggregate(full, F.lit(FNV_OFFSET).cast("bigint"), _fnv_step)
    h2 = _fnv_step(_fnv_step(F.col("h1"), F.lit(0).cast("bigint")), F.lit(120).cast("bigint"))
    def slot(h: Column, w: Column) -> Column:
        return F.struct((h % dim).cast("int").alias("slot"), w.alias("w"))

    both = F.array(slot(F.col("h1"), F.col("count") * 1.0), slot(h2, F.col("count") * 0.5))
    blank = F.array(F.struct(F.lit(0).alias("slot"), F.lit(1.0).alias("w")))
    hashed = hash_tokens(df, key, text).withColumn("h1", h1).select(key, F.explode(F.when(F.col("token").isNull(), blank).otherwise(both)).alias("s"))
    # a text has at most `dim` slots, so the norm window sees a bounded group
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return hashed.groupBy(key, "s.slot").agg(F.sum("s.w").alias("w")).select(key, "slot", (F.col("w") / norm).alias("weight"))


def dense_vectors(slots: DataFrame, key: str, dim: int) -> DataFrame:
    """Sparse rows to one array<double> per key; at most `dim` entries per group, scattered in Arrow batches."""

    @F.pandas_udf("array<double>")
    def scatter(slots: pd.Series, weights: pd.Series) -> pd.Series:
        def fill(at, w):
            v = np.zeros(dim)
            v[np.asarray(at, dtype=np.int64)] = w
            return v

        return pd.Series([fill(a, w) for a, w in zip(slots, weights)])

    entries = slots.groupBy(key).agg(F.collect_list(F.struct("slot", "weight")).alias("e"))
    return entries.select(key, scatter(F.col("e.slot"), F.col("e.weight")).alias("vector"))


def sparse_vectors(slots: DataFrame, key: str, dim: int) -> DataFrame:
    """Sparse rows to one struct (dim, slots, weights) per key, slots in order; at most `dim` entries per group."""
    entries = slots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slot", "weight"))).alias("e"))
    return entries.select(key, F.struct(F.lit(dim).alias("dim"), F.col("e.slot").alias("slots"), F.col("e.weight").alias("weights")).alias("vector"))


def compose_note(title: Column, body: Column, tags: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), strip(body), F.lit("\n\nTag: "), F.array_join(tags, ", "))


def draft_title(user_text: Column, limit: int = 24) -> Column:
    return F.substring(strip(F.regexp_replace(user_text, r"\s+", " ")), 1, limit)


def with_provenance(content: Column, mark: Column) -> Column:
    """Insert the provenance line before the tag line unless the text already has it."""
    line = F.regexp_extract(content, TAG_LINE, 0)
    at = F.instr(content, line)
    inserted = F.when(
        F.length(line) > 0,
        F.concat(F.substring(content, F.lit(1), at - 1), mark, F.lit("\n\n"), F.substring(content, at, F.length(content))),
    ).otherwise(F.concat(content, F.lit("\n\n"), mark))
    return F.when(F.contains(content, mark), content).otherwise(inserted)
