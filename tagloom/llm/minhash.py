"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct shingles of five words. One permutation scatters the shingles over a ring of slots; a
second one, shifted round the ring by 0, 1, 2, ... places, gives every coordinate of the signature. Documents that agree
on a band of coordinates are candidates, and candidates are confirmed on their full sets.

Equal sets collapse to one representative first. In a bucket every representative meets the bucket's smallest one; as
confirmed links make most buckets one component, only pairs that still lie in different components of a bucket remain,
and each of these is tested as well, a bounded number of leaders a round. So every pair that shares a band is either
tested or already connected, no pairs inside a component are formed, and nothing is capped.

Null texts, empty texts and texts without words have an empty set and link with nothing. Rows without an id stand alone
and are kept. Rows that repeat an id are one document whose texts all count; they share the verdict. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.components import component_labels
from tagloom.llm.registry import query, table
from tagloom.session import broadcast_if_fits, cut_lineage

SHINGLE = 5
PERCENT = 85
SLOTS = 1 << 18
BANDS, ROWS = 24, 5
WORD_CACHE = 100_000
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def _scramble(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one-to-one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _ring() -> tuple[np.ndarray, np.ndarray]:
    """(scatter, rows): the first permutation, and for each slot the second one read at all shifts in turn."""
    draw = np.random.default_rng(20_240_501)
    scatter = draw.permutation(SLOTS)
    order = draw.permutation(SLOTS).astype(np.uint32)
    coordinates = BANDS * ROWS
    return scatter, np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORD_CACHE:
            self.clear()
        if len(word) < 40:
            self[word] = code
        return code


def shingle_set(text: str | None, codes: _WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit shingle codes; only A-Z are lower-cased and only ASCII white space parts words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(codes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(w))
    total = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total += w[k : len(w) - size + 1 + k] * np.uint64(MIX[k])
    return np.unique(_scramble(total))


def band_codes(shingles: np.ndarray) -> np.ndarray:
    scatter, rows = _ring()
    at = scatter[shingles & np.uint64(SLOTS - 1)]
    signature = np.full(BANDS * ROWS, SLOTS, dtype=np.uint32)
    for start in range(0, len(at), 4096):
        signature = np.minimum(signature, rows[at[start : start + 4096]].min(axis=0))
    bands = signature.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = total * np.uint64(MIX[4]) + bands[:, k] * np.uint64(MIX[k]) + np.uint64(1)
    return _scramble(total).view(np.int64)


SIGNATURE = "doc_id bigint, n_shingles bigint, fingerprint string, bands array<bigint>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, set fingerprint and band codes of each row; rows with an empty set have neither."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), codes) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets], pa.string()),
                    pa.array([band_codes(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "fingerprint", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sign, SIGNATURE)


def shingle_sets(docs: DataFrame) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _WordCodes()
        for batch in batches:
            lists = pa.array([shingle_set(t.as_py(), codes).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sets, "doc_id bigint, shingles array<bigint>")


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be alike at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    sized = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")), "b")
    sized = sized.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a")
    shared = sized.select("a", "b", (F.size("of_a") + F.size("of_b")).alias("total"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    return shared.filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b")


def _missed_pairs(bands: DataFrame, leaders: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that no leader has tested: members of a bucket, not its leader, in different components.

    Such documents are paired through the rarest shingles of their sets: two sets that are alike share one among the
    first (100 - percent) in a hundred, in order of frequency among these documents, and from the first one they share
    both have enough shingles left. Members of the component that most of a shingle's documents are in meet only the
    others."""
    members = bands.join(leaders, "band").filter("doc_id <> leader").select("band", "doc_id")
    labelled = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = cut_lineage(labelled, "members")
    # Written tables on the unique side of a join leave the side with hot keys free to be split.
    open_bands = cut_lineage(labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("band"), "bands")
    active = labelled.join(open_bands, "band").select("doc_id", "component").distinct()
    rows = cut_lineage(sets.join(active, "doc_id").select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    frequency = cut_lineage(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")), "frequency")
    ordered = rows.join(frequency, "shingle").groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("docs", "shingle"))).alias("order"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ordered.select("doc_id", "component", "n", F.posexplode(F.slice("order", 1, length.cast("int"))).alias("at", "s")).filter("s.docs > 1")
    prefix = cut_lineage(prefix.select("doc_id", "component", (F.col("n") - F.col("at")).alias("left"), "n", F.col("s.shingle").alias("shingle")), "prefixes")
    shares = prefix.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("docs"))
    largest = shares.groupBy("shingle").agg(F.max(F.struct("docs", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    largest = cut_lineage(largest.filter("components > 1").select("shingle", F.col("top.component").alias("main")), "largest")
    minority = prefix.join(largest, "shingle").filter("component <> main").drop("main")
    minority = cut_lineage(minority.select("shingle", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("left").alias("lb"), F.col("n").alias("nb")), "minority")
    need = (F.col("n") + F.col("nb")) * percent
    pairs = prefix.join(minority, "shingle").filter(
        (F.col("component") != F.col("cb")) & _alike(F.col("n"), F.col("nb"), percent) & (F.least("left", "lb") * (100 + percent) >= need)
    )
    return pairs.select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    signed = cut_lineage(signatures(docs), "signatures")
    known = signed.filter(F.col("fingerprint").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut_lineage(known.groupBy("fingerprint").agg(F.min("doc_id").alias("representative")), "classes")
    reps = known.join(classes.withColumnRenamed("representative", "doc_id"), ["doc_id", "fingerprint"])
    bands = cut_lineage(reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("band")), "bands")
    leaders = bands.groupBy("band").agg(F.min(F.struct("doc_id", "n")).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    leaders = cut_lineage(leaders.select("band", F.col("l.doc_id").alias("leader"), F.col("l.n").alias("leader_n")), "leaders")
    met = bands.join(leaders, "band")
    stars = met.filter((F.col("leader") < F.col("doc_id")) & _alike(F.col("n"), F.col("leader_n"), percent))
    stars = cut_lineage(stars.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    wanted = cut_lineage(met.select("doc_id").distinct(), "wanted")
    sets = cut_lineage(shingle_sets(docs.join(broadcast_if_fits(wanted), "doc_id", "left_semi")), "sets")
    links = cut_lineage(verified(stars, sets, percent), "links")
    # Representatives with one id in two classes are one document.
    labels = component_labels(links)
    more = cut_lineage(verified(_missed_pairs(bands, leaders, labels, sets, percent), sets, percent), "links")
    if more.limit(1).count():
        labels = component_labels(links.unionByName(more))
    found = signed.join(classes, "fingerprint", "left").join(labels.withColumnRenamed("node", "representative"), "representative", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "representative", "doc_id"))
    rows = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  WITH RECURSIVE r AS (SELECT DISTINCT a AS doc_id, a AS other FROM edge UNION SELECT r.doc_id, e.b FROM r JOIN edge e ON e.a = r.other)
  SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)
"""


@query("op4_minhash", _SQL)
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
