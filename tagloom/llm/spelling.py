"""Spelling variants by Bloom-guided neighbourhoods.

Words at one edit (a code point inserted, deleted or replaced) of each other are near. Every word generates its deletions and
its replacements by larger code points, so each pair comes up once, from its longer or its smaller word. Generated edits
exist only as hashes: a polynomial hash gives each of them from the word's own in one step. They are looked up in blocked
Bloom filters of the vocabulary, one per word length, that are broadcast; only positives become strings and are shuffled
to an exact join with the vocabulary, which removes false positives.

A filter takes about two bytes a word. A pass broadcasts filters of at most FILTER_BYTES; larger vocabularies are cut by
length, and a length by hash, into several passes that together look up every edit. Nothing is capped.

A word's form is its commonest near word, if that is common enough; roots follow forms by pointer doubling. Counts grow
along forms, so there are no circles.

Null texts and texts without runs add no words; null ids count as empty strings; repeated rows count each. An empty table,
and one without a word that is common enough, give an empty result. Columns beyond those asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

MIN_LENGTH = 5
MIN_COUNT = 3
FORM_RATIO = 2
# A run's characters, and which runs of the digest query lose a code point.
LETTERS = "A-Za-zÀ-ÿ"
NOISE = 97
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FILTER_BYTES = 32 * 1024 * 1024
BLOCK_WORDS = 8  # 64-bit words of a block; a key sets one bit in each
KEYS_PER_BLOCK = 32
EDITS_AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def runs_of(text: Column) -> Column:
    """Maximal letter runs of a text in order, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), f"[^{LETTERS}]+"), lambda r: r != "")


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and common enough; `words` has one row per occurrence."""
    long_enough = words.filter(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _values(code_points: np.ndarray) -> np.ndarray:
    return _scramble(code_points.astype(np.uint64) + np.uint64(BASE))


def _powers(length: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(length, BASE, np.uint64)]).cumprod(dtype=np.uint64)[:length]


def _matrix(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length)


def word_hashes(words: list[str], length: int) -> np.ndarray:
    return _scramble((_values(_matrix(words, length)) * _powers(length)).sum(axis=1, dtype=np.uint64))


class Shards:
    """Where a word length's filter lies: blocks of the length, and hash segments of it that fit one pass."""

    def __init__(self, counts: dict[int, int], filter_bytes: int):
        self.blocks = {length: max(1, -(-n // KEYS_PER_BLOCK)) for length, n in counts.items()}
        room = max(1, filter_bytes // (8 * BLOCK_WORDS))
        self.passes: list[dict[int, tuple[int, int]]] = []
        used = room
        for length in sorted(self.blocks):
            for low in range(0, self.blocks[length], room):
                high = min(low + room, self.blocks[length])
                if used + high - low > room:
                    self.passes.append({})
                    used = 0
                self.passes[-1][length] = (low, high)
                used += high - low


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bit(hashes: np.ndarray, k: int) -> np.ndarray:
    """The bit a key has in word k of its block."""
    mixed = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(BASE ^ (k * 0x0101010101010102)) + np.uint64(k)
    return np.uint64(1) << (mixed >> np.uint64(58))


def _by_length(words: list[str]) -> dict[int, list[int]]:
    rows: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        rows.setdefault(len(word), []).append(i)
    return rows


MASKS = [f"m{k}" for k in range(BLOCK_WORDS)]


def _filter_blocks(vocab: DataFrame, blocks: dict[int, int], spans: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """The filters of one pass: per length an array (blocks of the segment, BLOCK_WORDS)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, rows in _by_length(words).items():
                hashes = word_hashes([words[i] for i in rows], length)
                at = _block(hashes, blocks[length]).astype(np.int64)
                inside = (at >= spans[length][0]) & (at < spans[length][1])
                hashes, at = hashes[inside], at[inside]
                columns = [pa.array(np.full(len(at), length)), pa.array(at), *(pa.array(_bit(hashes, k).view(np.int64)) for k in range(BLOCK_WORDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "block", *MASKS])

    schema = "length bigint, block bigint, " + ", ".join(f"{m} bigint" for m in MASKS)
    part = vocab.filter(F.length("word").isin([int(k) for k in spans])).select("word").mapInArrow(keys, schema)
    # At most FILTER_BYTES of masks reach the driver.
    filled = part.groupBy("length", "block").agg(*(F.bit_or(m).alias(m) for m in MASKS)).toArrow()
    filters = {length: np.zeros((high - low, BLOCK_WORDS), np.uint64) for length, (low, high) in spans.items()}
    lengths, at = filled["length"].to_numpy(), filled["block"].to_numpy()
    masks = [filled[m].to_numpy().view(np.uint64) for m in MASKS]
    for length, (low, _) in spans.items():
        rows = lengths == length
        for k in range(BLOCK_WORDS):
            filters[length][at[rows] - low, k] = masks[k][rows]
    return filters


def _hits(hashes: np.ndarray, allowed: np.ndarray, length: int, blocks: dict[int, int], spans: dict, filters: dict) -> np.ndarray:
    """Flat positions of allowed hashes that the filter of a length holds."""
    at = np.flatnonzero(allowed)
    h = _scramble(hashes.reshape(-1)[at])
    block = _block(h, blocks[length]).astype(np.int64)
    low, high = spans[length]
    if (low, high) != (0, blocks[length]):
        inside = (block >= low) & (block < high)
        at, h, block = at[inside], h[inside], block[inside]
    block = block - low
    for k in range(BLOCK_WORDS):
        set_ = (filters[length][block, k] & _bit(h, k)) != 0
        at, h, block = at[set_], h[set_], block[set_]
    return at


def _edits(words: list[str], length: int, alphabet: np.ndarray, blocks: dict, spans: dict, filters: dict) -> Iterator[tuple[int, str]]:
    """(row, edited word) of every deletion and larger replacement that the filters hold."""
    codes = _matrix(words, length)
    powers, values = _powers(length), _values(codes)
    terms = values * powers
    totals = terms.sum(axis=1, dtype=np.uint64)
    if length - 1 in spans:
        upto = terms.cumsum(axis=1, dtype=np.uint64)
        deleted = (upto - terms) + (totals[:, None] - upto) * np.uint64(BASE_INVERSE)
        # Of equal neighbours only the first is deleted: the others give the same word.
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        for at in _hits(deleted, first, length - 1, blocks, spans, filters).tolist():
            row, i = divmod(at, length)
            yield row, words[row][:i] + words[row][i + 1 :]
    if length in spans:
        letters = _values(alphabet)
        step = max(1, EDITS_AT_ONCE // (len(words) * max(1, len(alphabet))))
        for start in range(0, length, step):
            part = slice(start, min(start + step, length))
            width = part.stop - start
            replaced = totals[:, None, None] + (letters - values[:, part, None]) * powers[None, part, None]
            larger = alphabet > codes[:, part, None]
            for at in _hits(replaced, larger, length, blocks, spans, filters).tolist():
                place, letter = divmod(at, len(alphabet))
                row, i = divmod(place, width)
                yield row, words[row][: start + i] + chr(alphabet[letter]) + words[row][start + i + 1 :]


def near_pairs(vocab: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, other, other_n): each pair of words at one edit, once. `vocab` is a written table (word, n)."""
    spark = vocab.sparkSession
    schema = "word string, n bigint, other string"
    counts = {r["length"]: r["words"] for r in vocab.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()}
    letters = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").distinct()
    alphabet = np.array(sorted(ord(r["letter"]) for r in letters.collect()), dtype=np.uint32)
    shards = Shards(counts, filter_bytes)
    blocks = shards.blocks
    found = spark.createDataFrame([], schema)
    for spans in shards.passes:
        filters = spark.sparkContext.broadcast(_filter_blocks(vocab, blocks, spans))

        def probe(batches: Iterator[pa.RecordBatch], spans=spans, filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for length, rows in _by_length(words).items():
                    step = max(1, EDITS_AT_ONCE // (length * max(1, len(alphabet))))
                    for start in range(0, len(rows), step):
                        some = rows[start : start + step]
                        hits = list(_edits([words[i] for i in some], length, alphabet, blocks, spans, filters.value))
                        if hits:
                            at = [some[row] for row, _ in hits]
                            columns = [pa.array([words[i] for i in at]), pa.array([n[i] for i in at], pa.int64()), pa.array([e for _, e in hits])]
                            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "other"])

        reached = sorted({int(k) for length in spans for k in (length, length + 1) if k in counts})
        # The vocabulary comes out of an aggregation: words of one root lie anywhere, so the tasks are even.
        found = found.unionByName(vocab.filter(F.length("word").isin(reached)).select("word", "n").mapInArrow(probe, schema))
    return found.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def forms(vocab: DataFrame, ratio: int = FORM_RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form and form_n of each word of a written table (word, n)."""
    both = F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("low"), F.col("other").alias("near")).alias("best")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("low"), F.col("word").alias("near")).alias("best")),
    )
    sides = near_pairs(vocab, filter_bytes).select(F.explode(both).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    top = vocab.join(best, "word", "left")
    enough = -F.col("best.low") >= F.col("n") * ratio
    return top.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.low")).alias("form_n"),
    )


def roots(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of the words of a written table (word, form) that have a form: the last word along the forms."""
    known = cut_lineage(links.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = cut_lineage(known.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if not known.filter(F.col("next").isNotNull()).limit(1).count():
            return known.select("word", "root")
    raise RuntimeError("forms did not settle")


def spelling_groups(vocab: DataFrame, ratio: int = FORM_RATIO, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of (word, n)."""
    known = cut_lineage(vocab, "vocabulary")
    found = cut_lineage(forms(known, ratio, filter_bytes), "forms")
    return found.join(roots(found), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def noisy_words(docs: DataFrame) -> DataFrame:
    """One row per run of (doc_id, text); runs whose checksum with the id is a multiple of NOISE lose one code point."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs_of(F.col("text"))).alias("run"))
    summed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return summed.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word"))


# Checksums go through hexadecimal digits, low one first; near words meet on the word without one place.
_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^{LETTERS}]+'), lambda x: x <> '')) AS run
  FROM documents
), u AS (
  SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS hx FROM r GROUP BY ALL
), c AS (
  SELECT run, times, xor(list_reduce(
    list_transform(range(len(hx)), lambda i: (instr('0123456789ABCDEF', hx[xor(i, 1) + 1]) - 1)::BIGINT),
    lambda s, x: xor([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(s, x) & 15) + 1]::BIGINT, s >> 4), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM u
), w AS (
  SELECT CASE WHEN h % {NOISE} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM c
), v AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}
), gap AS MATERIALIZED (
  SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), pair AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gap a JOIN gap b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gap a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gap a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS near, max(m) AS near_n FROM pair GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {FORM_RATIO} * v.n THEN near END AS form,
         CASE WHEN near_n >= {FORM_RATIO} * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) JOIN f AS e ON e.word = walk.root WHERE e.form IS NULL
"""


@query("op12_spelling_variants", _SQL)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_groups(vocabulary(noisy_words(docs))).select("word", "form", "root", "n", "n_near", "form_n")
