"""Repeated passages: every byte covered by a string of LENGTH bytes that also starts earlier is removed.

Documents are bytes in UTF-8, ordered by doc_id; matches never cross documents.

1. Runs. Each window of LENGTH bytes has a smallest gram hash, its anchor; equal windows have equal anchors. Neighbouring
   windows with one anchor form a run, so there is about one row for forty bytes. Equal runs collapse, first per block of
   documents, then per anchor: all but the first one are repeats as a whole.
2. Fragments. Only where an anchor has several different runs, or a run repeats inside itself, the first ones' texts are
   fetched. All fragments of an anchor meet in one task, which builds an enhanced suffix array over them: prefix-doubling
   ranks, common-prefix lengths from the same ranks, and a stack scan of the common-prefix interval tree. An interval
   whose occurrences differ in the byte before them is a maximal repeat; all its occurrences but the earliest are
   repeats, also where their neighbours in the array are other texts. Intervals that extend to the left are left to the
   longer repeat that covers them.
3. Frequent anchors (a share of all documents, found on a sample of documents, which decides the route alone) would fill
   one task. Their runs are dealt out by content, and their suffixes by the hash of the first LENGTH bytes. So are the
   suffixes of any other anchor whose different runs hold more than ANCHOR_BYTES: no suffix array grows with the corpus.
4. Spans are merged per document and cut out.

Null texts are empty. Documents must differ in doc_id; where ids repeat or are null, rows are numbered anew in the order
of id (null last) and text, so that of equal rows the first is the earlier one. Empty tables give empty results; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.registry import query, table
from tagloom.session import cut_lineage

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 4_000_000
# An anchor in this share of the sampled documents, and in so many of them at least, is frequent. A document has few runs
# for its length, so the list stays near its average number of runs divided by the share.
FREQUENT_SHARE, FREQUENT_DOCS, SAMPLE_DOCS = 0.002, 64, 500_000
BATCH_BYTES = 1_500_000
ANCHOR_BYTES = 1_500_000
WORD = 7

_draw = np.random.default_rng(7)
_BYTES = _draw.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(2 * BLOCK_BYTES + LENGTH, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _sums(data: bytes) -> np.ndarray:
    t = np.frombuffer(data, dtype=np.uint8)
    c = np.zeros(len(t) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[t] * _powers()[0][: len(t)], out=c[1:])
    return c


def _hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings from the sums of `_sums`."""
    return _scramble((c[end] - c[start]) * _powers()[1][start] + (end - start).astype(np.uint64))


def _slide(h: np.ndarray, width: int, pick) -> np.ndarray:
    out, span = h, 1
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def find_runs(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first byte, end byte, repeats inside) of the runs over the given window starts (sorted)."""
    c = _sums(data)
    grams = _scramble((c[GRAM:] - c[:-GRAM]) * _powers()[1][: len(c) - GRAM])
    width = LENGTH - GRAM + 1
    low = _slide(grams, width, np.minimum)
    anchor = low[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    # An anchor gram that occurs twice within reach: the runs around may hold a window twice.
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)])
    chosen = np.flatnonzero(grams == _slide(padded, width, np.maximum))
    twice = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (chosen[1:] - chosen[:-1] < LENGTH))
    lo = np.searchsorted(last, chosen[twice + 1] - LENGTH)
    hi = np.searchsorted(first, chosen[twice], side="right")
    marks = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(marks, lo, 1)
    np.add.at(marks, np.maximum(hi, lo), -1)
    return anchor[at], _hash(c, first, last + LENGTH), first, last + LENGTH, np.cumsum(marks)[:-1] > 0


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, doc ids, offsets in the document, window starts) of documents in order of id, about BLOCK_BYTES at a time.
    A longer document comes in pieces that overlap by less than a window."""
    for batch in batches:
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, size = [], 0
        for row in np.argsort(ids, kind="stable").tolist():
            text = batch.column(1)[row].as_py()
            data = (text or "").encode()
            for at in range(0, max(len(data) - LENGTH + 1, 0), BLOCK_BYTES):
                piece = data[at : at + BLOCK_BYTES + LENGTH - 1]
                parts.append((ids[row], at, piece))
                size += len(piece)
                if size >= BLOCK_BYTES:
                    yield _joined(parts)
                    parts, size = [], 0
        if parts:
            yield _joined(parts)


def _joined(parts):
    lengths = np.array([len(p) for _, _, p in parts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begins, lengths, strict=True)])
    return b"".join(p for _, _, p in parts), np.array([d for d, _, _ in parts]), begins, np.array([o for _, o, _ in parts]), starts


RUNS = "deal bigint, anchor bigint, content bigint, doc_id bigint, start bigint, size bigint, kind int"
# Kinds of rows: a repeat for certain, the only or first run of its content, one that repeats inside.
REPEAT, SINGLE, INSIDE = 0, 1, 2


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    arrays = [pa.array(c.view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _runs(docs: DataFrame, frequent: list[int]) -> DataFrame:
    hot = np.sort(np.array(frequent, dtype=np.int64))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, ids, begins, offsets, starts in _blocks(batches):
            anchor, content, first, end, inside = find_runs(data, starts)
            piece = np.searchsorted(begins, first, side="right") - 1
            # Equal runs of a block: the first stays, the others are repeats.
            order = np.argsort(content ^ (anchor * np.uint64(3)), kind="stable")
            a, h = anchor[order], content[order]
            again = np.zeros(len(order), dtype=bool)
            again[1:] = (a[1:] == a[:-1]) & (h[1:] == h[:-1])
            kind = np.where(inside, INSIDE, SINGLE).astype(np.int32)
            kind[order[again]] = REPEAT
            a = anchor.view(np.int64)
            deal = np.where(np.isin(a, hot), content.view(np.int64), a)
            yield _batch(RUNS, deal, a, content, ids[piece], first - begins[piece] + offsets[piece], end - first, kind)

    return docs.mapInArrow(runs, RUNS)


def _frequent_anchors(docs: DataFrame, n_docs: int) -> list[int]:
    """Anchors in a large share of a sample of the documents; the list only decides how rows are dealt out."""
    share = min(1.0, max(SAMPLE_DOCS / max(n_docs, 1), 0.0), max(0.05, 20_000 / max(n_docs, 1)))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, ids, begins, _, starts in _blocks(batches):
            anchor, _, first, _, _ = find_runs(data, starts)
            piece = np.searchsorted(begins, first, side="right") - 1
            pairs = np.unique(np.stack([anchor.view(np.int64), ids[piece]]), axis=1)
            values, counts = np.unique(pairs[0], return_counts=True)
            yield _batch("anchor bigint, docs bigint", values, counts.astype(np.int64))

    least = max(FREQUENT_DOCS, int(FREQUENT_SHARE * share * n_docs))
    counted = sample.mapInArrow(anchors, "anchor bigint, docs bigint").groupBy("anchor").agg(F.sum("docs").alias("docs"))
    return [r["anchor"] for r in counted.filter(F.col("docs") >= least).select("anchor").collect()]


RESOLVED = "kind int, anchor bigint, doc_id bigint, start bigint, size bigint"
SPAN, FRAGMENT, FREQUENT = 0, 1, 2


def _resolve(runs: DataFrame, frequent: list[int]) -> DataFrame:
    """Spans of runs that also occur earlier, and the first runs whose windows must be compared."""
    hot = np.sort(np.array(frequent, dtype=np.int64))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collected = [b for b in batches if b.num_rows]
        if not collected:
            return
        anchor, content, doc, start, size, kind = (np.concatenate([b.column(i).to_numpy() for b in collected]) for i in range(1, 7))
        sure = kind == REPEAT
        yield _batch(RESOLVED, np.zeros(sure.sum(), np.int32), anchor[sure], doc[sure], start[sure], size[sure])
        rest = np.flatnonzero(~sure)
        order = rest[np.lexsort((start[rest], doc[rest], content[rest], anchor[rest]))]
        anchor, content, doc, start, size, kind = (x[order] for x in (anchor, content, doc, start, size, kind))
        new_anchor = np.ones(len(order), dtype=bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= content[1:] != content[:-1]
        group = np.cumsum(new_anchor) - 1
        several = np.bincount(group, weights=new)[group] > 1
        is_hot = np.isin(anchor, hot)
        wanted = new & (several | (kind == INSIDE) | is_hot)
        heavy = np.bincount(group, weights=np.where(wanted, size, 0))[group] > ANCHOR_BYTES
        out = np.where(~new, SPAN, np.where(is_hot | heavy, FREQUENT, FRAGMENT)).astype(np.int32)
        keep = ~new | wanted
        yield _batch(RESOLVED, out[keep], anchor[keep], doc[keep], start[keep], size[keep])

    return runs.repartition("deal").mapInArrow(resolve, RESOLVED)


# Rows without data are windows of frequent anchors; a negative size marks a span that certainly repeats.
PIECES = "deal bigint, doc_id bigint, start bigint, size bigint, data binary"


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of fragments, and for frequent anchors the windows themselves by hash."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "anchor", "start", "size")).alias("asked"))
    joined = docs.join(asked, "doc_id").select("doc_id", "text", "asked")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deal, ids, at, data = [], [], [], []
            windows = []
            for row in range(batch.num_rows):
                doc, text, asked = (batch.column(i)[row].as_py() for i in range(3))
                raw = (text or "").encode()
                for a in asked:
                    piece = raw[a["start"] : a["start"] + a["size"]]
                    if a["kind"] == FRAGMENT:
                        deal.append(a["anchor"])
                        ids.append(doc)
                        at.append(a["start"])
                        data.append(piece)
                    else:
                        windows.append((doc, a["start"], piece))
                if sum(len(w[2]) for w in windows[-64:]) > BLOCK_BYTES or len(windows) > 4096:
                    yield _window_rows(windows)
                    windows = []
            yield _window_rows(windows)
            yield _batch(PIECES, np.array(deal, np.int64), np.array(ids, np.int64), np.array(at, np.int64), np.array([len(x) for x in data], np.int64), data)

    return joined.mapInArrow(pieces, PIECES)


def _window_rows(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Windows by hash. Of equal windows here only the earliest is dealt out; the others repeat it and become spans."""
    found = []
    for doc, start, piece in pieces:
        for at in range(0, len(piece) - LENGTH + 1, BLOCK_BYTES):
            part = piece[at : at + BLOCK_BYTES + LENGTH - 1]
            i = np.arange(len(part) - LENGTH + 1)
            found.append((_hash(_sums(part), i, i + LENGTH).view(np.int64), np.full(len(i), doc, np.int64), i + at + start))
    if not found:
        return _batch(PIECES, *[np.empty(0, np.int64)] * 4, [])
    deal, doc, start = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((start, doc, deal))
    first = np.ones(len(order), dtype=bool)
    first[1:] = deal[order][1:] != deal[order][:-1]
    alone, again = order[first], np.sort(order[~first])
    again = again[np.lexsort((start[again], doc[again]))]
    new = np.ones(len(again), dtype=bool)
    new[1:] = (doc[again][1:] != doc[again][:-1]) | (start[again][1:] > start[again][:-1] + LENGTH)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(again)) - 1
    span = start[again[last]] + LENGTH - start[again[begin]] if len(again) else np.empty(0, np.int64)
    size = np.concatenate([np.full(len(alone), LENGTH), -span])
    rows = np.concatenate([alone, again[begin]])
    return _batch(PIECES, deal[rows], doc[rows], start[rows], size, pa.nulls(len(rows), pa.binary()))


def suffix_ranks(text: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 7, 14, 28, ... bytes; `left` is how many bytes a suffix has. A suffix that ends
    comes before one that goes on."""
    n = len(text)
    word = np.zeros(n, dtype=np.int64)
    for k in range(WORD):
        part = np.zeros(n, dtype=np.int64)
        part[: n - k] = text[k:].astype(np.int64) + 1
        word = word << 9 | np.where(left > k, part, 0)
    levels, depth, key = [], WORD, word
    while True:
        order = np.argsort(key)
        step = np.zeros(n, dtype=np.int64)
        sorted_key = key[order]
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        levels.append((depth, rank))
        if depth >= left.max():
            return levels
        beyond = np.zeros(n, dtype=np.int64)
        more = np.flatnonzero(left > depth)
        beyond[more] = rank[more + depth] + 1
        key, depth = rank * (n + 2) + beyond, depth * 2


def common_prefix(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
    most = np.minimum(left[a], left[b])
    length = np.zeros(len(a), dtype=np.int64)
    for depth, rank in [*reversed(levels), *[(1, text)] * (WORD - 1)]:
        open_ = np.flatnonzero(length < most)
        same = open_[rank[a[open_] + length[open_]] == rank[b[open_] + length[open_]]]
        length[same] += depth
    return np.minimum(length, most)


def maximal_repeats(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, earlier place) of every later occurrence of a maximal repeat of LENGTH bytes or more.

    Places count through the pieces, whose order says what is earlier."""
    lengths = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(text))
    levels = suffix_ranks(text, left)
    order = np.argsort(levels[-1][1], kind="stable")
    order = order[left[order] >= LENGTH]
    if len(order) < 2:
        return (np.empty(0, np.int64),) * 3
    lcp = np.zeros(len(order), dtype=np.int64)
    lcp[1:] = common_prefix(text, levels, order[:-1], order[1:], left)
    before = np.where(order > 0, text[order - 1].astype(np.int64), -1)
    before[np.isin(order, np.concatenate([[0], ends[:-1]]))] = -1
    # Intervals of LENGTH bytes: those that extend to the left as a whole hold no maximal repeat.
    interval = np.cumsum(lcp < LENGTH) - 1
    low = np.full(interval[-1] + 1, 999)
    high = np.full(interval[-1] + 1, -2)
    np.minimum.at(low, interval, before)
    np.maximum.at(high, interval, before)
    wide = (np.bincount(interval) > 1) & ((low != high) | (low < 0))
    use = np.flatnonzero(wide[interval])
    found: list[tuple[int, int, int]] = []
    stack: list[list[int]] = []

    def join(node: list[int], place: int, byte: int) -> None:
        """The later of two earliest occurrences has its longest repeat here."""
        byte = byte if byte == node[2] else -1
        if byte < 0:
            found.append((max(node[1], place), node[0], min(node[1], place)))
        node[1], node[2] = min(node[1], place), byte

    pending = None
    for place, common, byte in zip(order[use].tolist(), np.where(lcp[use] < LENGTH, 0, lcp[use]).tolist(), before[use].tolist(), strict=True):
        if pending is not None:
            child_place, child_byte = pending
            while stack and stack[-1][0] > common:
                node = stack.pop()
                join(node, child_place, child_byte)
                child_place, child_byte = node[1], node[2]
            if common:
                if stack and stack[-1][0] == common:
                    join(stack[-1], child_place, child_byte)
                else:
                    stack.append([common, child_place, child_byte])
        pending = (place, byte)
    while stack:
        node = stack.pop()
        join(node, *pending)
        pending = (node[1], node[2])
    out = np.array(found, dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


REPEATS = "doc_id bigint, start bigint, size bigint, first_doc bigint, first_start bigint"


def _scan(pieces: DataFrame) -> DataFrame:
    """Occurrences of maximal repeats, each with an earlier occurrence."""

    def batches_of(deal: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of whole anchors, about BATCH_BYTES together, anchors of like length side by side."""
        groups, inverse = np.unique(deal, return_inverse=True)
        longest = np.zeros(len(groups), dtype=np.int64)
        np.maximum.at(longest, inverse, sizes)
        total = np.bincount(inverse, weights=sizes)
        rank = np.argsort(longest, kind="stable")
        slot = np.empty(len(groups), dtype=np.int64)
        slot[rank] = (np.cumsum(total[rank]) // BATCH_BYTES).astype(np.int64)
        order = np.argsort(slot[inverse], kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(slot[inverse][order])) + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collected = [b for b in batches if b.num_rows]
        if not collected:
            return
        rows = pa.Table.from_batches(collected)
        deal, doc, start, size = (rows.column(i).to_numpy() for i in range(4))
        no_data = rows.column(4).is_null().to_numpy()
        sure = np.flatnonzero(size < 0)
        yield _batch(REPEATS, doc[sure], start[sure], -size[sure], *[pa.nulls(len(sure), pa.int64())] * 2)
        w = np.flatnonzero(no_data & (size > 0))
        w = w[np.lexsort((start[w], doc[w], deal[w]))]
        new = np.ones(len(w), dtype=bool)
        new[1:] = deal[w][1:] != deal[w][:-1]
        first = w[np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))] if len(w) else w
        again = ~new
        yield _batch(REPEATS, doc[w][again], start[w][again], np.full(again.sum(), LENGTH), doc[first][again], start[first][again])
        f = np.flatnonzero(~no_data)
        if not len(f):
            return
        f = f[np.lexsort((start[f], doc[f]))]
        data = rows.column(4).take(pa.array(f)).to_pylist()
        for part in batches_of(deal[f], np.array([len(x) for x in data])):
            part = np.sort(part)
            place, size, earlier = maximal_repeats([data[i] for i in part.tolist()])
            begins = np.concatenate([[0], np.cumsum([len(data[i]) for i in part.tolist()])[:-1]])
            p, q = (np.searchsorted(begins, x, side="right") - 1 for x in (place, earlier))
            of, at = doc[f[part]], start[f[part]]
            yield _batch(REPEATS, of[p], at[p] + place - begins[p], size, of[q], at[q] + earlier - begins[q])

    return pieces.repartition("deal").mapInArrow(scan, REPEATS)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, repeats) of docs (doc_id, text) with different ids: doc_id, start, size of what also starts earlier, and the
    maximal repeats found between different runs with an earlier occurrence of each (null where repeats of frequent anchors
    were joined into a longer span)."""
    n_docs = docs.count()
    frequent = _frequent_anchors(docs, n_docs)
    resolved = cut_lineage(_resolve(_runs(docs, frequent), frequent), "runs")
    repeats = cut_lineage(_scan(_pieces(docs, resolved.filter(F.col("kind") != SPAN))), "repeats")
    spans = resolved.filter(F.col("kind") == SPAN).select("doc_id", "start", "size").unionByName(repeats.select("doc_id", "start", "size"))
    return spans, repeats


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = docs.join(listed, "doc_id", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                doc, text, spans = (batch.column(i)[row].as_py() for i in range(3))
                data = (text or "").encode()
                kept, runs, at = [], 0, 0
                end = -1
                for s, e in sorted((x["start"], x["start"] + x["size"]) for x in spans or ()):
                    if s > end:
                        runs += 1
                    if s > at:
                        kept.append(data[at:s])
                    at = max(at, e)
                    end = max(end, e)
                kept = b"".join([*kept, data[at:]])
                out.append((doc, len(data), len(data) - len(kept), runs, kept))
            yield _batch(CUT, *(list(c) for c in zip(*out, strict=True)))

    return joined.mapInArrow(cut, CUT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    total, known = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if total == known:
        return _cut_out(docs, repeated_spans(docs)[0])
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    numbered = cut_lineage(ordered.select(F.col("doc_id").alias("old_id"), "text", F.monotonically_increasing_id().alias("doc_id")), "numbered")
    fresh = numbered.select("doc_id", "text")
    out = _cut_out(fresh, repeated_spans(fresh)[0]).join(numbered.select("doc_id", "old_id"), "doc_id")
    return out.select(F.col("old_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


@query("op10_repeats")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
