"""Benchmark decontamination by template windows.

Numbers, units after a number, and capitalised words inside a sentence become typed placeholders, so a question asked
again with other values keeps its template. Capitalised words at the start of a sentence, number words, and units after
those can be meant either way, so a window has a hash for each reading of them. Windows of five tokens are joined by hash. A pair of document and item counts
the item's windows found anywhere in the document: those with equal values, and with them
the windows of the largest assignment that gives each value of the item one value of the document, its own where a window
with equal values holds it; one assignment for all of a pair's windows. It is reported if they are at least 80 % of the item's windows. `same_values` is true if every window found is also found with equal values.

An item needs one of its rarest windows (a fifth, and one more) in a document to reach 80 %, so only these make candidate
pairs; windows many items share do not multiply. Document windows are filtered by the benchmark's hashes, which reach the
tasks in blocks of at most BLOCK_WINDOWS, one pass each.

Windows with fewer than three literal tokens are not used. An item without a usable window is one window itself: its text must
occur in the document, but for case and white space, from token to token. Null and blank texts and items match nothing. Repeated items are reported each; repeated documents are reported once per id and text. Empty tables give
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, product
from math import prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.registry import query, table
from tagloom.session import broadcast_if_fits, cut_lineage

WINDOW, LITERALS, PERCENT = 5, 3, 80
BLOCK_WINDOWS = 2_000_000
CACHE_ENTRIES = 400_000
RUN_TOKENS = 100_000
MAX_TABLE = 100_000
# Scripts without spaces (Thai, Lao, Burmese, Khmer, Japanese, Chinese): each character is a token.
SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKENS = re.compile(rf"\d+(?:[.,]\d+)*|[{SOLID}]|[^\W\d_{SOLID}]+|[.!?\n]")
# Everything but white space, for items that are looked up whole.
PIECES = re.compile(rf"[{SOLID}]|[^\W{SOLID}]+|[^\w\s]")
# Unit words, lower case.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars "
    "euro euros cent cents pound pounds kmh mph hz khz mhz ghz kb mb gb tb w kw kwh v a j n pa bar c f k".split()
)
# Number words, lower case, without those that are articles as well.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million deux trois quatre cinq sept huit neuf dix onze douze treize quatorze "
    "quinze seize vingt trente quarante cinquante soixante cent mille zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig "
    "vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce "
    "quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split()
) - UNITS
# NUMBER and UNIT together mark a number word.
NUMBER, UNIT, CAPITAL, STOP = 1, 2, 4, 8
# Codes of the placeholders: number, unit, name.
PLACEHOLDERS = np.array([0, 0x1000000000000010, 0x2000000000000020, 0x3000000000000030], dtype=np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _TokenCodes(dict):
    """Hash of the lower-case token with its marks in the last four bits."""

    def __missing__(self, tok: str) -> int:
        low = tok.lower()
        marks = NUMBER * (tok[0].isdigit() or low in NUMBER_WORDS) | UNIT * (low in UNITS or low in NUMBER_WORDS) | CAPITAL * tok[0].isupper() | STOP * (tok in ".!?\n")
        code = xxhash.xxh3_64_intdigest(low.encode()) & ~15 | marks
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(tok) < 40:
            self[tok] = code
        return code


def _typed(token_lists: list[list[str]], codes: _TokenCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, kinds, second kinds, text number) of the tokens but stops of several texts in a row; a second kind is what a
    literal can be read as too."""
    sizes = [len(t) for t in token_lists]
    c = np.fromiter(map(codes.__getitem__, chain.from_iterable(token_lists)), dtype=np.uint64, count=sum(sizes))
    of = np.repeat(np.arange(len(sizes)), sizes)
    starts = lambda: np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.empty(0, bool)
    shifted = lambda sign: np.concatenate([[False], sign[:-1]]) if len(sign) else sign
    marks = (c & np.uint64(15)).astype(np.uint8)
    stop = (marks & STOP) > 0
    first = (shifted(stop) | starts())[~stop]
    c, marks, of = c[~stop] & ~np.uint64(15), marks[~stop], of[~stop]
    inside = ~starts()
    after = lambda sign: shifted(sign) & inside
    number, unit, word = ((marks & (NUMBER | UNIT)) == m for m in (NUMBER, UNIT, NUMBER | UNIT))
    capital = (marks & CAPITAL) > 0
    kind = np.where(number, 1, np.where(unit & after(number), 2, np.where(capital & ~first, 3, 0)))
    second = np.where(word, 1, np.where(unit & after(word), 2, np.where(capital, 3, 0)))
    return c, kind, np.where(kind == 0, second, 0), of


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _readings(c: np.ndarray, kind: np.ndarray, second: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(k, l, positions, hashes) of the usable windows read with tokens k and l of the window in their second kind; -1: first kinds."""
    n = len(c) - WINDOW + 1
    if n <= 0:
        return
    template = np.where(kind > 0, PLACEHOLDERS[kind], c)
    literal = (kind == 0).astype(np.int8)
    h, literals = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int8)
    for k in range(WINDOW):
        h += template[k : k + n] * MIX[k]
        literals += literal[k : k + n]
    literals[of[:n] != of[WINDOW - 1 :]] = 0
    at = np.flatnonzero(literals >= LITERALS)
    yield -1, -1, at, _mixed(h[at])
    double = np.flatnonzero(second)
    shift = np.zeros(len(c), dtype=np.uint64)
    shift[double] = PLACEHOLDERS[second[double]] - c[double]
    for k in range(WINDOW):
        p = double - k
        p = p[(p >= 0) & (p < n)]
        some = literals[p]
        for l in range(k, WINDOW):
            q = p[some > LITERALS] if l == k else p[(second[p + l] > 0) & (some > LITERALS + 1)]
            if len(q):
                total = h[q]
                for j in {k, l}:
                    total = total + shift[q + j] * MIX[j]
                yield k, l, q, _mixed(total)


def _slots(c: np.ndarray, kind: np.ndarray, at: np.ndarray, k: np.ndarray, l: np.ndarray) -> np.ndarray:
    """Placeholder values of windows in a reading, 0 for literals."""
    around = at[:, None] + np.arange(WINDOW)
    typed = (kind[around] > 0) | (np.arange(WINDOW) == k[:, None]) | (np.arange(WINDOW) == l[:, None])
    return np.where(typed, c[around], np.uint64(0)).view(np.int64)


def _windows(typed: tuple, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, hash, placeholder values) of every reading of the usable windows, or of the
    wanted hashes among them; values are only laid out for these."""
    c, kind, second, of = typed
    found = []
    for k, l, at, h in _readings(c, kind, second, of):
        if wanted is not None:
            some = wanted(h)
            at, h = at[some], h[some]
        found.append((at, h, np.full(len(at), k), np.full(len(at), l)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, WINDOW), np.int64)
    at, h, k, l = (np.concatenate(x) for x in zip(*found, strict=True))
    start = np.searchsorted(of, np.arange(of[-1] + 1))
    return of[at], at - start[of[at]], h, _slots(c, kind, at, k, l)


def template_windows(text: str | None, codes: _TokenCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, window hashes, placeholder values per window with 0 for literals) of the usable windows, first readings."""
    c, kind, second, of = _typed([TOKENS.findall(text or "")], codes)
    _, at, h, values = _windows((c, kind, np.zeros_like(second), of))
    return at, h, values


def readings(text: str | None, codes: _TokenCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As `template_windows`, with a further row for each other reading of a window, and the number of positions."""
    typed = _typed([TOKENS.findall(text or "")], codes)
    _, at, h, values = _windows(typed)
    return at, h, values, len(template_windows(text, codes)[0])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(list(values), pa.list_(pa.int64()))


def _item_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _TokenCodes()
        for batch in batches:
            for item, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                at, h, values, positions = readings(t, codes)
                n = pa.array([positions] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(at), pa.int64()), n, pa.array(at, pa.int64()), pa.array(h, pa.int64()), _lists(values)],
                    names=["item_id", "n_windows", "item_at", "hash", "item_values"],
                )

    return benchmark.select(F.col(item_id).cast("bigint"), text).mapInArrow(windows, "item_id bigint, n_windows bigint, item_at bigint, hash bigint, item_values array<bigint>")


def _token_runs(texts: pa.Array) -> Iterator[tuple[list[int], list[list[str]]]]:
    """(rows, their tokens): rows in runs of about RUN_TOKENS tokens, so that arrays are long but bounded by the longest text."""
    rows, tokens, size = [], [], 0
    for row in range(len(texts)):
        some = TOKENS.findall(texts[row].as_py() or "")
        rows.append(row)
        tokens.append(some)
        size += len(some)
        if size >= RUN_TOKENS:
            yield rows, tokens
            rows, tokens, size = [], [], 0
    if rows:
        yield rows, tokens


def _document_hits(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """Document windows whose hash is among `hashes` (sorted)."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _TokenCodes()
        rough = np.zeros(1 << 20, dtype=bool)
        rough[hashes & (len(rough) - 1)] = True

        def wanted(h: np.ndarray) -> np.ndarray:
            maybe = np.flatnonzero(rough[h & (len(rough) - 1)])
            return maybe[hashes[np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)] == h[maybe]]

        for batch in batches:
            for rows, tokens in _token_runs(batch.column(1)):
                text, at, h, values = _windows(_typed(tokens, codes), wanted)
                if len(at):
                    row = np.array(rows)[text]
                    key = {r: xxhash.xxh3_128_hexdigest(batch.column(1)[r].as_py().encode()) for r in set(row.tolist())}
                    columns = [batch.column(0).take(pa.array(row)), pa.array([key[r] for r in row.tolist()], pa.string()), pa.array(at, pa.int64()), pa.array(h, pa.int64()), _lists(values)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "doc_at", "hash", "doc_values"])

    return docs.mapInArrow(hits, "doc_id bigint, text_key string, doc_at bigint, hash bigint, doc_values array<bigint>")


def _whole_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, phrase) of the non-empty items without a usable window; the phrase is the item's pieces joined by spaces."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _TokenCodes()
        for batch in batches:
            rows = [(i, " ".join(PIECES.findall((t or "").lower()))) for i, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) if not len(template_windows(t, codes)[0])]
            rows = [(i, p) for i, p in rows if p]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.string())], names=["item_id", "phrase"])

    return benchmark.select(F.col(item_id).cast("bigint"), text).mapInArrow(phrases, "item_id bigint, phrase string")


def _phrase_hits(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """(doc_id, text_key, phrase) of the documents that hold a phrase, piece by piece."""
    heads: dict[str, dict[int, set[str]]] = {}
    for phrase in phrases:
        pieces = phrase.split(" ")
        heads.setdefault(pieces[0], {}).setdefault(len(pieces), set()).add(phrase)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, found = PIECES.findall((text or "").lower()), set()
                for i, piece in enumerate(pieces):
                    for n, known in heads.get(piece, {}).items():
                        phrase = " ".join(pieces[i : i + n])
                        if phrase in known:
                            found.add(phrase)
                if found:
                    key = xxhash.xxh3_128_hexdigest(text.encode())
                    rows += [(doc, key, phrase) for phrase in sorted(found)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "phrase"])

    return docs.mapInArrow(hits, "doc_id bigint, text_key string, phrase string")


def _whole_leaks(docs: DataFrame, benchmark: DataFrame, item_id: str, text: str) -> DataFrame | None:
    """The pairs of documents and items without a usable window; nothing if there are no such items."""
    items = cut_lineage(_whole_items(benchmark, item_id, text), "whole-items")
    phrases = items.select("phrase").distinct()
    blocks = -(-phrases.count() // BLOCK_WINDOWS)
    if not blocks:
        return None
    parts = []
    for b in range(blocks):
        some = [r["phrase"] for r in phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).collect()]
        parts.append(cut_lineage(_phrase_hits(docs, some).distinct(), "phrase-hits"))
    found = reduce(DataFrame.unionByName, parts).join(broadcast_if_fits(items), "phrase")
    one = F.lit(1).cast("bigint")
    return found.select("doc_id", "text_key", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(True).alias("same_values"))


def text_key(text):
    """Key of a text in the results of `contaminated`."""

    @F.arrow_udf("string")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_hexdigest((t.as_py() or "").encode()) for t in texts], pa.string())

    return key(text)


Factor = tuple[tuple[int, ...], dict[tuple, int]]


def _fixed(factors: list[Factor], a: int, x: int) -> list[Factor]:
    """The factors once value a has choice x."""
    out = []
    for scope, worth in factors:
        if a in scope:
            i = scope.index(a)
            worth = {key[:i] + key[i + 1 :]: w for key, w in worth.items() if key[i] == x}
            scope = scope[:i] + scope[i + 1 :]
        out.append((scope, worth))
    return out


def _largest(factors: list[Factor], options: dict[int, list[int]]) -> tuple[int, dict[int, int]]:
    """(worth, choice): the choice for which the factors' worths, 0 where a factor has none, add up to most.

    Values are settled one after another (variable elimination). Where each of the rest would need a table of more than
    MAX_TABLE choices, one is tried with every choice, best bound first, as long as its bound beats what was found."""
    left, settled = dict(options), []
    while left:
        around = {a: sorted({b for scope, _ in factors if a in scope for b in scope} - {a}) for a in left}
        cost = {a: prod(len(options[b]) for b in [a, *around[a]]) for a in left}
        a = min(left, key=lambda v: (cost[v], v))
        if cost[a] > MAX_TABLE and around[a]:
            break
        mine, factors = [f for f in factors if a in f[0]], [f for f in factors if a not in f[0]]
        worth, best = {}, {}
        for key in product(*(options[b] for b in around[a])):
            given = dict(zip(around[a], key, strict=True))
            sums = [sum(t.get(tuple(x if b == a else given[b] for b in scope), 0) for scope, t in mine) for x in left[a]]
            worth[key] = max(sums)
            best[key] = left[a][sums.index(worth[key])]
        factors.append((tuple(around[a]), worth))
        settled.append((a, around[a], best))
        del left[a]
    if left:
        a = max(left, key=lambda v: (sum(v in scope for scope, _ in factors), -v))
        bound = lambda fs: sum(max(0, *t.values(), 0) for _, t in fs)
        tries = sorted(((bound(f), x, f) for x in left[a] for f in [_fixed(factors, a, x)]), key=lambda t: (-t[0], t[1]))
        total, choice = -1, {}
        for limit, x, conditioned in tries:
            if limit > total:
                worth, rest = _largest(conditioned, {b: xs for b, xs in left.items() if b != a})
                if worth > total:
                    total, choice = worth, rest | {a: x}
    else:
        total, choice = sum(t.get((), 0) for _, t in factors), {}
    for a, others, best in reversed(settled):
        choice[a] = best[tuple(choice[b] for b in others)]
    return total, choice


def largest_assignment(windows: list[tuple[int, list[tuple[int, int]]]]) -> list[int]:
    """Places that count among the windows (place, slots (item value, document value)) of a document and an item.

    Windows whose values are all equal count always, and their values stand for themselves. To them come the windows that
    agree with one function from item values to document values, chosen so that their places are as many as possible, exactly.
    A place can have several windows (readings, copies with other values); it counts once.
    """
    found = {at for at, slots in windows if all(a == x for a, x in slots)}
    kept = {a for _, slots in windows if all(a == x for a, x in slots) for a, _ in slots}
    rest = [(at, dict(slots)) for at, slots in windows if at not in found and len({a for a, _ in slots}) == len(set(slots))]
    rest = [(at, slots) for at, slots in rest if all(a == x or a not in kept for a, x in slots.items())]
    options: dict[int, set[int]] = {}
    for _, slots in rest:
        for a, x in slots.items():
            options.setdefault(a, set()).add(x)
    choice = {a: min(xs) for a, xs in options.items() if len(xs) == 1}
    open_values = {a: sorted(xs) for a, xs in options.items() if len(xs) > 1}
    # What a place is worth: windows that can hold together are counted once (inclusion and exclusion).
    terms: dict[int, dict[frozenset, int]] = {}
    for at, slots in rest:
        own = frozenset((a, x) for a, x in slots.items() if a in open_values)
        place = terms.setdefault(at, {})
        if own not in place or place[own] != 1:
            more = {own: 1}
            for term, sign in place.items():
                both = term | own
                if len({a for a, _ in both}) == len(both):
                    more[both] = more.get(both, 0) - sign
            for term, sign in more.items():
                place[term] = place.get(term, 0) + sign
    counts: dict[tuple, dict[tuple, int]] = {}
    for place in terms.values():
        for term, sign in place.items():
            scope = tuple(sorted(a for a, _ in term))
            key = tuple(x for _, x in sorted(term))
            counts.setdefault(scope, {})[key] = counts.get(scope, {}).get(key, 0) + sign
    choice |= _largest(list(counts.items()), open_values)[1]
    return sorted(found | {at for at, slots in rest if all(choice[a] == x for a, x in slots.items())})


def consistent(windows):
    """Places that count among windows (item_at, slots)."""

    @F.arrow_udf("array<bigint>")
    def places(lines: pa.Array) -> pa.Array:
        found = [largest_assignment([(w["item_at"], [(s["item_values"], s["doc_values"]) for s in w["slots"]]) for w in line]) for line in lines.to_pylist()]
        return pa.array(found, pa.list_(pa.int64()))

    return places(windows)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """doc_id, text_key, item_id, n_windows, n_matched and same_values of each contaminated pair."""
    items = cut_lineage(_item_windows(benchmark, item_id, item_text), "item-windows")
    n = items.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    hits = docs.sparkSession.createDataFrame([], "doc_id bigint, text_key string, doc_at bigint, hash bigint, doc_values array<bigint>")
    for b in range(blocks):
        rows = items.filter(F.pmod("hash", F.lit(blocks)) == b).select("hash").distinct().toArrow()
        if rows.num_rows:
            # A block's hits are written before the next block's hashes are read.
            hits = hits.unionByName(cut_lineage(_document_hits(narrow, np.sort(rows["hash"].to_numpy())).distinct(), "window-hits"))
    # Repeated items are one item with several ids until the end.
    content = items.groupBy("item_id", "n_windows").agg(F.sort_array(F.collect_list(F.struct("item_at", "hash", "item_values"))).alias("w"))
    known = cut_lineage(content.groupBy("w", "n_windows").agg(F.collect_list("item_id").alias("ids")).withColumn("item", F.monotonically_increasing_id()), "items")
    windows = cut_lineage(known.select("item", "n_windows", F.explode("w").alias("w")).select("item", "n_windows", "w.*"), "items")
    spread = windows.groupBy("hash").agg(F.count_distinct("item").alias("items"))
    # A position is found by any of its readings, so all of them are keys.
    positions = windows.join(spread, "hash").groupBy("item", "n_windows", "item_at").agg(F.sum("items").alias("items"), F.collect_set("hash").alias("hashes"))
    ranked = positions.groupBy("item", "n_windows").agg(F.sort_array(F.collect_list(F.struct("items", "item_at", "hashes"))).alias("order"))
    prefix = F.slice("order", 1, (F.col("n_windows") - F.ceil(F.col("n_windows") * percent / 100) + 1).cast("int"))
    keys = ranked.select("item", F.explode(prefix).alias("k")).select("item", F.explode("k.hashes").alias("hash")).distinct()
    document = ["doc_id", "text_key"]
    candidates = hits.select(*document, "hash").distinct().join(broadcast_if_fits(keys), "hash").select(*document, "item").distinct()
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    aligned = (
        candidates.alias("c")
        .join(broadcast_if_fits(windows).alias("w"), F.col("c.item") == F.col("w.item"))
        .select("c.doc_id", "c.text_key", "c.item", "n_windows", "item_at", "hash", "item_values")
        .alias("x")
        .join(hits.alias("h"), same("x", "h") & (F.col("x.hash") == F.col("h.hash")))
        .select("x.doc_id", "x.text_key", "item", "n_windows", "item_at", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), F.arrays_zip("item_values", "doc_values").alias("v"))
    )
    slots = F.filter("v", lambda s: s["item_values"] != 0)
    lines = aligned.groupBy(*document, "item", "n_windows", "diagonal").agg(
        F.sort_array(F.collect_set(F.struct("item_at", F.size(slots).alias("size"), slots.alias("slots")))).alias("w")
    )
    # Of the readings of a window the one with the fewest slots asks for no more than the others.
    lines = lines.withColumn("w", F.filter("w", lambda x, i: (i == 0) | (F.get("w", i - 1)["item_at"] != x["item_at"])))
    lines = lines.select(*document, "item", "n_windows", F.explode("w").alias("x"))
    lines = lines.groupBy(*document, "item", "n_windows").agg(F.collect_set("x").alias("w"))
    lines = cut_lineage(lines.withColumn("slots", F.array_distinct(F.flatten("w.slots"))), "lines")
    places = lambda w: F.array_distinct(F.transform(w, lambda x: x["item_at"]))
    verbatim = places(F.filter("w", lambda x: F.forall(x["slots"], lambda s: s["item_values"] == s["doc_values"])))
    function = F.size(F.array_distinct("slots.item_values")) == F.size("slots")
    whole = lines.filter(function).withColumn("found", places(F.col("w")))
    parted = lines.filter(~function).withColumn("found", consistent(F.col("w")))
    counted = whole.unionByName(parted).withColumn("n_matched", F.size("found").cast("bigint"))
    pairs = counted.select(*document, "item", "n_windows", "n_matched", (F.col("n_matched") == F.size(verbatim)).alias("same_values"))
    leaks = pairs.filter(F.col("n_matched") * 100 >= F.col("n_windows") * percent)
    leaks = leaks.join(known.select("item", "ids"), "item").select(*document, F.explode("ids").alias("item_id"), "n_windows", "n_matched", "same_values")
    whole = _whole_leaks(narrow, benchmark, item_id, item_text)
    return leaks if whole is None else leaks.unionByName(whole)


def without(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are in no contaminated pair."""
    bad = broadcast_if_fits(leaks.select(F.col("doc_id").alias("leak_id"), F.col("text_key").alias("leak_key")).distinct())
    keyed = docs.withColumn("leak_text_key", text_key(F.col(text)))
    return keyed.join(bad, F.col(doc_id).eqNullSafe(F.col("leak_id")) & (F.col("leak_text_key") == F.col("leak_key")), "left_anti").drop("leak_text_key")


@query("op7_templates")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
