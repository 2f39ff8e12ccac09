"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: ASCII white space; everything between is a word.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once, also where lambdas inside `body` use it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


SCAN_BLOCK = 256


def running(values: Column, zero: int, merge: Callable[[Column, Column], Column]) -> Column:
    """Running results of `merge` over an array of bigint, each element included; `zero` is its neutral value.

    Blocks are summed first and scanned from their own start, so the work stays near the array's length."""

    def scan(items: Column, start: Column) -> Column:
        first = F.array(start).cast("array<bigint>")
        steps = F.aggregate(items, first, lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x)).cast("array<bigint>")))
        return F.slice(steps, 2, F.size(items))

    def block(array: Column, i: Column) -> Column:
        return F.slice(array, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))

    neutral = F.lit(zero).cast("bigint")

    def blocks(array: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / SCAN_BLOCK).cast("int"))
        totals = F.transform(numbers, lambda i: F.aggregate(block(array, i), neutral, lambda acc, x: merge(acc, x).cast("bigint")))
        return let(scan(totals, neutral), lambda ends: F.flatten(F.transform(numbers, lambda i: scan(block(array, i), F.coalesce(F.get(ends, i - 1), neutral)))))

    nothing = F.array().cast("array<bigint>")
    return let(F.coalesce(values, nothing).cast("array<bigint>"), lambda array: F.when(F.size(array) == 0, nothing).otherwise(blocks(array)))


def matches_of(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value): code points, `end` exclusive, `value` of a group.

    The text between matches and the matches themselves add up to the positions."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def placed(whole: Column, values: Column, gaps: Column) -> Column:
        lengths = F.transform(whole, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        ends = lambda e: F.transform(
            whole, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), F.get(values, i).alias("value"))
        )
        return let(running(lengths, 0, lambda a, b: a + b), ends).cast("array<struct<start:bigint,end:bigint,value:string>>")

    def found(whole: Column) -> Column:
        values = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        place = let(values, lambda v: let(F.split(text, pattern, -1), lambda gaps: placed(whole, v, gaps)))
        return F.when(F.size(whole) == 0, none).otherwise(place)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


CHUNK = 2000


def chunks_of(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that reading a range costs its own length."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters start..end of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((end - 1) / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(part, (start % CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")
