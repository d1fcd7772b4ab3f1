"""Folds over arrays whose cost grows with the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items walked through at a time.  Spark copies a fold's whole state at every step, so one that gathers all it sees is
#: quadratic; here a state holds the numbers of one block, or one small state per block.
BLOCK = 256

State = dict[str, Column]


def sweep(items: Column | str, zero: State, step: Callable[[Column, Column, Column], tuple[State, Column, Column]]) -> Column:
    """Walk through an array with a small state and note a number for some of the items, as ``array<bigint>``.

    ``step(state, item, index)`` gives the next state, whether to note anything, and the number.  The first walk finds the
    state at the beginning of each block, the second notes the numbers of each block from there.
    """
    items = F.col(items) if isinstance(items, str) else items
    names = list(zero)
    numbers = F.expr("cast(array() as array<bigint>)")

    def struct(state: State) -> Column:
        return F.struct(*[state[n].alias(n) for n in names])

    def block(number: Column) -> Column:
        part = F.slice(items, number * BLOCK + 1, F.lit(BLOCK))
        return F.transform(part, lambda item, i: F.struct(item.alias("item"), (number * BLOCK + i).alias("index")))

    def walk(state: Column, number: Column) -> Column:
        return F.aggregate(block(number), state, lambda s, x: struct(step(s, x["item"], x["index"])[0]))

    def note(state: Column, number: Column) -> Column:
        def merge(s: Column, x: Column) -> Column:
            following, wanted, value = step(s, x["item"], x["index"])
            noted = F.when(wanted, F.concat(s["noted"], F.array(value.cast("bigint")))).otherwise(s["noted"])
            return F.struct(*[following[n].alias(n) for n in names], noted.alias("noted"))

        start = F.struct(*[state[n].alias(n) for n in names], numbers.alias("noted"))
        return F.aggregate(block(number), start, merge, lambda s: s["noted"])

    first = struct(zero)
    every = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    begun = F.aggregate(
        every,
        F.struct(first.alias("state"), F.slice(F.array(first), F.lit(1), F.lit(0)).alias("states")),
        lambda s, number: F.struct(walk(s["state"], number).alias("state"), F.concat(s["states"], F.array(s["state"])).alias("states")),
        lambda s: s["states"],
    )
    return F.when(F.size(items) > 0, F.flatten(F.transform(begun, note))).otherwise(numbers)


def match_places(text: Column, pattern: str) -> Column:
    """``array<struct<start, end>>``: the byte ranges of all matches, in order.

    The pieces between matches and the matches alternate, so places are running totals of their byte lengths.
    """
    regex = F.lit(pattern)
    size = lambda piece: F.octet_length(piece).cast("bigint")
    lengths = F.zip_with(
        F.split(text, regex, -1),
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda gap, hit: F.struct(size(gap).alias("gap"), size(hit).alias("hit")),
    )

    def step(state: Column, piece: Column, index: Column) -> tuple[State, Column, Column]:
        start = state["at"] + piece["gap"]
        return {"at": start + F.coalesce(piece["hit"], F.lit(0).cast("bigint"))}, piece["hit"].isNotNull(), start

    def places(lengths: Column) -> Column:
        starts = sweep(lengths, {"at": F.lit(0).cast("bigint")}, step)
        return F.transform(starts, lambda start, i: F.struct(start.alias("start"), (start + F.get(lengths, i)["hit"]).alias("end")))

    return F.get(F.transform(F.array(lengths), places), F.lit(0))
