"""Sharding by histogram sort with DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id, id), so equal texts are neighbours.  For the boundaries of the
shards the driver proposes probe keys, one aggregation counts the exact bytes between neighbouring probes, and the
probes close in until each boundary meets the tolerance; then rows are exchanged once.  A boundary is first sought
between texts, and only a group of equal texts too large for that is cut, by the hash of the id.

Law: ``bytes`` — shard sizes are as near to equal as the tolerance and whole documents allow.

Defined cases: a null text counts as empty (one byte with its terminator); null ids and repeated rows are placed like
any other row, identical rows in adjacent slots; an empty table gives no rows; the other columns ride along, and one
that has the name of an output column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored, text_or_empty

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Probes per boundary and round.
PROBES = 24
#: Part of a shard's size by which a boundary may miss its target.
TOLERANCE = 0.001
#: Bits of the text hash and of the id hash that cut a shard into the pieces rows are numbered in.
TEXT_BITS, ID_BITS = 5, 7

KEY = ["_h", "_g"]


def keyed(documents: DataFrame) -> DataFrame:
    """Keys beside the columns of ``documents``, which are renamed by position so that no name can clash and so that a
    caller who drops the text does not shuffle it."""
    return documents.select(
        *[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(documents.columns)],
        F.crc32(text_or_empty()).alias("_crc"),
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("_size"),
        F.xxhash64(text_or_empty()).alias("_h"),
        F.xxhash64("doc_id").alias("_g"),
    )


def _interval(key: Column, probes: list[int]) -> Column:
    """How many of the sorted probes are at or below the key, as a binary search in one expression."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(probes[middle]), part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(probes))


def _search(keys: DataFrame, column: str, targets: list[float], tolerance: float) -> list[dict]:
    """For each target byte count: a ``cut`` (keys below it are below the boundary), or ``at``, the one key value that
    the target falls into, with the bytes ``below`` it, its ``bytes`` and its ``rows``."""
    brackets = [{"low": LOW, "high": HIGH + 1, "below": 0, "target": t} for t in targets]
    open_ = list(brackets)
    while open_:
        probes = sorted({b["low"] + (b["high"] - b["low"]) * i // (PROBES + 1) for b in open_ for i in range(PROBES + 2)})
        probes = [p for p in probes if LOW < p <= HIGH]
        rows = keys.groupBy(_interval(F.col(column), probes).alias("at")).agg(
            F.sum("_size").alias("bytes"), F.count("*").alias("rows"), F.min(column).alias("least"), F.max(column).alias("most")
        )
        found = {r["at"]: r for r in rows.collect()}  # at most (PROBES + 2) x boundaries + 1 rows
        for b in open_:
            running = 0
            for at in sorted(found):
                r = found[at]
                if running + r["bytes"] > b["target"] or at == max(found):
                    break
                running += r["bytes"]
            # the target falls into interval `at`: its edges are the least key there and the least key after it
            edges = [(running, r["least"]), (running + r["bytes"], r["most"] + 1)]
            missed, cut = min((abs(bytes_ - b["target"]), key) for bytes_, key in edges)
            if missed <= tolerance:
                b["cut"] = cut
            elif r["least"] == r["most"]:
                b |= {"at": r["least"], "below": running, "bytes": r["bytes"], "rows": r["rows"]}
            else:
                b |= {"low": r["least"], "high": r["most"] + 1}
        open_ = [b for b in open_ if "cut" not in b and "at" not in b]
    return brackets


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Sorted boundaries ``(text hash, id hash)``: a row belongs to the shard whose number of boundaries at or below
    its key it has."""
    total = keys.agg(F.sum("_size")).first()[0] or 0
    if not total:
        return []
    allowed = tolerance * total / shards
    found = _search(keys, "_h", [total * k / shards for k in range(1, shards)], allowed)
    cuts = [(b["cut"], LOW) for b in found if "cut" in b]
    for group in sorted({b["at"] for b in found if "at" in b}):
        inside = [b for b in found if b.get("at") == group]
        within = inside[0]
        if within["rows"] == 1:
            ends = [{"at": LOW, "below": 0, "bytes": within["bytes"], "target": b["target"] - b["below"]} for b in inside]
        else:
            ends = _search(keys.filter(F.col("_h") == group), "_g", [b["target"] - b["below"] for b in inside], allowed)
        for e in ends:
            if "cut" in e:
                cuts.append((group, e["cut"]))
            elif e["target"] - e["below"] < e["bytes"] / 2:  # one document (or its exact repeats) stays whole
                cuts.append((group, e["at"]))
            else:
                cuts.append((group, e["at"] + 1) if within["rows"] > 1 else (group + 1, LOW))
    return sorted(cuts)


def shard_documents(documents: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of ``documents`` plus ``size, text_crc32, law, shard, slot, grown_shard``; slots count from 0
    without gaps in each shard."""
    rows = keyed(documents)
    keys = stored(rows.select("_h", "_g", "_size"), "shard_keys")
    shard = F.lit(0)
    for h, g in splitters(keys, shards, tolerance):
        above = F.lit(h <= HIGH)
        if h <= HIGH:
            above = (F.col("_h") > h) | ((F.col("_h") == h) & (F.col("_g") >= g if g <= HIGH else F.lit(False)))
        shard = shard + above.cast("int")
    piece = [
        shard.alias("_shard"),
        F.shiftright("_h", 64 - TEXT_BITS).cast("int").alias("_text_piece"),
        F.shiftright("_g", 64 - ID_BITS).cast("int").alias("_id_piece"),
    ]
    names = ["_shard", "_text_piece", "_id_piece"]
    # at most 2^(TEXT_BITS + ID_BITS) pieces a shard: a bounded table to number and to broadcast
    sizes = keys.select(*piece).groupBy(*names).count()
    before = F.expr(
        "sum(count) over (partition by _shard order by _text_piece, _id_piece rows between unbounded preceding and current row) - count"
    )
    offsets = sizes.select(*names, before.alias("_before"))
    numbered = rows.select("*", *piece).select(
        "*", F.expr("row_number() over (partition by _shard, _text_piece, _id_piece order by _h, _g, _size)").alias("_number")
    )
    placed = numbered.join(F.broadcast(offsets), names)
    out = {
        "size": F.col("_size"),
        "text_crc32": F.col("_crc"),
        "law": F.lit("bytes"),
        "shard": F.col("_shard"),
        "slot": (F.col("_before") + F.col("_number") - 1).cast("long"),
        "grown_shard": F.lit(None).cast("int"),
    }
    kept = [F.col(f"_in_{i}").alias(c) for i, c in enumerate(documents.columns) if c not in out]
    return placed.select(*kept, *[value.alias(name) for name, value in out.items()])
