"""Sharding by histogram sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.common import pick, stored

#: Bytes of a key: hash of the text, doc_id, row.
WIDTH = 24
#: Probes of the first round for each splitter, and keys drawn from an unresolved interval.
PROBES, DRAWN = 32, 64
#: A splitter is met within this part of a shard's bytes.
TOLERANCE = 0.001
ROUNDS = 24
#: Rows between two boundaries at most: what one task orders.
CELL_ROWS = 1_000_000


def _part(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def _key() -> Column:
    """Equal texts are neighbours; the row tells repeated rows apart, so any group can be split."""
    flip = F.lit(-(1 << 63))
    return F.unhex(F.concat(_part(F.xxhash64(F.coalesce("text", F.lit("")))), _part(F.coalesce("doc_id", F.lit((1 << 63) - 1)).bitwiseXOR(flip)), _part(F.col("row"))))


def _as_keys(ints: list[int]) -> np.ndarray:
    return np.array([x.to_bytes(WIDTH, "big") for x in ints], dtype=f"S{WIDTH}")


def _keys(column) -> np.ndarray:
    flat = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    start = flat.offset
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[start : start + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(f"S{WIDTH}") if len(flat) else np.zeros(0, f"S{WIDTH}")


def _counter(probes: np.ndarray):
    """Exact bytes, rows, smallest and largest key between neighbouring probes, of a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = [None] * n, [None] * n
        for batch in batches:
            keys, size = _keys(batch.column(0)), batch.column(1).to_numpy()
            cell = np.searchsorted(probes, keys, side="right")
            np.add.at(total, cell, size)
            np.add.at(rows, cell, 1)
            order = np.lexsort((keys, cell))
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            for first, last in zip(at, [*at[1:], len(order)]):
                c, a, b = cell[order[first]], _full(keys[order[first]]), _full(keys[order[last - 1]])
                low[c] = a if low[c] is None else min(low[c], a)
                high[c] = b if high[c] is None else max(high[c], b)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(rows[some]), pa.array([low[i] for i in some], pa.binary()), pa.array([high[i] for i in some], pa.binary())], ["cell", "bytes", "rows", "low", "high"])

    return count


def _full(key: bytes) -> bytes:
    return bytes(key).ljust(WIDTH, b"\0")


def find_splitters(light: DataFrame, shards: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Boundaries, rows between them, the boundaries that split shards, rounds' sizes.

    Each round counts the exact bytes below every candidate boundary in one pass over key and
    size. Where a splitter lies between two candidates and neither meets the tolerance, the
    next round's candidates are keys drawn from that interval (an expected DRAWN of them), so
    a group of equal texts is entered as fast as any other. Intervals of more than CELL_ROWS
    rows are cut in the same way. The driver sees one row per interval and the drawn keys only.
    """
    cached = light.select("key", "size")
    total_rows = light.count()
    each = max(PROBES, -(-total_rows // (shards * CELL_ROWS)))
    n = shards * each
    probes = [(1 << (8 * WIDTH)) * i // n for i in range(1, n)]
    rounds = []
    for turn in range(ROUNDS):
        got = cached.mapInArrow(_counter(_as_keys(probes)), "cell int, bytes long, rows long, low binary, high binary")
        cells = {r["cell"]: r for r in got.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
        rows = [cells[i]["rows"] if i in cells else 0 for i in range(len(probes) + 1)]
        size = [cells[i]["bytes"] if i in cells else 0 for i in range(len(probes) + 1)]
        rounds.append(len(probes))
        total, below = sum(size), [0]
        for s in size:
            below.append(below[-1] + s)
        chosen, open_ = [], []
        for j in range(1, shards):
            goal = total * j / shards
            c = max(i for i in range(len(size)) if below[i] <= goal)
            gap = (goal - below[c], below[c + 1] - goal)
            splits = c in cells and cells[c]["rows"] > 1 and turn < ROUNDS - 1
            if min(gap) > TOLERANCE * total / shards and splits:
                open_.append(c)
            chosen.append(c if gap[0] <= gap[1] or c == len(probes) else c + 1)
        open_ += [c for c, r in cells.items() if r["rows"] > CELL_ROWS]
        if not open_:
            # Boundary c is the c-th probe; 0 and the last stand for the ends.
            return probes, rows, [min(max(c, 1), len(probes)) - 1 for c in chosen], rounds
        fresh: set[int] = set()
        wanted = F.lit(False)
        for c in sorted(set(open_)):
            r = cells[c]
            fresh |= {int.from_bytes(r["low"], "big") + 1, int.from_bytes(r["high"], "big")}
            share = max(DRAWN, 2 * r["rows"] / CELL_ROWS) / r["rows"]
            drawn = F.abs(F.xxhash64("key", F.lit(turn))) <= min((1 << 63) - 1, int(share * (1 << 63)))
            wanted = wanted | (F.col("key").between(F.lit(bytes(r["low"])), F.lit(bytes(r["high"]))) & drawn)
        fresh |= {int.from_bytes(r["key"], "big") for r in cached.select("key").filter(wanted).collect()}
        probes = sorted(set(probes) | fresh)
    raise AssertionError("unreachable")


def _assigner(probes: np.ndarray, shard: np.ndarray, base: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.searchsorted(probes, _keys(batch.column(batch.schema.get_field_index("key"))), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(shard[cell]), pa.array(base[cell])], [*batch.schema.names, "cell", "shard", "base"])

    return assign


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs; shards hold near equal bytes.

    Rows are ordered by (hash of text, doc_id, row), splitters are found by histogram sort and
    rows are exchanged once, into the cells between all counted boundaries; a row's slot is
    the exact number of rows of its shard in the cells before plus its place in its own, so no
    task orders a whole shard. size is the text's UTF-8 bytes plus 1; a null text has size 1
    and the checksum of no bytes. Equal texts are neighbours; a group of them is split only
    where a splitter needs it. Repeated rows get a slot each, a null doc_id comes last among
    equal texts, an empty table gives no rows, other columns of docs aren't read.
    """
    light = docs.select(pick(docs, "doc_id", "long").alias("doc_id"), pick(docs, "text", "string").alias("text"), F.monotonically_increasing_id().alias("row"))
    light = light.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), _key().alias("key"))
    light = stored(light, "shard-keys")
    probes, rows, chosen, _ = find_splitters(light, shards)
    shard_of, base, s, filled = [], [], 0, 0
    for cell, n in enumerate(rows):
        while s < len(chosen) and cell > chosen[s]:
            s, filled = s + 1, 0
        shard_of.append(s)
        base.append(filled)
        filled += n
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema)
    assign = _assigner(_as_keys(probes), np.array(shard_of, np.int32), np.array(base, np.int64))
    placed = light.mapInArrow(assign, f"{kept}, cell int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("key"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + place - 1).cast("long").alias("slot"))
