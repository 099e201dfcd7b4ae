"""Packing token sequences by best-two-fit."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import core, kept_until_released, stored, tidy

LENGTH = 4096
END_ID = 1
#: Pieces that one packing task gets; a group of them wastes less than one sequence more than all would.
PACKED_TOGETHER = 16384
#: Bytes of runs and their ids that a worker keeps, and what an entry costs beside them.
KEPT_BYTES, ENTRY = 1 << 25, 200


class WordTokenizer:
    """Ids of a text by a tokenizers file whose words are lower-cased and end-marked.

    Lower case and blanks let a text be read as blank-separated runs, and each distinct run is
    split and merged once. A run of Latin letters, digits and ASCII signs is merged in
    tiktoken's core with the end mark as the byte 0xFF, which UTF-8 never holds; a text with
    any other run goes through tokenizers itself, whole.
    """

    OTHER = re.compile("[^\\x21-\\x7e¡¿ß-öø-ÿ]|<[|]")
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in w.removesuffix("</w>")) + b"\xff" * w.endswith("</w>"): i for w, i in vocab.items() if w not in special}
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.runs: dict[str, bytes | None] = {}
        self.held = 0

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        runs = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.runs
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            if self.held > KEPT_BYTES:
                known.clear()
                self.held = 0
            for run in set(runs).difference(known):
                ids = None if self.OTHER.search(run) else self._merged(run)
                known[run] = ids
                self.held += len(run) + len(ids or b"") + ENTRY
            if all(known[run] is not None for run in runs):
                return b"".join(map(known.__getitem__, runs))
        except TypeError:  # a run that isn't merged here
            pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _merged(self, run: str) -> bytes:
        ids = [i for word in self.SPLIT.findall(run) for i in self.merge(word.encode() + b"\xff")]
        return struct.pack(f"<{len(ids)}I", *ids)


_loaded: dict[str, WordTokenizer] = {}


def _forget_runs() -> None:
    for tok in _loaded.values():
        if tok:
            tok.runs.clear()
            tok.held = 0


kept_until_released(_forget_runs)


def _pieces(path: str, length: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded.setdefault(path, None) or _loaded.__setitem__(path, WordTokenizer(path)) or _loaded[path]
        end = np.uint32(END_ID).tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.ids(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    for k, v in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        out[k].append(v)
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in out], list(out))

    return cut


def best_two_fit(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    A bin is filled greedily, largest item that fits first. Then its smallest item makes way
    for the two unpacked items that fill the expanded gap best, if they fill it better.
    Items are held by length: a bit set of the lengths left finds the largest that fits.
    """
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1]:
        stacks.setdefault(int(lengths[i]), []).append(int(i))
    left = sum(1 << n for n in stacks)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal left
        i = stacks[n].pop()
        if not stacks[n]:
            del stacks[n]
            left &= ~(1 << n)
        return i

    def largest(most: int) -> int:
        return (left & ((1 << (most + 1)) - 1)).bit_length() - 1

    b = 0
    while left:
        gap, inside = size, []
        while (n := largest(gap)) > 0:
            inside.append((n, take(n)))
            gap -= n
        if gap and left:
            last = inside[-1][0]
            room, best = gap + last, (last, 0, 0)
            x = largest(room - 1)
            while x > 0 and 2 * x >= best[0] and best[0] < room:
                y = min(largest(room - x), x)
                if y == x and len(stacks[x]) < 2:
                    y = largest(x - 1)
                if y > 0 and x + y > best[0]:
                    best = (x + y, x, y)
                x = largest(x - 1)
            if best[1]:
                n, i = inside.pop()
                stacks.setdefault(n, []).append(i)
                left |= 1 << n
                inside += [(best[1], take(best[1])), (best[2], take(best[2]))]
        at = 0
        for n, i in inside:
            bins[i], offsets[i] = b, at
            at += n
        b += 1
    return bins, offsets


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and the end id; only those longer than a sequence are cut. Pieces of
    full length are sequences of their own; all others are dealt evenly over packing tasks by
    the hash of their row, so no key can be hot, and packed there by best-two-fit.
    A null or empty text is one piece that holds the end id. Rows that repeat a doc_id are
    packed as documents of their own, an empty table gives no rows, other columns of docs
    aren't read.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = core(docs).mapInArrow(tidy(_pieces(tokenizer, length, with_ids)), kinds)
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    short = pieces.filter(F.col("length") < length)
    groups = max(1, -(-short.count() // PACKED_TOGETHER))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), length)
        return pd.DataFrame({"row": pdf["row"], "sequence_id": (pdf["part"].to_numpy().astype(np.int64) << 32) + bins, "offset": offsets})

    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part")
    light = short.select("row", "doc_id", "piece", "start", "length", "ids_crc32", part)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, row long"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.drop(columns=["part"]).assign(**pack(pdf).drop(columns=["row"]))[[x.split()[0] for x in schema.split(", ")]]

    # By range: part numbers are few, and hashes of few numbers meet.
    packed = light.repartitionByRange(groups, "part").groupBy("part").applyInPandas(whole, schema)
    full = pieces.filter(F.col("length") == length).select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "row")
    out = packed.unionByName(full)
    if with_ids:
        out = out.join(pieces.select("row", "ids"), "row")
    return out.drop("row")
