"""Secret scans: known forms, and windows of high entropy."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skeinwork.llm.common import core, tidy

KINDS = ("assign", "access", "hex", "entropy")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + f"|{_either('api')}_?{_either('key')}"
ASSIGN = re.compile(f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Every hex or access match lies in such a run.
RUN = re.compile("[A-Za-z0-9+/_=-]{20,}")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Character classes, each with its window and the bits a character that a window needs.
CLASSES = {
    "hex": (re.compile("[0-9a-fA-F]{20,}"), 20, 3.0),
    "base64": (re.compile("[A-Za-z0-9+/_=-]{24,}"), 24, 3.9),
}
#: What looks random and is no secret: UUIDs, numbers, words and names without digits, placeholders, runs of the alphabet.
ALLOWED = re.compile(
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9+/_=-]+|[A-Za-z+/_=-]+"
    "|.*(?:example|sample|placeholder|changeme|your[_-]?(?:key|token|secret)|x{6}|abcdefgh|12345678).*",
    re.IGNORECASE,
)


def entropy_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of all windows whose Shannon entropy is at least bits.

    The sum of c * log2(c) over the counts c is kept as one character leaves and one enters,
    so a window costs the same whatever its width.
    """
    n = len(text)
    if n < window:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, most = 0.0, window * (math.log2(window) - bits) + 1e-9
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        total += weight[k + 1] - weight[k] if k < window else 0.0
        counts[c] = k + 1
        if i >= window - 1:
            start = i - window + 1
            if total <= most:
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
            out = text[start]
            k = counts[out]
            total += weight[k - 1] - weight[k]
            counts[out] = k - 1
    return spans


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    runs = list(RUN.finditer(text))
    for run in runs:
        at, s = run.start(), run[0]
        for kind, form in (("access", ACCESS), ("hex", HEX)):
            found += [(at + m.start(), at + m.end(), kind) for m in form.finditer(s) if m.end() - m.start() >= LEAST[kind]]
    added: list[tuple[int, int]] = []
    for run in runs:
        at, s = run.start(), run[0]
        if ALLOWED.fullmatch(s):
            continue
        for form, window, bits in CLASSES.values():
            for m in form.finditer(s):
                for a, b in entropy_windows(m[0], window, bits):
                    piece = m[0][a:b]
                    if not ALLOWED.fullmatch(piece):
                        added.append((at + m.start() + a, at + m.start() + b))
    spans: list[tuple[int, int]] = []
    for a, b in sorted(added):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    found += [(a, b, "entropy") for a, b in spans if not any(x <= a and b <= y for x, y, _ in found)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text in batch.column(1):
            found = find_secrets(text.as_py() or "")
            base = [x for x in found if x[2] != "entropy"]
            listed, all_ = (",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in (base, found))
            for n, kind in enumerate(KINDS[:3]):
                out[n].append(sum(x[2] == kind for x in base))
            out[3].append(hashlib.sha256(listed.encode()).hexdigest())
            out[4].append(all_)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row, in one pass without a shuffle.

    Known forms are found first. Then each run of key characters is a candidate; in each
    character class a window slides over it, and windows of high entropy, merged, are added
    as spans of kind `entropy` unless the allow-list has them or a known form covers them.
    A null text counts as empty: no spans and the digest of the empty string. Rows that repeat
    give repeated results, an empty table none, other columns of docs aren't read; a text's
    work and memory are in proportion to its length.
    """
    return core(docs).mapInArrow(tidy(_scan), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
