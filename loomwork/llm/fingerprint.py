"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text becomes a set of paragraph digests.  Each digest is added to HASHES cells of
a table; a cell keeps the count, the xor of its digests and the xor of their
checks.  The tables of two versions subtract cell by cell: what both have cancels,
and peeling cells that hold a single digest recovers what differs.  If peeling
gets stuck the table was too small, and both are built again larger: first as large as
the least digests of both suggest, then twice as large each time.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomwork.llm.ordered import identified_by_size, in_blocks, with_next_block
from loomwork.llm.shingles import mixed
from loomwork.sized import join_small
from loomwork.storage import checkpointed

HASHES = 3
CELLS = 24
#: A paragraph is a line; long lines are cut at ends of sentences, and what is still long after words whose hash says so.
_PIECE = re.compile(r"[^\n.!?]*[\n.!?]*")
_LONG = 60
_WORDS = re.compile(r"\S+\s*|\s+")
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
_CHECK = np.uint64(0x082EFA98EC4E6C89)
_PARTS = np.arange(HASHES)[:, None]
_ONE, _MINUS = np.uint64(1), ~np.uint64(0)


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text; joined they give the text again."""
    out: list[str] = []
    for piece in _PIECE.findall(text):
        if len(piece) <= _LONG:
            if piece:
                out.append(piece)
            continue
        part: list[str] = []
        size = 0
        for word in _WORDS.findall(piece):
            part.append(word)
            size += len(word)
            if size >= 24 and xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % 4 == 0 or size >= 4 * _LONG:
                out.append("".join(part))
                part, size = [], 0
        if part:
            out.append("".join(part))
    return out


def digests(text: str) -> np.ndarray:
    """The distinct 64-bit digests of a text's paragraphs; the k-th copy of a paragraph has a digest of its own."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen[p] = seen.get(p, -1) + 1
        out.append(xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"), seed=k))
    return np.unique(np.array(out, np.uint64))


def _places(found: np.ndarray, cells: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The cells of each digest in its table, which has so many cells from start on: one in each of HASHES equal parts."""
    part = cells // HASHES
    within = mixed(found ^ _SEEDS[:, None]) % part.astype(np.uint64)
    return (within.astype(np.int64) + _PARTS * part + start).ravel()


def _filled(found: np.ndarray, cells: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((3, size), np.uint64)
    at = _places(found, cells, start)
    out[0] = np.bincount(at, minlength=size)
    np.bitwise_xor.at(out[1], at, np.tile(found, HASHES))
    np.bitwise_xor.at(out[2], at, np.tile(mixed(found ^ _CHECK), HASHES))
    return out


def table(found: np.ndarray, cells: int) -> np.ndarray:
    """The sketch of a set of digests: rows of (count, xor of digests, xor of checks)."""
    every = np.full(len(found), cells)
    return _filled(found, every, np.zeros_like(every), cells)


def subtract(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sketch of what differs; counts are signed by wrapping."""
    return np.stack([one[0] - two[0], one[1] ^ two[1], one[2] ^ two[2]])


def peel(difference: np.ndarray, owner: np.ndarray, cells: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Peels tables that stand side by side, all at once.

    owner: the table of each cell; cells, start: of each table.  Gives the
    digests found, their tables, whether they are of the first version, and which tables got stuck.
    """
    count, digest, check = difference.copy()
    out: list[tuple] = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))]
    for _ in range(HASHES * int(cells.max(initial=0)) + 1):
        single = np.flatnonzero((count == _ONE) | (count == _MINUS))
        single = single[mixed(digest[single] ^ _CHECK) == check[single]]
        if not len(single):
            break
        found, of, sign = digest[single], owner[single], count[single]
        order = np.lexsort((found, of))  # a digest may be alone in several of its cells
        found, of, sign = found[order], of[order], sign[order]
        new = np.r_[True, (found[1:] != found[:-1]) | (of[1:] != of[:-1])]
        found, of, sign = found[new], of[new], sign[new]
        out.append((found, of, sign == _ONE))
        at = _places(found, cells[of], start[of])
        np.subtract.at(count, at, np.tile(sign, HASHES))
        np.bitwise_xor.at(digest, at, np.tile(found, HASHES))
        np.bitwise_xor.at(check, at, np.tile(mixed(found ^ _CHECK), HASHES))
    stuck = np.zeros(len(cells), bool)
    stuck[owner[(count != 0) | (digest != 0) | (check != 0)]] = True
    return *(np.concatenate(x) for x in zip(*out, strict=True)), stuck


def _next_size(one: np.ndarray, two: np.ndarray) -> int:
    """Cells of the second try: from the share that the least digests of both have in common."""
    a, b = one[:12].tolist(), two[:12].tolist()
    both = set(a) & set(b)
    least = sorted({*a, *b})[:12]
    alike = sum(x in both for x in least) / len(least) if least else 1.0
    unlike = (len(one) + len(two)) * (1 - alike) / (1 + alike)
    return CELLS + HASHES * math.ceil(0.5 * max(unlike, abs(len(one) - len(two))))


def published(sets: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """The sketches of many sets side by side, each of so many cells."""
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    start = np.repeat(np.arange(len(sets)) * cells, [len(s) for s in sets])
    return _filled(every, np.full(len(every), cells), start, len(sets) * cells)


def differences(
    ones: list[np.ndarray], twos: list[np.ndarray], cells: int = CELLS, sketches: tuple[np.ndarray, np.ndarray] | None = None
) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each pair of digest sets: the digests only in one, those only in two, and the cells that it took.

    The first sketches have so many cells, as published fingerprints do (sketches: these, if
    they are made already).  Those that get stuck are filled again from the sets with more;
    another size has other places, so that no digests share their cells for ever.
    """
    out: list = [None] * len(ones)
    size = np.full(len(ones), cells, np.int64)
    todo = np.arange(len(ones))
    made = sketches or (published(ones, cells), published(twos, cells))
    while len(todo):
        now = size[todo]
        start = np.cumsum(now) - now
        found, of, first, stuck = peel(subtract(*made), np.repeat(np.arange(len(todo)), now), now, start)
        order = np.argsort(of, kind="stable")
        found, of, first = found[order], of[order], first[order]
        ends = np.searchsorted(of, np.arange(len(todo) + 1))
        for k in np.flatnonzero(~stuck):
            mine, side = found[ends[k] : ends[k + 1]], first[ends[k] : ends[k + 1]]
            out[todo[k]] = (mine[side], mine[~side], int(now[k]))
        again = size[todo[0]] == cells and (now == cells).all()
        todo = todo[stuck]
        if not len(todo):
            break
        size[todo] = [max(2 * size[i], _next_size(ones[i], twos[i])) if again else 2 * size[i] for i in todo]
        now = size[todo]
        start = np.cumsum(now) - now
        made = []
        for sets in (ones, twos):
            of = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
            made.append(_filled(np.concatenate([sets[i] for i in todo]), now[of], start[of], int(now.sum())))
    return out


def likeness(n_one: int, only_one: np.ndarray, only_two: np.ndarray) -> float:
    """The share of digests that two texts have in common, of those that either has; 1 for two empty texts."""
    both = n_one - len(only_one)
    every = both + len(only_one) + len(only_two)
    return both / every if every else 1.0


def as_text(t: np.ndarray) -> str:
    """A sketch as text: counts in 32 bits, digests and checks in 64, in base64."""
    return base64.b64encode(t[0].astype("<u4").tobytes() + t[1].astype("<u8").tobytes() + t[2].astype("<u8").tobytes()).decode()


def fingerprint(found: np.ndarray, cells: int = CELLS) -> str:
    """The published sketch of a set of digests, as text."""
    return as_text(table(found, cells))


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by the first as many code points of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, n_changed long, cells long"


_BATCH = 256


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, then doc_id; the last row of each block (guest) is the first of the next block."""
    columns = [c.split()[0] for c in _OUT.split(", ")]

    def rows(pairs: list[tuple]) -> pd.DataFrame:
        texts = [edited(p[1], p[3]) for p in pairs]
        own, changed, after = [p[2] for p in pairs], [digests(t) for t in texts], [p[4] for p in pairs]
        mine, theirs, next_ = published(own), published(changed), published(after)
        edits, nexts = differences(own, changed, sketches=(mine, theirs)), differences(own, after, sketches=(mine, next_))
        of = lambda every, k: as_text(every[:, k * CELLS : (k + 1) * CELLS])
        return pd.DataFrame([
            (
                p[0], len(p[1]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), of(mine, k), of(theirs, k),
                likeness(len(p[2]), e[0], e[1]), likeness(len(p[2]), x[0], x[1]), len(p[2]), len(e[0]) + len(e[1]), e[2],
            )
            for k, (p, t, e, x) in enumerate(zip(pairs, texts, edits, nexts, strict=True))
        ], columns=columns)

    last, pairs = None, []
    for batch in batches:
        for block, doc_id, text, guest in zip(batch["block"], batch["doc_id"], batch["text"], batch["guest"], strict=True):
            own = digests(text)
            if last is not None and last[0] == block:
                pairs.append((*last[1:], text, own))
                if len(pairs) >= _BATCH:
                    yield rows(pairs)
                    pairs = []
            last = None if guest else (block, doc_id, text, own)
    if pairs:
        yield rows(pairs)


def fingerprints(documents: DataFrame) -> DataFrame:
    """One row for each row of documents that has a doc_id: its fingerprint, that of its edited text and their likeness.

    A null text counts as empty.  Texts follow one another by (doc_id, text), the
    first after the last, so repeated ids and repeated rows have a fixed order
    too; a single document follows itself.  Rows without a doc_id have no place in
    the order and are left out.  Columns other than doc_id and text are not read.
    An empty table gives an empty result.  near_edited and near_next are the
    share of paragraph digests in common: 1 for two empty texts.
    """
    rows, n_blocks = identified_by_size(documents)
    blocks = checkpointed(rows.groupBy("block").agg(F.min("doc_id").alias("first")))
    following = with_next_block(blocks.select("block"))
    guests = following.join(blocks.select(F.col("block").alias("next_block"), F.col("first").alias("doc_id")), "next_block")
    guests = checkpointed(guests.select(F.col("block").alias("of"), "doc_id"))
    first = join_small(rows, guests, "doc_id")  # one id for each block: texts aren't shuffled for it
    first = first.groupBy("of", "doc_id").agg(F.min("text").alias("text"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(
        first.select(F.col("of").alias("block"), "doc_id", "text", F.lit(True).alias("guest"))
    )
    return in_blocks(every, n_blocks, "guest", "doc_id", "text").mapInPandas(_compared, _OUT)
