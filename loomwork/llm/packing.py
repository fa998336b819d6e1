"""Packing token sequences in order, by dynamic programming over cuts.

The ids of a block of consecutive documents stand in one row.  Cuts may fall at
ends of documents, at ends of sentences and, where a sentence is longer than a
window, inside it.  A cut inside a document costs a truncation penalty, an
unfilled window its padding; the cheapest cuts come from one pass with a monotone
queue over the cuts that a window can begin at.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.ids import default_tokenizer, encoder
from loomwork.llm.ordered import identified_by_size, in_blocks

WINDOW = 2048
END = 1
#: Cost of a cut at the end of a sentence and inside one, in tokens of padding.
SENTENCE, INSIDE = 6, 24
#: Cuts inside a sentence stand so many tokens apart.
STRIDE = 128
#: A block of documents has about so many bytes of text, and so some hundred windows.
BLOCK_BYTES = 2**20
#: Windows are numbered inside their block; a block has fewer than this.
NUMBERS = 2**24


def cuts(place: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices of the chosen cuts, ascending, the first and last place included.

    place: ascending distinct places, from 0 to the end, no two neighbours more than
    a window apart.  Least is the sum of window - length over all windows and of the
    penalties of the cuts; of equal choices the earlier start wins.
    """
    where, price = place.tolist(), (penalty + window).tolist()
    n = len(where)
    # key: the least cost up to a cut and its place, which is what the windows and cuts up to it cost
    key, came = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # ascending places with rising key
    for j in range(1, n):
        while where[j] - where[queue[0]] > window:
            queue.popleft()
        came[j] = i = queue[0]
        key[j] = at = key[i] + price[j]
        while queue and key[queue[-1]] > at:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return np.array(out[::-1])


def candidates(sizes: np.ndarray, ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the cuts in consecutive documents, and their penalties; 0 is the first.

    sizes: tokens of each piece of text; ends, last: whether a sentence, and a
    document, ends with it.
    """
    at = np.flatnonzero(ends & (sizes > 0) | last)
    place = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[at]])
    cost = np.concatenate([[0], np.where(last[at], 0, SENTENCE)])
    long = np.flatnonzero(np.diff(place) > 2 * STRIDE)
    hard = [np.arange(place[k] + STRIDE, place[k + 1], STRIDE) for k in long]
    cost = np.concatenate([cost, *[np.full(len(h), INSIDE) for h in hard]])
    place = np.concatenate([place, *hard])
    order = np.argsort(place, kind="stable")
    return place[order], cost[order]


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def packed_block(block: int, docs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple]:
    """Rows of one block.  docs: doc_id, ids without the end id, tokens of each piece of text and whether a sentence ends with it."""
    starts = np.cumsum([0, *(len(ids) + 1 for _, ids, _, _ in docs)])
    raw = np.concatenate([x for _, ids, _, _ in docs for x in (ids, [END])]).astype("<u4").tobytes()
    sizes = np.concatenate([x for _, _, sizes, _ in docs for x in (sizes, [1])])
    ends = np.concatenate([x for _, _, _, ends in docs for x in (ends, [True])])
    last = np.zeros(len(sizes), bool)
    last[np.cumsum([len(sizes) + 1 for _, _, sizes, _ in docs]) - 1] = True
    place, penalty = candidates(sizes, ends, last)
    edges = place[cuts(place, penalty)].tolist()
    rows, w = [], 0
    for (doc_id, _, _, _), s, e in zip(docs, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = s
        while at < e:
            while edges[w + 1] <= at:
                w += 1
            upto = min(e, edges[w + 1])
            rows.append((
                doc_id, at - s, upto - at, zlib.crc32(raw[4 * at : 4 * upto]), e - s, block * NUMBERS + w, at - edges[w],
            ))
            at = upto
    return rows


def _packing(path: str):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        block, docs = None, []

        def flushed() -> Iterator[pd.DataFrame]:
            if docs:
                yield pd.DataFrame(packed_block(block, docs), columns=_COLUMNS)

        for batch in batches:
            for of, doc_id, found in zip(batch["block"], batch["doc_id"], enc.encode(batch["text"]), strict=True):
                if of != block:
                    yield from flushed()
                    block, docs = of, []
                docs.append((doc_id, *found))
        yield from flushed()

    return pack


def packed(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents stand in the order of doc_id (repeated ids by text), each as its ids
    and the end id; a null or empty text is the end id alone.  Windows hold at most
    WINDOW ids and never cross a block, which holds BLOCK_BYTES of texts, so that
    blocks are packed in parallel and only their last windows have more padding.
    Rows without a doc_id are left out; repeated rows are packed again.  Columns other
    than doc_id and text are not read.  An empty table gives an empty result.
    """
    rows = in_blocks(*identified_by_size(documents, BLOCK_BYTES))
    return rows.mapInPandas(_packing(tokenizer or default_tokenizer()), _OUT)
