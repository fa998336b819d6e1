"""Token ids in files of fixed-width bit packing.

A file image holds the ids of a run of documents: a header, the starts of the
documents, the offsets of the blocks, then blocks of BLOCK ids in the least bits
that the vocabulary needs.  Blocks begin at whole bytes, so any run of ids is read
by unpacking the blocks that it touches, with numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.ids import default_tokenizer, encoder
from loomwork.llm.ordered import identified_by_size, in_blocks, with_start
from loomwork.sized import join_small
from loomwork.storage import checkpointed, written

MAGIC = 0x3150424C
BLOCK = 4096
END = 2
#: Ids in one image; a longer run of documents becomes several.
IMAGE = 2_000_000
_HEAD = np.dtype([("magic", "<u4"), ("width", "<u2"), ("block", "<u2"), ("n_docs", "<u8"), ("n_ids", "<u8")])


def width_of(vocabulary: int) -> int:
    """The least bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in so many bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    """The first n ids of packed data."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def image(docs: list[tuple[int, np.ndarray]], width: int) -> bytes:
    """The file image of documents: doc_id and ids of each, in order."""
    ids = np.concatenate([x for _, x in docs])
    head = np.zeros(1, _HEAD)
    head[0] = (MAGIC, width, BLOCK, len(docs), len(ids))
    blocks = [pack(ids[at : at + BLOCK], width) for at in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *(len(x) for _, x in docs)]).astype("<u8")
    offsets = np.cumsum([0, *(len(b) for b in blocks)]).astype("<u8")
    return b"".join([head.tobytes(), np.array([d for d, _ in docs], "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Image:
    """Reads a file image: its documents, and any run of ids without unpacking the rest."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.width, self.block, n, self.n_ids = int(head["width"]), int(head["block"]), int(head["n_docs"]), int(head["n_ids"])
        at = _HEAD.itemsize
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.starts = np.frombuffer(data, "<u8", n + 1, at := at + 8 * n).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self._body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, counted in this image."""
        first, last = start // self.block, -(-stop // self.block)
        parts = [
            unpack(self._body[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.width)
            for b in range(first, last)
        ]
        found = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return found[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _writing(path: str, end: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        width = width_of(enc.vocabulary)
        block, part, docs, size = None, 0, [], 0

        def flushed() -> Iterator[pd.DataFrame]:
            if docs:
                yield pd.DataFrame({"block": [block], "part": [part], "n_docs": [len(docs)], "n_ids": [size], "image": [image(docs, width)]})

        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = batch.iloc[at : at + 512]
                for of, doc_id, ids in zip(rows["block"], rows["doc_id"], enc.ids(list(rows["text"])), strict=True):
                    if of != block or size >= IMAGE:
                        yield from flushed()
                        part = part + 1 if of == block else 0
                        block, docs, size = of, [], 0
                    docs.append((doc_id, np.append(ids, np.array([end], ids.dtype))))
                    size += len(ids) + 1
        yield from flushed()

    return write


def write_files(documents: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """The images of all documents, written to the shared folder: block, part, n_docs, n_ids, image.

    Images follow one another by (block, part) in the order of doc_id.  Spark's
    writer commits them, so that a lost executor leaves no half of a file.
    """
    rows = in_blocks(*identified_by_size(documents)).mapInPandas(
        _writing(tokenizer or default_tokenizer(), end), "block long, part int, n_docs long, n_ids long, image binary"
    )
    return written(rows, "tokens")


def _reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start, data in zip(batch["start"], batch["image"], strict=True):
            one = Image(data)
            yield pd.DataFrame({
                "doc_id": one.doc_ids,
                "start": one.starts[:-1] + start,
                "n_tokens": np.diff(one.starts),
                "ids_crc32": [zlib.crc32(one.document(k).astype("<u4").tobytes()) for k in range(len(one.doc_ids))],
            })


def read_files(images: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the images alone."""
    sizes = checkpointed(images.groupBy("block").agg(F.sum("n_ids").alias("n")))
    starts = with_start(sizes, "n").select("block", F.col("start").alias("before"))
    parts = checkpointed(images.select("block", "part", "n_ids"))
    earlier = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select("block", "part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("within"))
    where = starts.join(inner, "block").select("block", "part", (F.col("before") + F.col("within")).alias("start"))
    # one row for each image of up to IMAGE ids; the images themselves aren't shuffled
    return join_small(images, checkpointed(where), ["block", "part"]).mapInPandas(_reading, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of all documents, reads them back and gives doc_id, start, n_tokens, ids_crc32 of each.

    A null or empty text is the end id alone.  Documents are ordered by doc_id,
    repeated ids by text; repeated rows are written again and rows without a doc_id
    are left out.  Columns other than doc_id and text are not read.  An empty table
    gives an empty result.
    """
    return read_files(write_files(documents, tokenizer))
