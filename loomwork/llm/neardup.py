"""Near-duplicate documents by HyperMinHash.

Each distinct shingle set gets REGISTERS registers.  A register holds the least
hash of the set under its own permutation in 16 bits: the count of leading zeros
(6 bits) and the mantissa that follows (10 bits).  Bands of ROWS registers bring
candidates together; the registers estimate their Jaccard similarity, less the
matches that compression makes by chance; what may reach the threshold is
confirmed on the full sets.

A band that thousands of texts share never becomes all its pairs.  Each set is
first compared with one centre of its bands: the set that meets most others, which
in a group of copies is the text they were made from.  Only bands that still hold several components are compared in
full, inside blocks of bounded size, across components only, and a block gives a
spanning forest of its links.  Pairs never become rows, but one for each node and
round; a node's set is joined once to each place where it is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shingles import set_name, shingle_set
from loomwork.sized import join_small
from loomwork.storage import checkpointed, written

ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Rows and shingles of one side of a block (a longer set has a block of its own).
BLOCK, BLOCK_SHINGLES = 512, 2**19
#: Rows with registers that a task compares (with sets a fourth of them): these tasks cost time rather than bytes.
TASK_ROWS = 8192
#: Rounds in which sets meet centres before blocks compare the rest.
STARS = 1
#: Estimates deviate by about 0.04; pairs under the threshold by four times that are not confirmed.
SLACK = 0.16

_rng = np.random.default_rng(71993)
_FACTOR = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_LEVEL = 2.0 ** -np.arange(0, 62)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, (_FACTOR[:, None] * part[None, :] + _SHIFT[:, None]).min(axis=1), out=least)
    fraction, bits = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - bits, 0, 63)
    mantissa = np.clip((fraction * 2 - 1) * 2**MANTISSA, 0, 2**MANTISSA - 1)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers that two unrelated sets of n and m shingles have alike."""
    def at_level(k: np.ndarray) -> np.ndarray:  # chance that the least of k hashes has its first one-bit there
        k = np.asarray(k, np.float64)[..., None]
        return (1 - _LEVEL[1:]) ** k - (1 - _LEVEL[:-1]) ** k

    return (at_level(n) * at_level(m)).sum(axis=-1) * 2.0**-MANTISSA


def estimate(same: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of registers alike, corrected for collisions."""
    by_chance = chance(n, m)
    return np.clip((same - by_chance) / (1 - by_chance), 0, 1)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "set_id": [set_name(s) for s in sets],
            "registers": [registers(s).astype("<u2").tobytes() if len(s) else b"" for s in sets],
        })


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (equal for equal sets) and registers of every document that has a doc_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.where("doc_id IS NOT NULL").mapInPandas(
        _signed, "doc_id long, n_shingles long, set_id binary, registers binary"
    )


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of texts, as bytes; a text of another set than set_id names (the doc_id came twice) gives no row."""
    for batch in batches:
        found = [shingle_set(t) for t in batch["text"]]
        same = np.array([set_name(s) == bytes(name) for s, name in zip(found, batch["set_id"], strict=True)], bool)
        yield batch.assign(set=[s.astype("<u8").tobytes() for s in found]).loc[same, ["node", "registers", "set"]]


def _likely(one: np.ndarray, two: np.ndarray, threshold: float) -> bool:
    """Whether registers and sizes let two sets reach the threshold."""
    n, m = np.array([one[1]]), np.array([two[1]])
    return bool(estimate(np.array([(one[0] == two[0]).mean()]), n, m)[0] >= threshold - SLACK)


def _linked(both: np.ndarray, n: np.ndarray, m: np.ndarray | int, threshold: float) -> np.ndarray:
    """Whether intersections of so many shingles reach the threshold, in whole numbers."""
    return (both > 0) & (100 * both >= round(threshold * 100) * (n + m - both))


def _against_centre(threshold: float):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by centre and part, the centre's own row first; gives the links of the others to it."""
        key, held, marks = None, None, None
        for batch in batches:
            out = []
            for centre, part, member, node, regs, raw in zip(*(batch[c] for c in ("centre", "part", "member", "node", "registers", "set")), strict=True):
                found, mine = np.frombuffer(raw, "<u8"), np.frombuffer(regs, "<u2")
                if not member:
                    key, held, marks = (centre, part), found, mine
                elif key == (centre, part) and _likely((marks, len(held)), (mine, len(found)), threshold):
                    both = np.intersect1d(held, found, assume_unique=True).size
                    if _linked(np.array(both), np.array(len(held)), len(found), threshold):
                        out.append((min(centre, node), max(centre, node)))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return confirm


def _confirmed(stars: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the stars (node, centre), as links (a, b), those whose full sets reach the threshold.

    A centre's set is joined once for each BLOCK of its nodes, not once a pair.
    """
    sizes = checkpointed(stars.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = join_small(stars, sizes, "centre").select("centre", mine.alias("part"), F.lit(True).alias("member"), "node")
    centres = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("centre").alias("node"))
    places = checkpointed(members.unionByName(centres))
    rows = join_small(sets, places, "node")
    dealt = rows.repartition(-(-places.count() // (TASK_ROWS // 4)) or 1, "centre", "part").sortWithinPartitions("centre", "part", "member")
    return dealt.select("centre", "part", "member", "node", "registers", "set").mapInPandas(_against_centre(threshold), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: each node of the links (a, b) with the least node it can reach.

    Labels fall to the least neighbour's label and then jump to their label's
    label, until none changes; each round is checkpointed.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        step = lower.join(jump, "to", "left").select(
            "node", F.least("to", F.coalesce("beyond", "to")).alias("label"), "was"
        )
        step = checkpointed(step)
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open_bands(members: DataFrame) -> DataFrame:
    """The rows of members whose band still holds more than one component."""
    several = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return join_small(members, checkpointed(several.select("band")), "band", "left_semi")


def _stars(members: DataFrame, tested: DataFrame | None, round_: int, threshold: float) -> DataFrame:
    """node, centre: for each node the centre of another component that it shares most bands with.

    A band's centre is at first the node that meets most others, later any.  Pairs of
    tested and those whose sizes are too unlike are left out.
    """
    per_cent = round(threshold * 100)
    rank = F.col("meets") if round_ == 0 else F.xxhash64(F.lit(round_), "node")
    centres = members.groupBy("band").agg(F.max(F.struct(rank.alias("rank"), "node", "label", "n")).alias("c"))
    met = members.join(checkpointed(centres), "band").where("label <> c.label")
    met = met.where(F.least("n", "c.n") * 100 >= per_cent * F.greatest("n", "c.n")).select("node", F.col("c.node").alias("centre"))
    pairs = met.groupBy("node", "centre").agg(F.count("*").alias("bands"))
    if tested is not None:
        pairs = pairs.join(tested, ["node", "centre"], "left_anti")
    best = pairs.groupBy("node").agg(F.max(F.struct("bands", "centre")).alias("c"))
    return best.select("node", "c.centre")


class _Joined:
    """Union-find over a block's components."""

    def __init__(self):
        self._up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self._up.get(x, x)) != x:
            self._up[x] = x = self._up.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.root(x), self.root(y)
        self._up[x] = y
        return x != y


def _forest(block: Block, threshold: float) -> list[tuple[int, int]]:
    """Links of one block between home and minor rows that join different components, as few as join them.

    Intersections of a minor set with all home sets are counted over the home sets'
    sorted shingles.
    """
    is_home, node, label = block["home"], block["node"], block["label"]
    sets = [np.frombuffer(raw, "<u8") for raw in block["set"]]
    n = np.array([len(s) for s in sets], np.int64)
    home, out, joined = np.flatnonzero(is_home), [], _Joined()
    if not len(home):
        return out
    shingles = np.concatenate([sets[k] for k in home])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(home)), n[home])[order]
    for k in np.flatnonzero(~is_home):
        low = np.searchsorted(shingles, sets[k], "left")
        many = np.searchsorted(shingles, sets[k], "right") - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(home))
        linked = home[_linked(both, n[home], n[k], threshold) & (label[home] != label[k])]
        for h in linked[np.unique(label[linked], return_index=True)[1]]:
            if joined.join(int(label[h]), int(label[k])):
                out.append((min(node[h], node[k]), max(node[h], node[k])))
    return out


Block = dict[str, np.ndarray]


def _by_block(work, columns: list[str]):
    """work for each block of rows sorted by (band, i, j); the last block of a batch waits for the rest of it."""
    def done(parts: list[Block]) -> list[tuple]:
        return work(parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[Block] = []
        of = None
        for batch in batches:
            if not len(batch):
                continue
            rows, out = {c: batch[c].to_numpy() for c in batch.columns}, []
            key = np.stack([rows["band"], rows["i"], rows["j"]], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if waiting and of != tuple(key[x]):
                    out += done(waiting)
                    waiting = []
                waiting.append({c: v[x:y] for c, v in rows.items()})
                of = tuple(key[x])
            yield pd.DataFrame(out, columns=columns, dtype="int64")
        if waiting:
            yield pd.DataFrame(done(waiting), columns=columns, dtype="int64")

    return blocks


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of members in blocks (band, i, j): home (all rows of the band) and minor ones (all but those of the largest component).

    Every pair of different components meets in one block of its band.  A block has
    about BLOCK rows and BLOCK_SHINGLES shingles a side, so that no task holds a whole band.
    """
    sizes = checkpointed(members.groupBy("band", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n")))
    per_band = sizes.groupBy("band").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "label", "n")).alias("major"))
    blocks = lambda k, n: F.greatest(F.ceil(k / BLOCK), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    per_band = checkpointed(per_band.where("major.k < k").select(
        "band", F.col("major.label").alias("major"), blocks(F.col("k"), F.col("n")).alias("nb"),
        blocks(F.col("k") - F.col("major.k"), F.col("n") - F.col("major.n")).alias("mb"),
    ))
    rows = join_small(members, per_band, "band")
    mix = F.xxhash64("node", "band")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    home = rows.select("band", "at", "node", "label", F.lit(True).alias("home"), F.pmod(mix, F.col("nb")).cast("int").alias("i"), each("mb").alias("j"))
    minor = rows.where("label <> major").select(
        "band", "at", "node", "label", F.lit(False).alias("home"), each("nb").alias("i"), F.pmod(mix, F.col("mb")).cast("int").alias("j")
    )
    return checkpointed(home.unionByName(minor))


def _promising(block: Block, threshold: float) -> list[tuple[int, int]]:
    """band and node of the rows of one block that may reach the threshold with another, by their registers.

    Two sets may share several bands; they meet in the first of these only.
    """
    per_cent = round(threshold * 100)
    is_home = block["home"]
    regs = np.frombuffer(b"".join(block["registers"]), "<u2").reshape(-1, REGISTERS)
    n, label, at_band = block["n"], block["label"], block["at"]
    home, found = np.flatnonzero(is_home), np.zeros(len(is_home), bool)
    for k in np.flatnonzero(~is_home):
        fits = (label[home] != label[k]) & (np.minimum(n[home], n[k]) * 100 >= per_cent * np.maximum(n[home], n[k]))
        rows = home[fits]
        if len(rows):
            same = regs[rows] == regs[k]
            first = same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == at_band[k]
            likely = first & (estimate(same.mean(axis=1), n[rows], np.full(len(rows), n[k])) >= threshold - SLACK)
            found[rows[likely]] = True
            found[k] |= likely.any()
    return list(zip(block["band"][found].tolist(), block["node"][found].tolist(), strict=True))


def _rest(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the components that share a band, as a spanning forest of each block.

    Registers are compared first; only rows that have a likely partner in a band are
    dealt out again with their sets.
    """
    def sorted_blocks(payload: DataFrame, dealt: DataFrame, rows: int) -> DataFrame:
        order = ["band", "i", "j"]
        return join_small(payload, dealt, "node").repartition(-(-dealt.count() // rows) or 1, *order).sortWithinPartitions(*order)

    first = sorted_blocks(nodes.select("node", "n", "registers"), _dealt(members), TASK_ROWS)
    likely = first.mapInPandas(_by_block(lambda block: _promising(block, threshold), ["band", "node"]), "band long, node long")
    likely = checkpointed(likely.distinct())
    rows = sorted_blocks(sets.select("node", "set"), _dealt(members.join(likely, ["band", "node"])), TASK_ROWS // 4)
    return rows.mapInPandas(_by_block(lambda block: _forest(block, threshold), ["a", "b"]), "a long, b long").distinct()


def _nodes(signed: DataFrame) -> DataFrame:
    """set_id, node (a number of its own for each set), first (its least doc_id), n, registers of the distinct sets."""
    sets = written(
        signed.where("n_shingles > 0").groupBy("set_id")
        .agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.min("registers").alias("registers")),
        "sets",
    )
    seed = 0
    while True:
        nodes = sets.withColumn("node", F.xxhash64(F.lit(seed), "set_id"))
        if nodes.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            return nodes
        seed += 1


def near_duplicates(documents: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of documents that has a doc_id.

    Two documents are linked when their sets of five-word shingles have Jaccard
    similarity of the threshold or more; component_id is the least doc_id that
    links reach and kept marks the row that stays.  A null or empty text, or one
    of white space only, has no shingles and is linked with nothing.  Rows with
    equal texts fall together; rows of one doc_id with different texts are documents
    of their own.  Rows without a doc_id are left out.  Repeated rows give repeated
    rows.  Columns other than doc_id and text are not read.  An empty table gives an
    empty result.
    """
    signed = written(signatures(documents), "signatures")
    nodes = _nodes(signed)
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(registers, b * {2 * ROWS} + 1, {2 * ROWS})))")
    banded = nodes.select("node", "n", F.posexplode(keys).alias("at", "band"))
    shared = checkpointed(banded.groupBy("band").agg(F.count("*").alias("k")).where("k > 1"))
    members = written(join_small(banded, shared, "band"), "bands")
    meets = members.groupBy("node").agg(F.sum("k").alias("meets"))
    members = written(members.drop("k").join(meets, "node"), "members")
    wanted = checkpointed(nodes.join(members.select("node").distinct(), "node", "left_semi").select("first", "node", "set_id", "registers"))
    texts = documents.select(F.col("doc_id").cast("long").alias("first"), F.col("text").cast("string").alias("text"))
    sets = join_small(texts, wanted, "first").mapInPandas(_sets, "node long, registers binary, set binary")
    if not signed.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])  # repeated rows
    sets = written(sets, "candidates")

    links, labels, tested = None, None, None
    for round_ in range(STARS + 1):
        open_ = written(_open_bands(_labelled(members, labels)), "open")
        if open_.isEmpty():
            break
        if round_ < STARS:
            stars = checkpointed(_stars(open_, tested, round_, threshold))
            tested = stars if tested is None else tested.union(stars)
            found = _confirmed(stars, sets, threshold)
        else:
            found = _rest(open_, nodes, sets, threshold)
        links = checkpointed(found if links is None else links.union(found))
        labels = components(links)

    named = _labelled(nodes.select("set_id", "node", "first"), labels)
    least = named.groupBy("label").agg(F.min("first").alias("component"))
    named = written(named.join(least, "label").select("set_id", "component"), "named")
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
