"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A fingerprint links to another at `max_distance` or fewer differing bits. Two
such fingerprints agree in at least `BANDS - max_distance` of `BANDS` equal bit
bands, so every choice of that many bands is a shard key: linked fingerprints
meet in at least one shard. A shard holds one BK-tree, and a look-up follows
only the edges within the radius. No tree over all fingerprints has a size
bound, so instead of sending every tree to every task, each tree is built in
the task to which the shuffle brings its shard's look-ups.

A shard that grows past `shard_rows` fingerprints is not kept: its rows are
dealt again by finer bands of the bits not yet fixed, until the bits left bound
a shard by themselves. Links leave a shard as a spanning forest, never as all
pairs, and the forests are joined by `components`.

Defined results: a null or blank text has fingerprint 0 and links like any
other; copies share one fingerprint and are compared once; rows without doc_id
belong to components as others do and are named by the least doc_id there, null
if there is none; repeated rows are returned as often as they come; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, materialise, packed, row_key

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
#: Bands of the first dealing; each finer dealing cuts the bits left into as many again.
BANDS = 4
#: Fingerprints of a shard that one task keeps; a larger shard is dealt again.
SHARD_ROWS = 4096
_SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text: a bit is set when set in over half the shingle hashes."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxh64_intdigest(b" ".join(tokens), _SEED)
    total = len(tokens) - words + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        part = tokens[start : start + _CHUNK + words - 1]
        hashes = np.fromiter(
            (xxh64_intdigest(b" ".join(s), _SEED) for s in zip(*(part[i:] for i in range(words)))), np.uint64
        )
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp): `fp` is the fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
                ["doc_id", "text_hash", "fp"],
            )

        return work

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return map_rows(rows, "doc_id long, text_hash long, fp long", make)


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_and_add(self, value: int, radius: int) -> list[int]:
        """Nodes within `radius` of a new value, which is then added."""
        values, children, found = self.values, self.children, []
        if values:
            stack = [0]
            while stack:
                node = stack.pop()
                d = (values[node] ^ value).bit_count()
                if d <= radius:
                    found.append(node)
                edges = children[node]
                for edge in range(d - radius, d + radius + 1):
                    if edge in edges:
                        stack.append(edges[edge])
            node = 0
            while True:
                d = (values[node] ^ value).bit_count()
                if d not in children[node]:
                    children[node][d] = len(values)
                    break
                node = children[node][d]
        values.append(value)
        children.append({})
        return found


def shard_links(shard: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one shard's distinct fingerprints."""
    tree, root, links = BKTree(), [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(shard):
        root.append(i)
        for j in tree.near_and_add(value, radius):
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((value, shard[j]))
    return links


def levels(radius: int = MAX_DISTANCE, bands: int = BANDS, shard_rows: int = SHARD_ROWS) -> list[list[int]]:
    """For each dealing, the masks of fixed bits, one for each shard key.

    The last dealing fixes so many bits that a shard cannot hold more than
    about `shard_rows` distinct values, or 16 bits are left.
    """
    out: list[list[int]] = []
    fixed, left = [0], [list(range(64))]
    while True:
        masks, rests = [], []
        for mask, free in zip(fixed, left):
            cuts = [list(x) for x in np.array_split(free, bands)]
            for chosen in combinations(range(bands), bands - radius):
                masks.append(mask | sum(1 << int(b) for i in chosen for b in cuts[i]))
                rests.append([b for i in range(bands) if i not in chosen for b in cuts[i]])
        fixed, left = masks, rests
        out.append(masks)
        if max(map(len, left)) <= max(16, shard_rows.bit_length() - 1):
            return out


def _deal(values: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): a row of every fingerprint for every mask of one dealing."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    options = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    return values.select("fp", F.explode(options).alias("o")).select("o.mask", "o.key", "fp")


def _links(dealt: DataFrame, masks: list[list[int]], level: int, radius: int, shard_rows: int) -> DataFrame:
    """(mask, key, a, b): links have mask null; rows of shards too large, dealt again, have b null."""
    last = level + 1 == len(masks)
    per = len(masks[level + 1]) // len(masks[level]) if not last else 0
    finer = None if last else [m - (1 << 64) if m >> 63 else m for m in masks[level + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[int] = []
        held, large = None, False
        out: list[tuple] = []

        def deal_again(m: int, values: list[int]) -> None:
            for i in range(m * per, (m + 1) * per):
                out.extend((i, v & finer[i], v, None) for v in values)

        def close() -> None:
            nonlocal shard, large
            if held is not None:
                if large:
                    deal_again(held[0], shard)
                elif len(shard) > 1:
                    values = [v & (2**64 - 1) for v in shard]
                    signed = lambda v: v - (1 << 64) if v >> 63 else v
                    out.extend((None, None, signed(a), signed(b)) for a, b in shard_links(values, radius))
            shard, large = [], False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["mask", "key", "a", "b"])

        for batch in batches:
            mask, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(fp):
                continue
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = [0, *edge.tolist()]
            for start, end in zip(starts, [*starts[1:], len(fp)]):
                name = (int(mask[start]), int(key[start]))
                if name != held:
                    close()
                    held = name
                shard.extend(fp[start:end].tolist())
                if not last and len(shard) > shard_rows:
                    large = True
                    deal_again(held[0], shard)
                    shard = []
                if len(out) >= 50_000:
                    yield batch_of(out)
                    out = []
        close()
        yield batch_of(out)

    sorted_rows = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return sorted_rows.mapInArrow(run, "mask int, key long, a long, b long")


def near_duplicates(
    documents: DataFrame,
    words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of `documents(doc_id, text)`."""
    docs = materialise(fingerprints(documents, words), "simhash")
    values = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = materialise(values, "simhash-values")
    masks = levels(max_distance, max(BANDS, max_distance + 2), shard_rows)
    dealt, links = _deal(distinct, masks[0]), None
    for level in range(len(masks)):
        found = materialise(_links(dealt, masks, level, max_distance, shard_rows), "simhash-links")
        pairs = found.where("b is not null").select("a", "b")
        links = pairs if links is None else links.union(pairs)
        dealt = found.where("b is null").select("mask", "key", F.col("a").alias("fp"))
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(least, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    names = distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), F.col("linked").isNotNull().alias("linked")
    )
    return docs.join(names, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(documents: DataFrame, words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id.

    Rows without doc_id stay only for a group that has no doc_id at all; rows
    that repeat doc_id and text count once.
    """
    groups = near_duplicates(documents, words, max_distance)
    # a group without any doc_id is named by its least fingerprint's text
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    nameless = groups.where("component_id is null").groupBy("fp").agg(F.min("text_hash").alias("text_hash"))
    keys = first.select(row_key("doc_id", "text_hash").alias("_key")).union(
        nameless.select(row_key(F.lit("~"), "text_hash").alias("_key"))
    )
    keyed = packed(documents, _key=row_key("doc_id", F.xxhash64("text").cast("string")))
    kept = keyed.join(keys.distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select("_row.*")
