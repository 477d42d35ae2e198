"""Near-duplicate documents by DartMinHash.

A document is a weighted set: its five-word shingles with their counts. For every
element there is a fixed random scatter of darts on a plane of weight and rank,
one dart per unit of area on average. A document throws the darts that fall below
its weights and below a rank bound chosen so that about ``k (log k + 3)`` of them
land; a dart belongs to one of ``k`` coordinates, and each coordinate keeps its
earliest dart. Two documents keep the same dart in a coordinate with a chance that
is their weighted Jaccard similarity. The work is of the order of shingles plus
darts, not of shingles times coordinates.

Signatures are cut into bands. All documents that share a band are compared exactly, two
by two and each two once, whatever else is known of them, so no link between two texts of
one band is lost. Bands of few documents become pairs that meet their shingles in joins.
Bands of more are cut into blocks: a task holds two blocks with their shingles and compares
them, leaves out what another large band of the same two documents compares, and gives
every document its number of links and one document it is connected with, so a family of
m near copies leaves no m * m rows. Connected components of the similar pairs are the classes. Only the bands themselves leave anything to
chance: two texts at the threshold of 0.8 share none with a chance of 0.003.

Only narrow rows are shuffled: identifiers, bands, and the shingles of documents
that are in candidate pairs. Documents with equal words are one before banding.

Defined results: texts without words are equal only if the texts are; texts of one
to four words are one shingle; a null text is empty; repeated rows are copies;
rows with a null doc_id are classed with the others, and a class of only such rows
has a null class_id; extra columns are ignored; an empty table gives an empty
result. Different words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import mix, ranges
from fieldtally.llm.tokens import word_hashes
from fieldtally.sources.staging import stage, stage_in_batches, unstage

WORDS = 5
BANDS = 32
ROWS = 8
#: Shingles and darts worked on at once in a worker.
CHUNK = 60_000
#: Texts that are on their way to a worker at once.
BATCH_ROWS = 1_000
#: Cumulative chances of 0, 1, 2, ... darts in a cell of unit area.
POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(20)])


def shingles(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of five words, and their number for each text. A text of
    fewer words is one shingle, one without words has none."""
    counts = np.where(lengths >= WORDS, lengths - WORDS + 1, np.minimum(lengths, 1))
    starts = np.repeat(np.cumsum(lengths) - lengths, counts)
    at = ranges(np.cumsum(lengths) - lengths, counts)
    span = np.repeat(np.minimum(lengths, WORDS), counts)
    words = values.view(np.uint64) if values.dtype == np.int64 else values
    result = np.zeros(len(at), dtype=np.uint64)
    for step in range(WORDS):
        inside = step < span
        word = words[np.where(inside, at + step, starts)]
        result = np.where(inside, mix(result * np.uint64(31) + word), result)
    return result, counts


def weighted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text with their counts: ``(text, element, weight)``."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    weights = np.diff(np.append(first, len(hashes)))
    return owner[first], hashes[first], weights.astype(float)


def _unit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(float) * 2.0**-53


def signatures(
    owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, texts: int, k: int
) -> np.ndarray:
    """The earliest dart of each coordinate (texts by k). Texts without elements
    keep the largest value everywhere."""
    result = np.full((texts, k), np.iinfo(np.uint64).max, dtype=np.uint64)
    totals = np.bincount(owner, weights=weights, minlength=texts)
    bound = k * (math.log(k) + 3) / np.maximum(totals, 1e-300)
    open_texts = totals > 0
    while open_texts.any():
        chosen = open_texts[owner]
        _throw(result, owner[chosen], elements[chosen], weights[chosen], bound)
        # A coordinate without a dart: throw again up to twice the rank.
        open_texts &= (result == np.iinfo(np.uint64).max).any(axis=1)
        bound = bound * 2
    return result


def _throw(result, owner, elements, weights, bound) -> None:
    """The plane above an element is cut into strips of weight ``[2**v - 1,
    2**(v + 1) - 1)`` and these into cells of height ``2**-v``, so that every cell
    has unit area whatever the document."""
    k = result.shape[1]
    strips = np.floor(np.log2(1 + weights)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(elements)), strips)
    strip = ranges(np.zeros(len(elements), dtype=np.int64), strips)
    low = 2.0**strip - 1
    inside = low < weights[which]
    which, strip, low = which[inside], strip[inside], low[inside]
    cells = np.ceil(bound[owner[which]] * 2.0**strip).astype(np.int64)
    cell = ranges(np.zeros(len(which), dtype=np.int64), cells)
    which, strip, low = (np.repeat(x, cells) for x in (which, strip, low))
    key = mix(elements[which] ^ mix((strip.astype(np.uint64) << np.uint64(48)) + cell.astype(np.uint64)))
    darts = np.searchsorted(POISSON, _unit(key), side="right")
    number = ranges(np.zeros(len(which), dtype=np.int64), darts)
    which, strip, low, cell, key = (np.repeat(x, darts) for x in (which, strip, low, cell, key))
    dart = mix(key + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    weight = low + _unit(mix(dart ^ np.uint64(0x5851F42D4C957F2D))) * 2.0**strip
    rank = (cell + _unit(mix(dart ^ np.uint64(0x14057B7EF767814F)))) * 2.0**-strip
    text = owner[which]
    landed = (weight < weights[which]) & (rank < bound[text])
    text, dart, rank = text[landed], dart[landed], rank[landed]
    # Positive floats order like their bits: rank first, then the dart's own bits.
    early = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (
        dart & np.uint64(0xFFFFFFFF)
    )
    np.minimum.at(result.reshape(-1), text * k + (dart >> np.uint64(32)).astype(np.int64) % k, early)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band, different from band to band."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.repeat(mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(signature), axis=0)
    for row in range(rows):
        key = mix(key + parts[:, :, row])
    return key.view(np.int64)


def chunks_of(lengths: np.ndarray, cost: int, most: int) -> Iterator[slice]:
    """Consecutive texts of about ``most`` words and fixed costs together."""
    start, size = 0, 0
    for i, length in enumerate(lengths):
        if i > start and size + length + cost > most:
            yield slice(start, i)
            start, size = i, 0
        size += length + cost
    if start < len(lengths):
        yield slice(start, len(lengths))


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without null lists."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def _sign(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = list_parts(batch.column(0))
            ends = np.cumsum(lengths)
            for part in chunks_of(lengths, bands * rows * 8, CHUNK):
                mine = lengths[part]
                begin = ends[part.start] - lengths[part.start]
                hashes, counts = shingles(values[begin : begin + mine.sum()], mine)
                owner, elements, weights = weighted(hashes, counts)
                keys = bands_of(signatures(owner, elements, weights, len(mine), bands * rows), bands, rows)
                rest = batch.slice(part.start, len(mine))
                offsets = pa.array(np.arange(len(mine) + 1) * bands, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns[1:], pa.array(counts, pa.int64()), lists],
                    [*rest.schema.names[1:], "n_shingles", "bands"],
                )

    return sign


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles as a plain set: the second occurrence of one is another element, so
    that set similarity is the weighted similarity."""
    for batch in batches:
        values, lengths = list_parts(batch.column(0))
        ends = np.cumsum(lengths)
        for part in chunks_of(lengths, 0, CHUNK):
            mine = lengths[part]
            begin = ends[part.start] - lengths[part.start]
            hashes, counts = shingles(values[begin : begin + mine.sum()], mine)
            _, distinct, weights = weighted(hashes, counts)
            repeats = ranges(np.zeros(len(distinct), dtype=np.int64), weights.astype(np.int64))
            each = mix(np.repeat(distinct, weights.astype(np.int64)) + repeats.astype(np.uint64))
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(each.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(part.start, len(mine)), lists], ["node", "elements"])


def with_node(docs: DataFrame, node: str = "node", hashes: str = "hashes") -> DataFrame:
    """``docs`` with the hashes of their words and a ``node``: equal words, equal nodes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = F.when(F.size(hashes) == 0, F.xxhash64(text)).otherwise(F.xxhash64(hashes))
    return docs.withColumn(hashes, word_hashes(text)).withColumn(node, of)


def _identity(docs: DataFrame) -> DataFrame:
    """``hashes, doc_id, node``."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_node(named).select("hashes", "doc_id", "node")


#: Nodes whose identifiers are broadcast to pick their texts (16 bytes each).
PICKED_AT_ONCE = 2_000_000


def _elements_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, elements`` of the ``wanted`` nodes (with their ``first_id``)."""
    few = wanted.count() <= PICKED_AT_ONCE
    # Texts are picked by their document before anything is computed of them.
    ids = wanted.select("first_id").distinct()
    named = docs.select("doc_id", "text").withColumn(
        "first_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    )
    picked = named.join(F.broadcast(ids) if few else ids, "first_id", "left_semi")
    texts = _identity(picked).withColumn("first_id", F.coalesce("doc_id", F.lit(-1))).join(
        F.broadcast(wanted) if few else wanted, ["first_id", "node"]
    ).select("hashes", "node")
    shingled = texts.mapInArrow(_elements, "node long, elements array<long>")
    elements = stage_in_batches(shingled, "elements", BATCH_ROWS)
    repeated = not elements.groupBy("node").count().filter("count > 1").isEmpty()
    return stage(elements.dropDuplicates(["node"]), "elements") if repeated else elements


#: Members of a band whose pairs are rows, and of a block of a larger band.
IN_PAIRS = 64
BLOCK = 256


def _similar(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``(x, pivot)`` whose similarity is at least ``threshold``."""
    left = elements.withColumnsRenamed({"node": "x", "elements": "of_x"})
    right = elements.withColumnsRenamed({"node": "pivot", "elements": "of_pivot"})
    both = F.size(F.array_intersect("of_x", "of_pivot"))
    return (
        pairs.join(right, "pivot").join(left, "x")
        .filter(both >= threshold * (F.size("of_x") + F.size("of_pivot") - both))
        .select("x", "pivot")
    )


def in_blocks(large: DataFrame) -> DataFrame:
    """``band, low, high, block, node``: the members ``band, x, count`` of large bands, dealt
    into blocks and sent to each two blocks."""
    blocks = F.ceil(F.col("count") / BLOCK)
    block = F.pmod(F.xxhash64("x"), blocks)
    dealt = large.withColumns({"block": block, "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))})
    return dealt.select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", F.col("x").alias("node"),
    )


def _similar_in_blocks(large: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """``node, root, degree`` of members of bands of many: a part of the links of a node,
    and a node that these connect it with. Each two are compared in one band."""
    full = in_blocks(large).join(_bands_of(large), F.col("node") == F.col("x")).drop("x").join(elements, "node")
    schema = "node long, root long, degree long"
    return full.groupBy("band", "low", "high").applyInArrow(_compare(threshold), schema)


def _bands_of(large: DataFrame) -> DataFrame:
    """``x, bands``: all large bands of a node."""
    return large.groupBy("x").agg(F.collect_list("band").alias("bands"))


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        band, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
        node, block = (table.column(c).to_numpy() for c in ("node", "block"))
        bands, counts = list_parts(table.column("bands").chunk(0))
        values, sizes = list_parts(table.column("elements").chunk(0))
        size = len(node)
        # Two that share a lower band are compared there.
        kinds, kind = np.unique(bands, return_inverse=True)
        has = np.zeros((size, len(kinds)), dtype=np.float32)
        has[np.repeat(np.arange(size), counts), kind] = kinds[kind] < band
        _, codes = np.unique(values, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        theirs = np.flatnonzero(block == high)
        others, begins = codes[ranges(starts[theirs], sizes[theirs])], np.cumsum(sizes[theirs]) - sizes[theirs]
        held = np.zeros(codes.max() + 1, dtype=bool)
        linked = np.zeros((size, size), dtype=bool)
        for mine in np.flatnonzero(block == low):
            fits = np.minimum(sizes[theirs], sizes[mine]) >= threshold * np.maximum(sizes[theirs], sizes[mine])
            # Inside one block every two meet twice.
            asked = fits & (has[theirs] @ has[mine] == 0) & ((low != high) | (theirs > mine))
            if not asked.any():
                continue
            own = codes[starts[mine] : starts[mine] + sizes[mine]]
            held[own] = True
            both = np.add.reduceat(held[others].astype(np.int64), begins)
            held[own] = False
            linked[mine, theirs[asked & (both >= threshold * (sizes[theirs] + sizes[mine] - both))]] = True
        linked |= linked.T
        root = np.arange(size)
        while True:
            lower = np.minimum(root, np.where(linked, root, size).min(axis=1))
            if np.array_equal(lower, root):
                break
            root = lower
        degree = linked.sum(axis=1)
        kept = degree > 0
        return pa.table({"node": node[kept], "root": node[root[kept]], "degree": degree[kept]})

    return compare


def _verified_links(docs: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of all similar pairs of nodes that share a band: ``x, pivot``, enough of them to
    connect what they connect, and ``node, degree``, how many a node has."""
    members = stage(
        nodes.filter("n > 0").select(F.explode("bands").alias("band"), F.col("node").alias("x"), "n"), "bands"
    )
    sizes = stage(members.groupBy("band").count().filter("count > 1"), "sizes")
    shared = stage(members.join(sizes, "band"), "shared")
    few, large = (shared.filter(f"count {sign} {IN_PAIRS}") for sign in ("<=", ">"))
    others = few.select("band", F.col("x").alias("pivot"), F.col("n").alias("pivot_n"))
    # Numbers of shingles must allow the similarity.
    possible = F.least("n", "pivot_n") >= threshold * F.greatest("n", "pivot_n")
    every = few.join(others, "band").filter((F.col("x") < F.col("pivot")) & possible).select("x", "pivot").distinct()
    # Two that share a large band as well are compared there.
    of_x = _bands_of(large).toDF("x", "bands_x")
    of_pivot = _bands_of(large).toDF("pivot", "bands_pivot")
    apart = ~F.coalesce(F.arrays_overlap("bands_x", "bands_pivot"), F.lit(False))
    pairs = stage(
        every.join(of_x, "x", "left").join(of_pivot, "pivot", "left").filter(apart).select("x", "pivot"), "pairs"
    )
    compared = pairs.select("x").union(pairs.select("pivot")).union(large.select("x")).distinct().toDF("node")
    elements = _elements_of(docs, stage(compared.join(nodes.select("node", "first_id"), "node"), "wanted"))
    links = stage(_similar(pairs, elements, threshold), "links")
    in_blocks = stage(_similar_in_blocks(large, elements, threshold), "links")
    unstage(docs.sparkSession, members, sizes, shared, pairs, elements)
    one = F.lit(1).cast("long").alias("degree")
    degrees = links.select(F.col("x").alias("node"), one).union(links.select("pivot", one)).union(
        in_blocks.select("node", "degree")
    ).groupBy("node").agg(F.sum("degree").alias("count"))
    connected = in_blocks.filter("node <> root").select(F.col("node").alias("x"), F.col("root").alias("pivot"))
    return links.union(connected), degrees


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component, by minimum
    labels of neighbours with pointer jumping. ``links`` has ``x`` and ``pivot``."""
    both = stage(
        links.select("x", "pivot").union(links.select(F.col("pivot"), F.col("x"))).distinct()
        .toDF("node", "next"),
        "links",
    )
    labels = stage(both.groupBy("node").agg(F.min("next").alias("low")).select(
        "node", F.least("node", "low").alias("label")), "labels")
    while True:
        lows = both.join(labels.withColumnsRenamed({"node": "next"}), "next").groupBy("node").agg(
            F.min("label").alias("low")
        )
        lowered = stage(
            labels.join(lows, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")),
            "labels",
        )
        jumps = lowered.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = stage(
            lowered.join(jumps, "label", "left").select(
                "node", F.least("label", F.coalesce("further", "label")).alias("label"),
                (F.col("old") != F.least("label", F.coalesce("further", "label"))).alias("changed"),
            ),
            "labels",
        )
        changed = jumped.filter("changed").limit(1).count()
        unstage(links.sparkSession, labels, lowered)
        labels = jumped.drop("changed")
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest doc_id of its
    class) and ``n_links``, the verified links of its words to other words."""
    return classes_of_nodes(docs, threshold, bands, rows).drop("node")


def classes_of_nodes(
    docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``near_duplicates`` with the ``node`` of each row (see ``with_node``), which tells
    rows of one doc_id apart."""
    schema = "doc_id long, node long, n_shingles long, bands array<long>"
    signed = stage_in_batches(_identity(docs).mapInArrow(_sign(bands, rows), schema), "signed", BATCH_ROWS)
    nodes = stage(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
        ).withColumn("first_id", F.coalesce("least_id", F.lit(-1))),
        "nodes",
    )
    links, degrees = _verified_links(docs, nodes, threshold)
    ids = nodes.select("node", "least_id").join(components(links), "node", "left").join(degrees, "node", "left")
    labelled = stage(
        ids.select("node", "least_id", F.coalesce("label", "node").alias("label"), F.coalesce("count", F.lit(0).cast("long")).alias("n_links")),
        "labelled",
    )
    named = stage(labelled.groupBy("label").agg(F.min("least_id").alias("class_id")), "named")
    classes = stage(labelled.join(named, "label").select("node", "class_id", "n_links"), "classes")
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "n_links", "node")


def op2_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
