"""Repeated passages by compact windows.

For a hash of runs of words, all stretches of a text that share the minimum at one
position form a compact window: they reach from the nearest smaller one on the left to
the nearest smaller one on the right, which is the node of that position in the
Cartesian tree of the hashes. Only windows wide enough matter; their positions are the
minima of all stretches of the least width, about two in each such width.

Two passages of a similarity of 0.8 in five-word shingles that differ by edits (words
replaced, left out, put in or moved) have a run of words in common (``common_words``: 23
for passages of 50), so they share the minimum of a window in that run. This leaves
nothing to chance, and phrases shorter than the hashed run meet no one. All texts that
share a minimum are compared, each two once, on the words themselves, and passages of at
least ``least`` words with a similarity of 0.8 or more are kept. Minima of the same texts
are one. Those of few texts become pairs that meet their words in joins. Those of more
are cut into blocks: a task holds two blocks with their words, compares every text with all
others at once, leaves out what another of the minima compares, and gives every passage its
number of partners, so a passage of m texts leaves no m * m rows. Passages of a text that
overlap are one, else every partner of a near copy would leave a stretch of its own.

Equal texts are one text until the end. Only minima, and the words of texts that share
some, are shuffled.

Defined results: null, empty and short texts have no passages; rows of one doc_id
are one document, and repeats inside one document are not reported; rows with a
null doc_id are not searched; extra columns are ignored; an empty table gives an
empty result. Positions count words.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.batches import first_of_each, mix, ranges
from fieldtally.llm.dartminhash import IN_PAIRS, chunks_of, list_parts, shingles
from fieldtally.llm.tokens import word_hashes
from fieldtally.sources.staging import stage, unstage

WORDS = 5
LEAST = 50
SHARE = 0.8
#: Words worked on at once in a worker; below 2**24, as positions take 24 bits.
CHUNK = 400_000
#: Texts and words of a block of those that share a key, on the average.
BLOCK = 2_048
BLOCK_WORDS = 500_000
#: Documents whose identifiers are broadcast to pick their texts (8 bytes each).
PICKED_AT_ONCE = 2_000_000
_PLACE = np.uint64(0xFFFFFF)


def _ordered(hashes: np.ndarray) -> np.ndarray:
    """Equal hashes: the left one is the smaller."""
    return (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)


def window_places(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The positions of all compact windows of at least ``width`` tokens: the minima of
    all stretches of ``width``. Text i has the tokens ``begins[i]`` to ``ends[i]``."""
    lengths = ends - begins
    wide = lengths >= width
    if not wide.any():
        return np.zeros(0, dtype=np.int64)
    size = len(hashes)
    ordered = _ordered(hashes)
    blocks = -(-size // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:size] = ordered
    table = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(table, axis=1).reshape(-1)
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = ranges(begins[wide], lengths[wide] - width + 1)
    least = np.minimum(backward[starts], forward[starts + width - 1])
    place = (least & _PLACE).astype(np.int64)
    return place[first_of_each(place)]  # minima of sliding stretches never go back


def compact_windows(
    hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position, left, right)`` of all compact windows of at least ``width``
    tokens; ``right`` is exclusive. The range minima of a sparse table give how far they
    reach."""
    place = window_places(hashes, begins, ends, width)
    if not len(place):
        return (place,) * 3
    lengths = ends - begins
    ordered = _ordered(hashes)
    text = np.searchsorted(ends, place, side="right")
    own = ordered[place]
    left, right = place.copy(), place + 1
    low, high = begins[text], ends[text]
    minima = [ordered]
    while 2 ** len(minima) <= lengths.max():
        step = 2 ** (len(minima) - 1)
        last = minima[-1]
        minima.append(np.minimum(last[: len(last) - step], last[step:]) if len(last) > step else last[:0])
    for level in range(len(minima) - 1, -1, -1):
        step = 2**level
        fits = left - step >= low
        spot = np.where(fits, left - step, 0)
        if len(minima[level]):
            fits &= minima[level][np.minimum(spot, len(minima[level]) - 1)] > own
            left = np.where(fits, left - step, left)
            fits = right + step <= high
            spot = np.where(fits, right, 0)
            fits &= minima[level][np.minimum(spot, len(minima[level]) - 1)] > own
            right = np.where(fits, right + step, right)
    return place, left, right


def common_words(least: int, share: float) -> int:
    """How long a run of words any two passages have in common. Passages of n shingles
    have ``share`` * n of them in common, in one run more than there are breaks, and a
    break costs the two sides at least ``2 * (WORDS - 1)`` other shingles."""
    common = math.ceil(share * (least - WORDS + 1))
    a_break = 2 * (WORDS - 1) * share / (1 - share) if share < 1 else math.inf
    runs = (max(common, a_break * b) / (b + 1) for b in range(1, common + 1))
    return min([common, *(math.ceil(r) for r in runs if r < common)]) + WORDS - 1


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, a power of two."""
    hashes, step = mix(words.view(np.uint64)), 1
    while step < size:
        hashes = mix(hashes[:-step] * np.uint64(31) + hashes[step:])
        step *= 2
    return hashes


def window_keys(
    values: np.ndarray, lengths: np.ndarray, least: int, share: float
) -> tuple[np.ndarray, np.ndarray]:
    """``(text, key)``, each once, of the windows of some texts of at least ``least`` words."""
    common = common_words(least, share)
    size = 2 ** int(math.log2(max(1, common * 3 // 4)))
    ends = np.cumsum(lengths)
    hashes = run_hashes(values, size)
    place = window_places(hashes, ends - lengths, ends - size + 1, common - size + 1)
    text, key = np.searchsorted(ends, place, side="right"), hashes[place]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[fresh], key[fresh]


SIGNED = "doc_id long, node long, n_words int, keys array<long>"


def _windows(least: int, share: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = list_parts(batch.column(0))
            ends = np.cumsum(lengths)
            names, nodes = (batch.column(i).to_numpy() for i in (1, 2))
            for part in chunks_of(lengths, 1, CHUNK):
                mine = lengths[part]
                long = mine >= least
                if not long.any():
                    continue
                begin = ends[part.start] - lengths[part.start]
                words = values[begin : begin + mine.sum()][np.repeat(long, mine)]
                text, key = window_keys(words, mine[long], least, share)
                offsets = np.append(0, np.cumsum(np.bincount(text, minlength=int(long.sum()))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[part][long]), pa.array(nodes[part][long]),
                        pa.array(mine[long].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key.view(np.int64))),
                    ],
                    ["doc_id", "node", "n_words", "keys"],
                )

    return cut


def _light(table: DataFrame) -> DataFrame:
    """A staged table, broadcast where it is small."""
    return F.broadcast(table) if table.count() <= PICKED_AT_ONCE else table


def _units(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that are compared, and the documents of those that many have: ``unit, id,
    node, several, n_words, keys, size`` and ``doc_id, unit, id, size``. Equal texts are
    one unit, named by its smallest document; a document with several texts has units
    of its own."""
    rows = signed.select("doc_id", "node").distinct()
    several = stage(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    labelled = (
        signed.join(_light(several).withColumn("marked", F.lit(True)), "doc_id", "left")
        .withColumn("several", F.coalesce("marked", F.lit(False)))
        .withColumn("unit", F.when(F.col("several"), F.xxhash64("node", "doc_id")).otherwise(F.col("node")))
    )
    members = stage(labelled.select("doc_id", "unit").distinct(), "members")
    copied = stage(
        members.groupBy("unit").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")).filter("size > 1"),
        "copied",
    )
    sizes = _light(copied)
    copies = stage(members.join(sizes, "unit"), "copies")
    merged = labelled.groupBy("unit").agg(
        F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("node", "several", "n_words", "keys"))
    )
    units = stage(
        merged.join(sizes.select("unit", "size"), "unit", "left").withColumn(
            "size", F.coalesce("size", F.lit(1).cast("long"))
        ),
        "units",
    )
    unstage(signed.sparkSession, several, members, copied)
    return units, copies


def _candidates(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All two units that share a key: pairs ``x, y`` (of the larger ``id`` first), and
    ``band, x, count, n_words`` of the keys of many, where all of a ``band`` are to be compared."""
    every = units.select(F.explode("keys").alias("band"), F.col("unit").alias("x"), "id", "n_words")
    counted = every.groupBy("band").agg(
        F.count("*").alias("count"), F.bit_xor("x").alias("who"), F.bit_xor(F.xxhash64("x")).alias("also")
    ).filter("count > 1")
    # Keys of the same units are one.
    one = counted.groupBy("count", "who", "also").agg(F.min("band").alias("band"))
    kept = stage(one.select("band", "count"), "kept")
    shared = stage(every.join(_light(kept), "band"), "shared")
    few, large = (shared.filter(f"count {sign} {IN_PAIRS}") for sign in ("<=", ">"))
    others = few.select("band", F.col("x").alias("y"), F.col("id").alias("of_y"))
    pairs = few.join(others, "band").filter("id > of_y").select("x", "y").distinct()
    if not large.isEmpty():
        # Two that share a key of many as well are compared there.
        of_x, of_y = (_bands_of(large).toDF(c, f"bands_{c}") for c in "xy")
        apart = ~F.coalesce(F.arrays_overlap("bands_x", "bands_y"), F.lit(False))
        pairs = pairs.join(of_x, "x", "left").join(of_y, "y", "left").filter(apart).select("x", "y")
    return stage(pairs, "pairs"), large.select("band", "x", "count", "n_words")


def _bands_of(large: DataFrame) -> DataFrame:
    """``x, bands``: all keys of many of a unit."""
    return large.groupBy("x").agg(F.collect_list("band").alias("bands"))


def _in_blocks(large: DataFrame) -> DataFrame:
    """``band, low, high, block, unit``: the members of keys of many, dealt into blocks and
    sent to each two blocks."""
    sizes = large.groupBy("band").agg(F.sum("n_words").alias("all_words"))
    blocks = F.ceil(F.greatest(F.col("count") / BLOCK, F.col("all_words") / BLOCK_WORDS))
    dealt = large.join(_light(sizes), "band").withColumns({
        "block": F.pmod(F.xxhash64("x"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)),
    })
    return dealt.select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
        F.col("x").alias("unit"),
    )


def _texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """``unit, id, size, several, words`` of the ``wanted`` units."""
    # Texts are picked by their document before anything is computed of them. Four bytes
    # a word are enough to compare two texts.
    ids = stage(wanted.select(F.col("id").alias("doc_id")).distinct(), "ids")
    of = wanted.select(F.col("id").alias("doc_id"), "node", "unit", "size", "several")
    picked = named.join(_light(ids), "doc_id", "left_semi").select(
        "doc_id", word_hashes(F.col("text")).alias("hashes")
    )
    texts = stage(
        picked.withColumn("node", F.xxhash64("hashes")).join(_light(of), ["doc_id", "node"]).select(
            "unit", F.col("doc_id").alias("id"), "size", "several",
            F.transform("hashes", lambda h: F.hash(h)).alias("words"),
        ),
        "words",
    )
    repeated = not texts.groupBy("unit").count().filter("count > 1").isEmpty()
    return stage(texts.dropDuplicates(["unit"]), "words") if repeated else texts


class Others:
    """Shingles of the texts that some texts are compared with, as codes that no two of
    them share."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        self.size = len(codes)
        self.lengths = lengths
        self.begins = np.cumsum(lengths) - lengths
        self.places = np.sort(codes * self.size + np.arange(self.size))
        code, place = np.divmod(self.places, max(1, self.size))
        repeated = code[1:] == code[:-1]
        self.repeats = bool(repeated.any())
        #: The place of the equal shingle before, else -1.
        self.before = np.full(self.size, -1)
        self.before[place[1:][repeated]] = place[:-1][repeated]

    def with_each(self, count: int) -> Others:
        """This one text as the other of ``count`` pairs."""
        each = copy.copy(self)
        each.lengths, each.begins = np.repeat(self.lengths, count), np.zeros(count, dtype=np.int64)
        return each

    def next_places(self, codes: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place at ``least`` or behind of every code, or beyond all."""
        at = np.searchsorted(self.places, codes * self.size + least)
        place = self.places[np.minimum(at, self.size - 1)] - codes * self.size
        return np.where((at < self.size) & (place < self.size), place, self.size)


def matching_stretches(
    owner: np.ndarray, begins: np.ndarray, ends: np.ndarray, share: float, least: int
) -> tuple[np.ndarray, ...]:
    """``(pair, low, high, run low, run high)`` of the stretches of at least ``least``
    shingles of which at least ``share`` are common, and their longest runs. The runs of
    common shingles of every pair are joined from the left as long as the share holds."""
    counts = np.bincount(owner) if len(owner) else np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    enough = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
    # Every pair's last stretch: begin, end, common shingles, its longest run.
    last = np.zeros((5, len(counts)), dtype=np.int64)
    done = []
    for step, many in enumerate(enough.tolist()):
        pair = order[:many]
        begin, end = begins[firsts[pair] + step], ends[firsts[pair] + step]
        low, high, common, run_low, run_high = last[:, pair]
        joins = (step > 0) & (common + end - begin >= share * (end - low))
        if step:
            kept = ~joins & (high - low >= least)
            done.append((pair[kept], *last[:, pair[kept]]))
        longer = ~joins | (end - begin > run_high - run_low)
        last[:, pair] = (
            np.where(joins, low, begin), end, np.where(joins, common, 0) + end - begin,
            np.where(longer, begin, run_low), np.where(longer, end, run_high),
        )
    kept = np.flatnonzero((last[1] - last[0] >= least) & (counts > 0))
    done.append((kept, *last[:, kept]))
    pair, low, high, _, run_low, run_high = (np.concatenate(x) for x in zip(*done))
    return pair, low, high, run_low, run_high


def _middle(values: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The median of every owner's values, without fraction."""
    firsts = np.cumsum(counts) - counts
    low, high = np.minimum.reduceat(values, firsts), np.maximum.reduceat(values, firsts)
    middle = low.astype(float)
    differ = low < high
    if differ.any():
        some = differ[owner]
        size = counts[differ]
        first = np.cumsum(size) - size
        rank = np.repeat(np.arange(len(size)), size)
        least = int(low.min())
        span = int(high.max()) - least + 1
        ordered = np.sort(rank * span + values[some] - least) - rank * span + least
        middle[differ] = (ordered[first + (size - 1) // 2] + ordered[first + size // 2]) / 2
    return np.trunc(middle).astype(np.int64)


def _best_counterparts(own, begins, before, where, others: Others, pair, low, high):
    """``(similarity, begin, end)`` of the stretches of the other texts most similar to
    those given, of three each: moved by the usual distance of common shingles, by that of
    the first one, and the whole range in which they first occur (texts that repeat
    themselves)."""
    counts = high - low
    at = ranges(begins[pair] + low, counts)
    owner = np.repeat(np.arange(len(pair)), counts)
    firsts = np.cumsum(counts) - counts
    place = where[at]
    fresh = before[at] < low[owner]
    there = others.begins[pair]
    common = place >= 0
    spots, of = place[common] - there[owner[common]], owner[common]
    common_counts = np.bincount(of, minlength=len(pair))
    common_firsts = np.cumsum(common_counts) - common_counts
    usual = _middle(spots - (at - begins[pair][owner])[common], of, common_counts)
    first = spots[common_firsts] - low
    mine = np.add.reduceat(fresh.astype(np.int64), firsts)
    asked = fresh & common
    asked_of, asked_place, asked_code = owner[asked], place[asked], own[at[asked]]
    best = None
    for begin, end in (
        (low + usual, high + usual),
        (low + first, high + first),
        (np.minimum.reduceat(spots, common_firsts), np.maximum.reduceat(spots, common_firsts) + 1),
    ):
        begin, end = np.maximum(0, begin), np.minimum(others.lengths[pair], end)
        if best is not None and np.array_equal(begin, best[1]) and np.array_equal(end, best[2]):
            continue
        theirs = np.maximum(0, end - begin)
        from_here, to_here = (there + begin)[asked_of], (there + end)[asked_of]
        found = asked_place
        if others.repeats:
            some = ranges(there + begin, theirs)
            of_some = np.repeat(np.arange(len(pair)), theirs)
            theirs = np.bincount(of_some[others.before[some] < (there + begin)[of_some]], minlength=len(pair))
            found = others.next_places(asked_code, from_here)
        both = np.bincount(asked_of[(found >= from_here) & (found < to_here)], minlength=len(pair))
        similarity = both / np.maximum(1, mine + theirs - both)
        if best is None:
            best = similarity, begin, end
            continue
        better = (similarity > best[0]) | (similarity == best[0]) & (
            (begin > best[1]) | (begin == best[1]) & (end > best[2])
        )
        best = tuple(np.where(better, x, y) for x, y in zip((similarity, begin, end), best))
    return best


def shared_passages(
    own: np.ndarray, lengths: np.ndarray, before: np.ndarray, where: np.ndarray, others: Others,
    share: float, least: int,
) -> tuple[np.ndarray, ...]:
    """``(pair, start, end, other start, other end, similarity)`` in words of the passages
    that pairs of texts share. ``own`` has the shingles of the first texts, ``before`` where
    in its text the equal one before is, ``where`` the first place of each in the other
    text, else -1. The similarity is that of the two stretches' sets of shingles; if a
    stretch as a whole falls short, its longest run of common shingles may still do."""
    width = least - WORDS + 1
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    found = where >= 0
    follows = np.zeros(len(own), dtype=bool)
    follows[1:] = found[:-1] & (owner[1:] == owner[:-1])
    opens = np.flatnonzero(found & ~follows)
    goes_on = np.zeros(len(own), dtype=bool)
    goes_on[:-1] = found[1:] & follows[1:]
    closes = np.flatnonzero(found & ~goes_on) + 1
    of = owner[opens]
    pair, low, high, run_low, run_high = matching_stretches(of, opens - begins[of], closes - begins[of], share, width)
    passages = []
    for _ in range(2):
        if len(pair):
            similarity, begin, end = _best_counterparts(own, begins, before, where, others, pair, low, high)
            good = similarity >= share
            passages.append(tuple(x[good] for x in (pair, low, high, begin, end, similarity)))
            rest = ~good & (run_high - run_low >= width)
            pair, low, high, run_low, run_high = (x[rest] for x in (pair, run_low, run_high, run_low, run_high))
    columns = (np.concatenate(x) for x in zip(*passages)) if passages else np.zeros((6, 0), dtype=np.int64)
    pair, low, high, begin, end, similarity = columns
    return pair, low, high + WORDS - 1, begin, end + WORDS - 1, similarity


def _before(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where in its text the equal code before is, else -1."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((owner, codes))
    repeated = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    before = np.full(len(codes), -1)
    before[order[1:][repeated]] = (order[:-1] - (np.cumsum(lengths) - lengths)[owner[order[:-1]]])[repeated]
    return before


class _Found:
    """Passages of units that overlap are one, with the number of its partners so far. A
    partner with passages in several is taken off again where those turn out to be one: a row
    with ``upto`` counts if the passage reaches beyond it. Partners of documents with
    several texts, and such partners, could count twice: they are rows by ``once``."""

    schema = (
        "unit long, id long, start int, end int, once long, upto int, other_id long, similarity double, n long"
    )
    #: Passages held before they are merged.
    HELD = 500_000

    def __init__(self, table: pa.Table) -> None:
        self.units, one, self.row = np.unique(
            table.column("unit").to_numpy(), return_index=True, return_inverse=True
        )
        self.ids, self.sizes, self.several = (table.column(c).to_numpy()[one] for c in ("id", "size", "several"))
        self.held: list[tuple] = []
        self.count = 0
        self.batches: list[pa.RecordBatch] = []

    def add(self, mine: np.ndarray, theirs: np.ndarray, passages: tuple[np.ndarray, ...]) -> None:
        """Passages of the rows ``mine`` and ``theirs`` of the table, all of two at once."""
        _, start, end, other_start, other_end, similarity = passages
        mine, theirs = self.row[mine], self.row[theirs]
        self.held += [(mine, start, end, theirs, similarity), (theirs, other_start, other_end, mine, similarity)]
        self.count += 2 * len(start)
        if self.count > self.HELD:
            self._merge()

    def _merge(self) -> None:
        unit, start, end, other, similarity = (
            np.concatenate(x) for x in zip(*self.held)
        ) if self.held else [np.zeros(0, dtype=np.int64)] * 5
        self.held, self.count = [], 0
        once = self.several[unit] | self.several[other]
        alone = [x[once] for x in (unit, start, end, other, similarity)]
        self._emit(*alone[:3], self.ids[alone[3]], None, self.ids[alone[3]], alone[4], self.sizes[alone[3]])
        order = np.lexsort((start[~once], unit[~once]))
        unit, start, end, other, similarity = (x[~once][order] for x in (unit, start, end, other, similarity))
        if not len(unit):
            return
        span = int(end.max()) + 1
        reach = np.maximum.accumulate(unit * span + end)
        fresh = np.ones(len(unit), dtype=bool)
        fresh[1:] = unit[1:] * span + start[1:] >= reach[:-1]
        firsts = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        of, low = unit[firsts], start[firsts]
        high = np.append(reach[firsts[1:] - 1], reach[-1]) - of * span
        least, most = np.minimum.reduceat(self.ids[other], firsts), np.maximum.reduceat(similarity, firsts)
        # Every partner of a passage once, in the order of the unit's passages.
        order = np.lexsort((group, other, unit))
        group, other = group[order], other[order]
        fresh[1:] = (group[1:] != group[:-1]) | (other[1:] != other[:-1])
        fresh[:1] = True
        group, other = group[fresh], other[fresh]
        n = np.bincount(group, self.sizes[other])
        self._emit(of, low, high, None, None, least, most, n)
        more = np.flatnonzero((other[1:] == other[:-1]) & (of[group[1:]] == of[group[:-1]]))
        both, at = np.unique(group[more] * len(firsts) + group[more + 1], return_inverse=True)
        n = np.bincount(at, self.sizes[other[more]], len(both))
        here, there = np.divmod(both, len(firsts))
        self._emit(of[here], low[here], high[here], None, low[there], least[here], most[here], -n)

    def _emit(self, unit, start, end, once, upto, other_id, similarity, n) -> None:
        columns = (self.units[unit], self.ids[unit], start, end, once, upto, other_id, similarity, n)
        kinds = [field.split() for field in self.schema.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        self.batches.append(pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(unit), types[kind]) if c is None else pa.array(c.astype(types[kind].to_pandas_dtype()))
                for c, (_, kind) in zip(columns, kinds)
            ],
            [name for name, _ in kinds],
        ))

    def table(self) -> pa.Table:
        self._merge()
        return pa.Table.from_batches(self.batches)


#: Shingles of pairs compared at once.
COMPARED = 200_000


def _in_pairs(share: float, least: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                pa.RecordBatch.from_arrays(
                    [batch.column(f"{side}{c}") for c in ("", "_id", "_size", "_several")],
                    ["unit", "id", "size", "several"],
                )
                for side in "xy"
            ]
            found = _Found(pa.Table.from_batches(sides))
            words = [list_parts(batch.column(f"{side}_words")) for side in "xy"]
            ends = [np.cumsum(lengths) for _, lengths in words]
            for part in chunks_of(words[0][1] + words[1][1], 0, COMPARED):
                sizes = np.concatenate([lengths[part] for _, lengths in words])
                parts = [
                    values[end[part.start] - lengths[part.start] : end[part.stop - 1]]
                    for (values, lengths), end in zip(words, ends)
                ]
                hashes, counts = shingles(np.concatenate(parts).astype(np.int64), sizes)
                size = part.stop - part.start
                pair = np.repeat(np.tile(np.arange(size), 2), counts)
                # Shingles of two pairs are two.
                kinds, codes = np.unique(mix(hashes + mix(pair)), return_inverse=True)
                mine = int(counts[:size].sum())
                first = np.full(len(kinds), -1)
                first[codes[mine:][::-1]] = np.arange(len(codes) - mine)[::-1]
                passages = shared_passages(
                    codes[:mine], counts[:size], _before(codes[:mine], counts[:size]), first[codes[:mine]],
                    Others(codes[mine:], counts[size:]), share, least,
                )
                at = passages[0] + part.start
                found.add(at, at + batch.num_rows, passages)
            yield from found.table().to_batches()

    return verify


def _compare(share: float, least: int):
    """Compares the texts of two blocks of one key, those of larger id with the others."""
    needed = math.ceil(share * (least - WORDS + 1))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        band, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
        block, ids = (table.column(c).to_numpy() for c in ("block", "id"))
        found = _Found(table)
        bands, counts = list_parts(table.column("bands").chunk(0))
        values, lengths = list_parts(table.column("words").chunk(0))
        size = len(ids)
        # Two that share a lower key are compared there.
        kinds, kind = np.unique(bands, return_inverse=True)
        has = np.zeros((size, len(kinds)), dtype=np.float32)
        has[np.repeat(np.arange(size), counts), kind] = kinds[kind] < band
        hashes, sizes = shingles(values.astype(np.int64), lengths)
        kinds, codes = np.unique(hashes, return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        before = _before(codes, sizes)
        first = np.full(len(kinds), -1)
        for theirs in range(size):
            asked = (ids > ids[theirs]) & ((low == high) | (block != block[theirs]))
            asked &= has @ has[theirs] == 0
            rows = np.flatnonzero(asked)
            if not len(rows):
                continue
            other = codes[begins[theirs] : begins[theirs] + sizes[theirs]]
            first[other[::-1]] = np.arange(len(other))[::-1]
            others = Others(other, sizes[theirs : theirs + 1])
            for part in chunks_of(sizes[rows], 0, COMPARED):
                mine = rows[part]
                at = ranges(begins[mine], sizes[mine])
                common = np.add.reduceat(first[codes[at]] >= 0, np.cumsum(sizes[mine]) - sizes[mine], dtype=np.int64)
                mine = mine[common >= needed]
                if not len(mine):
                    continue
                at = ranges(begins[mine], sizes[mine])
                passages = shared_passages(
                    codes[at], sizes[mine], before[at], first[codes[at]], others.with_each(len(mine)), share, least
                )
                found.add(mine[passages[0]], np.full(len(passages[0]), theirs), passages)
            first[other] = -1
        return found.table()

    return compare


def _merged(found: DataFrame) -> DataFrame:
    """``id, start, end, other_id, similarity, n_partners`` of the passages of units, those
    that overlap as one."""
    before = Window.partitionBy("unit").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    group = F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0))
    all_of = Window.partitionBy("unit", "group")
    summed = found.groupBy("unit", "id", "start", "end", "once", "upto").agg(
        F.min("other_id").alias("other_id"), F.max("similarity").alias("similarity"),
        F.when(F.col("once").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"),
    )
    placed = summed.withColumn("fresh", fresh).withColumn("group", group).withColumns(
        {"start": F.min("start").over(all_of), "end": F.max("end").over(all_of)}
    ).withColumn("n", F.when(F.col("upto") >= F.col("end"), 0).otherwise(F.col("n")))
    return placed.groupBy("id", "start", "end", "once").agg(
        F.min("other_id").alias("other_id"), F.max("similarity").alias("similarity"),
        F.when(F.col("once").isNull(), F.sum("n")).otherwise(F.max("n")).alias("n"),
    ).groupBy("id", "start", "end").agg(
        F.min("other_id").alias("other_id"), F.max("similarity").alias("similarity"), F.sum("n").alias("n_partners")
    )


def repeated_passages(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """One row per passage, those of a text that overlap being one: ``doc_id, start, end``
    (words, end exclusive), ``other_id`` (the smallest document that shares some of it),
    ``similarity`` (the best) and ``n_partners`` (the number of documents that share some
    of it)."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("doc_id is not null")
    hashed = named.select(word_hashes(F.col("text")).alias("words"), "doc_id").select(
        "words", "doc_id", F.xxhash64("words").alias("node")
    )
    signed = stage(hashed.mapInArrow(_windows(least, share), SIGNED), "signed")
    units, copies = _units(signed)
    pairs, large = _candidates(units)
    compared = pairs.select("x").union(pairs.select("y")).union(large.select("x")).distinct().toDF("unit")
    wanted = stage(units.join(compared, "unit").select("unit", "id", "node", "size", "several"), "wanted")
    texts = _texts_of(named, wanted)
    of_x, of_y = (
        texts.toDF(*(side if c == "unit" else f"{side}_{c}" for c in texts.columns)) for side in "xy"
    )
    both = pairs.join(of_x, "x").join(of_y, "y")
    verified = both.mapInArrow(_in_pairs(share, least), _Found.schema)
    full = _in_blocks(large).join(_bands_of(large).withColumnRenamed("x", "unit"), "unit").join(texts, "unit")
    blocks = full.groupBy("band", "low", "high").applyInArrow(_compare(share, least), _Found.schema)
    found = stage(verified, "found").unionByName(stage(blocks, "found"))
    # Equal texts share all of it.
    whole = units.filter("size > 1").select(
        "unit", "id", F.lit(0).alias("start"), F.col("n_words").alias("end"), F.lit(None).cast("long").alias("once"),
        F.lit(None).cast("int").alias("upto"), F.lit(None).cast("long").alias("other_id"),
        F.lit(1.0).alias("similarity"), (F.col("size") - 1).alias("n"),
    )
    passages = stage(_merged(found.unionByName(whole)), "passages")
    return _of_documents(passages, units, copies)


def _of_documents(passages: DataFrame, units: DataFrame, copies: DataFrame) -> DataFrame:
    """``passages`` of units as those of all their documents. A copy's smallest partner in
    its whole text is the smallest document of the unit or, for that one, the next."""
    columns = ["doc_id", "start", "end", "other_id", "similarity", "n_partners"]
    seconds = copies.filter("doc_id <> id").groupBy("id").agg(F.min("doc_id").alias("second"))
    many = stage(
        units.filter("size > 1").select("id", "n_words").join(seconds, "id"), "many"
    )
    once = passages.join(_light(many), "id", "left_anti").withColumnRenamed("id", "doc_id")
    partner = F.when(
        (F.col("start") == 0) & (F.col("end") == F.col("n_words")),
        F.when(F.col("doc_id") == F.col("id"), F.col("second")).otherwise(F.col("id")),
    )
    told = stage(passages.join(_light(many), "id"), "told")
    repeated = copies.select("doc_id", "id").join(_light(told), "id").withColumn(
        "other_id", F.least("other_id", partner)
    )
    return once.select(columns).unionByName(repeated.select(columns))


def op10_compact_windows(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
