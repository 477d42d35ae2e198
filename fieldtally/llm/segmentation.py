"""Sampled segmentations without replacement: A* search over perturbed lattices.

Every path of a text's lattice has the probability that the unigram scores give
it. Adding Gumbel noise to the log-probability of each path and taking the ``k``
largest is a sample without replacement. The noise is drawn top down: a set of
paths has the maximum of its members' noisy values, a Gumbel variable at the set's
log-mass; the path that attains it is drawn by the conditional probabilities, and
the maxima of the sets left behind at each step are Gumbel variables cut off at
the parent's maximum. These sets are the agenda; the best one is opened next, so
the search leaves one finished path for each set it opens and never goes astray.

Words are independent parts of the lattice (see ``unigram``), so the backward
masses are computed once for each distinct word of a worker, all words side by side,
and all texts of a batch walk in step. An inclusion score says how likely a path
is to be among the k largest given the (k+1)-th noisy value; dividing by it gives
unbiased sums over samples.

Noise is a hash of the row key, the path and the step: the same row gets the same
samples in any partition and after any lost executor.

Defined results: a null or empty text has the empty segmentation as only sample; a
text with fewer than k segmentations gives all of them, with inclusion score 1;
repeated rows are sampled alike; space marks that stand in a text come back as
spaces, as with the library; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import first_of_each, in_chunks, mix, ranges
from fieldtally.llm.dartminhash import chunks_of
from fieldtally.llm.unigram import SPACE, Vocabulary, default_path, lattice, load, words_of

#: Characters worked on at once in a worker.
CHUNK = 400_000
#: Distinct words whose lattices a worker remembers (about 400 bytes each).
REMEMBERED = 120_000
SAMPLES = 2
#: Ids decoded at once in a worker.
DECODED = 100_000
_CHOICE, _NOISE, _TOP = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93))


def _uniform(hashes: np.ndarray) -> np.ndarray:
    """In the open interval from 0 to 1."""
    return ((mix(hashes) >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


def _cut_gumbel(location: np.ndarray, most: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location`` that are at most ``most``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        value = location - np.log(np.exp(location - most) - np.log(uniform))
    return np.where(np.isneginf(location), -np.inf, np.minimum(value, most))


class Lattices:
    """Lattices of distinct words, with the chance of each edge given its source."""

    def __init__(self, vocabulary: Vocabulary, alpha: float) -> None:
        self.vocabulary, self.alpha = vocabulary, alpha
        self.remembered = REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.word = np.zeros(0, dtype=np.int64)  # in the order of the sorted hashes
        self.nodes = 0
        self.buffers = {
            "first": np.zeros(0, dtype=np.int64), "end": np.zeros(0, dtype=np.int64),
            "low": np.zeros(0, dtype=np.int64),  # first edge of each node
            "reach": np.zeros(0),  # cumulative chance among the edges of a node
            "source": np.zeros(0, dtype=np.int32), "target": np.zeros(0, dtype=np.int32),
            "piece": np.zeros(0, dtype=np.int32), "log_chance": np.zeros(0),
            "log_others": np.zeros(0),  # log-mass of a node's other edges, -inf if there are none
        }
        for name, buffer in self.buffers.items():
            setattr(self, name, buffer)

    def _extend(self, name: str, values: np.ndarray) -> None:
        """Append to an array, which is the filled part of a buffer that grows by half."""
        filled = len(getattr(self, name))
        total = filled + len(values)
        if total > len(self.buffers[name]):
            wider = np.empty(total + total // 2, dtype=self.buffers[name].dtype)
            wider[:filled] = self.buffers[name][:filled]
            self.buffers[name] = wider
        self.buffers[name][filled:total] = values
        setattr(self, name, self.buffers[name][:total])

    def find(self, hashes: np.ndarray, spellings: list[str]) -> np.ndarray:
        """Numbers of these words; new ones are added."""
        if len(self.hashes) > self.remembered:
            self.forget()
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            word = self.word[at]
            fresh = np.flatnonzero(self.hashes[at] != hashes)
        else:
            fresh = np.arange(len(hashes))
            word = np.empty(len(hashes), dtype=np.int64)
        if len(fresh):
            word[fresh] = np.arange(len(fresh)) + len(self.first)
            self._add([spellings[i] for i in fresh.tolist()], hashes[fresh])
        return word

    def _add(self, spellings: list[str], hashes: np.ndarray) -> None:
        words = lattice(spellings, self.vocabulary)
        score = self.alpha * words.score
        mass = np.zeros(words.nodes)  # log-mass of the paths from a node to the end
        left = np.repeat(words.length, words.length + 1) - words.position
        remaining = left[words.source]
        order = np.argsort(remaining << 40 | words.source, kind="stable")
        at = remaining[order]
        bounds = np.append(first_of_each(at), len(at))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            edges = order[low:high]
            source = words.source[edges]
            groups = first_of_each(source)
            value = score[edges] + mass[words.target[edges]]
            top = np.maximum.reduceat(value, groups)
            counts = np.diff(np.append(groups, len(edges)))
            total = np.add.reduceat(np.exp(value - np.repeat(top, counts)), groups)
            mass[source[groups]] = top + np.log(total)
        chance = np.minimum(np.exp(score + mass[words.target] - mass[words.source]), 1.0)
        # The likeliest edge of a node first: most choices end there.
        order = np.argsort(words.source + (1 - chance) * 0.5)
        chance, source, target, piece = (
            x[order] for x in (chance, words.source, words.target, words.piece)
        )
        groups = first_of_each(source)
        counts = np.diff(np.append(groups, len(chance)))
        running = np.cumsum(chance)
        before = np.repeat(running[groups] - chance[groups], counts)
        inside = running - before
        inside /= np.repeat(inside[groups + counts - 1], counts)
        inside[groups + counts - 1] = 1.0
        offset, edges = self.nodes, len(self.source)
        number = len(self.first) + np.arange(len(spellings))
        low = np.zeros(words.nodes, dtype=np.int64)
        low[source[groups]] = groups + edges
        self._extend("first", words.first + offset)
        self._extend("end", words.first + words.length + offset)
        self._extend("low", low)
        self._extend("reach", inside)
        self._extend("source", source + offset)
        self._extend("target", target + offset)
        self._extend("piece", piece)
        self._extend("log_chance", np.log(chance))
        with np.errstate(divide="ignore"):
            others = np.log(np.maximum(1 - chance, 1e-300))
        self._extend("log_others", np.where(np.repeat(counts, counts) == 1, -np.inf, others))
        self.nodes += words.nodes
        order = np.argsort(hashes)
        into = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, into, hashes[order])
        self.word = np.insert(self.word, into, number[order])

    def choose(self, nodes: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """An edge out of each node, by its chances."""
        edges = self.low[nodes]
        going = np.flatnonzero(self.reach[edges] < uniform)
        while len(going):
            edges[going] += 1
            going = going[self.reach[edges[going]] < uniform[going]]
        return edges


@dataclass
class Steps:
    """Steps of paths, text by text, in order: what was chosen, the log-chance of
    the path before the step, and the noisy maximum of the alternatives."""

    text: np.ndarray
    place: np.ndarray  # which word of the batch
    edge: np.ndarray
    before: np.ndarray
    rest: np.ndarray


def _walk(store: Lattices, word: np.ndarray, place: np.ndarray, seed: np.ndarray, begin: np.ndarray):
    """Choose edges from ``begin`` to the end of each word. Gives, ordered by word
    and step: the index of the word, and the edge."""
    node, active, step = begin.copy(), np.arange(len(word)), 0
    end = store.end[word]
    found_at, found_edge = [], []
    active = active[node[active] != end[active]]
    while len(active):
        here = node[active]
        local = (here - store.first[word[active]]).astype(np.uint64)
        draw = _uniform(seed[active] + (place[active].astype(np.uint64) << np.uint64(24)) * _CHOICE + local)
        edge = store.choose(here, draw)
        found_at.append(active)
        found_edge.append(edge)
        node[active] = store.target[edge]
        active = active[node[active] != end[active]]
        step += 1
    if not found_at:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, edge = np.concatenate(found_at), np.concatenate(found_edge)
    order = np.argsort(at, kind="stable")
    return at[order], edge[order]


def _log_before(log_chance: np.ndarray, text: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Running sum of each text's log-chances before each step, from ``initial``."""
    running = np.cumsum(log_chance) - log_chance
    starts = first_of_each(text)
    counts = np.diff(np.append(starts, len(text)))
    return running - np.repeat(running[starts], counts) + initial[text]


def _noisy(location: np.ndarray, most: np.ndarray, seed: np.ndarray, place, local) -> np.ndarray:
    mixed = seed + (place.astype(np.uint64) << np.uint64(24)) * _NOISE + local.astype(np.uint64)
    return _cut_gumbel(location, most, _uniform(mixed ^ _NOISE))


def sample_batch(
    texts: list[str | None], keys: np.ndarray, store: Lattices, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each sample in turn: ``(texts that have it, noisy value, log-chance,
    edges of all of them, number of edges of each)``; at last the texts' noisy
    values of a (k+1)-th sample as ``(all texts, value, ...)`` without edges."""
    words = words_of(texts, store.vocabulary)
    number = store.find(words.hashes, words.spellings)
    word = number[words.places] if len(words.places) else words.places
    place = ranges(np.zeros(len(texts), dtype=np.int64), words.counts)
    owner = np.repeat(np.arange(len(texts)), words.counts)
    seeds = mix(keys.view(np.uint64))
    value = -np.log(-np.log(_uniform(seeds ^ _TOP)))
    first_word = np.cumsum(words.counts) - words.counts

    at, edge = _walk(store, word, place, seeds[owner], store.first[word])
    text = owner[at]
    log_chance = store.log_chance[edge]
    before = _log_before(log_chance, text, np.zeros(len(texts))) if len(text) else log_chance
    rest = _noisy(
        before + store.log_others[edge], value[text], seeds[text], place[at],
        store.source[edge] - store.first[word[at]],
    )
    path = Steps(text, at, edge, before, rest)
    agenda = [path]
    excluded: list[dict] = [{}]
    whole = np.bincount(text, weights=log_chance, minlength=len(texts))
    everyone = np.arange(len(texts))
    yield everyone, value, whole, edge, np.bincount(text, minlength=len(texts))

    # Paths are kept whole, as (text, edges), to be cut and continued.
    starts = [np.append(0, np.cumsum(np.bincount(text, minlength=len(texts))))]
    paths = [(at, edge)]
    for turn in range(1, k + 1):
        top = np.full(len(texts), -np.inf)
        which = np.zeros(len(texts), dtype=np.int64)
        where = np.zeros(len(texts), dtype=np.int64)
        for i, steps in enumerate(agenda):
            if not len(steps.text):
                continue
            groups = first_of_each(steps.text)
            counts = np.diff(np.append(groups, len(steps.text)))
            best = np.maximum.reduceat(steps.rest, groups)
            equal = np.flatnonzero((steps.rest == np.repeat(best, counts)) & ~np.isneginf(steps.rest))
            lead = equal[first_of_each(steps.text[equal])] if len(equal) else equal
            who = steps.text[lead]
            better = steps.rest[lead] > top[who]
            top[who[better]] = steps.rest[lead[better]]
            which[who[better]], where[who[better]] = i, lead[better]
        if turn == k:
            yield everyone, top, np.zeros(len(texts)), np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
            return
        go = np.flatnonzero(~np.isneginf(top))
        seeds_now = mix(seeds + mix(np.array([turn], dtype=np.uint64)))
        # At the opened step: another edge out of the same node, none tried before.
        turned_edge = np.zeros(len(go), dtype=np.int64)
        turned_at = np.zeros(len(go), dtype=np.int64)
        turned_before = np.zeros(len(go))
        tried: list[tuple] = [()] * len(go)
        for i, steps in enumerate(agenda):
            mine = np.flatnonzero(which[go] == i)
            spot = where[go[mine]]
            turned_edge[mine], turned_at[mine] = steps.edge[spot], steps.place[spot]
            turned_before[mine] = steps.before[spot]
            for j, s in zip(mine.tolist(), spot.tolist()):
                tried[j] = excluded[i].get(s, ()) + (int(steps.edge[s]),)
        node = store.source[turned_edge]
        local = node - store.first[word[turned_at]] if len(go) else node
        draw = _uniform(seeds_now[go] ^ mix(local.astype(np.uint64) + _CHOICE))
        new_edge, left = _choose_untried(store, node, tried, draw)
        # The rest of that word, then all words after it.
        tail_words = first_word[go] + words.counts[go] - turned_at - 1
        later = ranges(turned_at + 1, tail_words)
        begin = np.concatenate([store.target[new_edge], store.first[word[later]]]) if len(go) else node
        walk_words = np.concatenate([turned_at, later])
        order = np.argsort(walk_words, kind="stable")
        walk_words, begin = walk_words[order], begin[order]
        at, edge = _walk(store, word[walk_words], place[walk_words], seeds_now[owner[walk_words]], begin)
        at = walk_words[at]
        # The turned step comes before the walked steps of its text.
        at, edge = np.append(turned_at, at), np.append(new_edge, edge)
        rank = np.append(np.zeros(len(go), dtype=np.int64), np.ones(len(at) - len(go), dtype=np.int64))
        order = np.argsort(at, kind="stable")
        at, edge, rank = at[order], edge[order], rank[order]
        text = owner[at]
        initial = np.zeros(len(texts))
        initial[go] = turned_before
        log_chance = store.log_chance[edge]
        before = _log_before(log_chance, text, initial) if len(text) else log_chance
        remaining = store.log_others[edge]
        opened = np.flatnonzero(rank == 0)
        with np.errstate(divide="ignore"):
            remaining[opened] = np.log(left)
        rest = _noisy(before + remaining, top[text], seeds_now[text], place[at],
                      store.source[edge] - store.first[word[at]])
        agenda.append(Steps(text, at, edge, before, rest))
        excluded.append({int(s): tried[j] for j, s in enumerate(opened.tolist())})
        for i, steps in enumerate(agenda[:-1]):
            steps.rest[where[go[which[go] == i]]] = -np.inf
        # The whole path: what came before the step on its own path, then the new steps.
        tail_counts = np.bincount(text, minlength=len(texts))[go]
        tail_starts = np.cumsum(tail_counts) - tail_counts
        head_edges, head_counts = _heads(agenda, paths, starts, which, where, go)
        counts = head_counts + tail_counts
        joined = np.empty(int(counts.sum()), dtype=np.int64)
        joined_starts = np.cumsum(counts) - counts
        joined[ranges(joined_starts, head_counts)] = head_edges
        joined[ranges(joined_starts + head_counts, tail_counts)] = edge[ranges(tail_starts, tail_counts)]
        per_text = np.zeros(len(texts), dtype=np.int64)
        per_text[go] = counts
        starts.append(np.append(0, np.cumsum(per_text)))
        paths.append((None, joined))
        whole = np.zeros(len(texts))
        whole += np.bincount(np.repeat(go, counts), weights=store.log_chance[joined], minlength=len(texts))
        yield go, top[go], whole[go], joined, counts


def _heads(agenda, paths, starts, which, where, go):
    """Edges before the opened step on the path that holds it. Steps of a later
    path are only its tail; the step's offset from the tail's end is that from the
    path's end."""
    counts = np.zeros(len(go), dtype=np.int64)
    begin = np.zeros(len(go), dtype=np.int64)
    source = which[go]
    for i in np.unique(source):
        mine = np.flatnonzero(source == i)
        texts = go[mine]
        ends = np.searchsorted(agenda[i].text, texts, side="right")
        from_end = ends - where[texts]
        counts[mine] = starts[i][texts + 1] - from_end - starts[i][texts]
        begin[mine] = starts[i][texts]
    edges = np.empty(int(counts.sum()), dtype=np.int64)
    into = np.cumsum(counts) - counts
    for i in np.unique(source):
        mine = np.flatnonzero(source == i)
        edges[ranges(into[mine], counts[mine])] = paths[i][1][ranges(begin[mine], counts[mine])]
    return edges, counts


def _choose_untried(store, nodes, tried, draw) -> tuple[np.ndarray, np.ndarray]:
    """Another edge out of each node, by the chances of those not tried yet; and
    the chance that is left after it."""
    low = store.low[nodes]
    counts = np.searchsorted(store.source, nodes, side="right") - low
    edges = ranges(low, counts)
    group = np.repeat(np.arange(len(nodes)), counts)
    weights = np.exp(store.log_chance[edges])
    done_group = np.repeat(np.arange(len(nodes)), [len(t) for t in tried]) if len(nodes) else group
    done_edge = np.array([e for t in tried for e in t], dtype=np.int64)
    starts = np.cumsum(counts) - counts
    weights[starts[done_group] + done_edge - low[done_group]] = 0.0
    running = np.cumsum(weights)
    base = running[starts] - weights[starts] if len(nodes) else running
    total = running[starts + counts - 1] - base if len(nodes) else running
    inside = running - base[group] if len(nodes) else running
    passed = (inside >= (draw * total)[group]) & (weights > 0)
    hit = np.flatnonzero(passed)
    chosen = hit[first_of_each(group[hit])]
    after = np.bincount(group, weights=weights, minlength=len(nodes)) - weights[chosen]
    open_edges = np.bincount(group, weights=weights > 0, minlength=len(nodes))
    return edges[chosen], np.where(open_edges > 1, np.maximum(after, 1e-300), 0.0)


def _ids(store: Lattices, edges: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths; unknown characters become bytes."""
    piece = store.piece[edges]
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        return piece.astype(np.int32), counts
    spelled = [chr(-1 - p).encode("utf-8", "replace") for p in piece[odd].tolist()]
    sizes = np.ones(len(piece), dtype=np.int64)
    sizes[odd] = [len(s) for s in spelled]
    begin = np.cumsum(sizes) - sizes
    ids = np.empty(int(sizes.sum()), dtype=np.int32)
    plain = piece >= 0
    ids[begin[plain]] = piece[plain]
    raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
    ids[ranges(begin[odd], sizes[odd])] = store.vocabulary.byte_ids[raw]
    owner = np.repeat(np.arange(len(counts)), counts)
    return ids, np.bincount(owner, weights=sizes, minlength=len(counts)).astype(np.int64)


SAMPLED = "doc_id long, sample int, noisy double, log_chance double, inclusion double, ids array<int>"


@lru_cache(maxsize=1)
def _lattices(path: str, alpha: float) -> Lattices:
    """One for all tasks of a worker process."""
    return Lattices(load(path), alpha)


def _sampling(path: str, k: int, alpha: float, characters: int, remembered: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _lattices(path, alpha)
        store.remembered = remembered
        for batch in batches:
            done = 0
            for texts in in_chunks(batch.column(2).to_pylist(), characters):
                part = batch.slice(done, len(texts))
                done += len(texts)
                keys = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                *found, last = list(sample_batch(texts, keys, store, k))
                for rank, (who, noisy, log_chance, edges, counts) in enumerate(found):
                    ids, sizes = _ids(store, edges, counts)
                    with np.errstate(over="ignore"):
                        inclusion = -np.expm1(-np.exp(log_chance - last[1][who]))
                    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(who)), pa.array(np.full(len(who), rank + 1, dtype=np.int32)),
                            pa.array(noisy), pa.array(log_chance), pa.array(inclusion),
                            pa.ListArray.from_arrays(offsets, pa.array(ids)),
                        ],
                        ["doc_id", "sample", "noisy", "log_chance", "inclusion", "ids"],
                    )

    return sample


def sample_segmentations(
    docs: DataFrame, k: int = SAMPLES, alpha: float = 1.0, path: str | None = None,
    characters: int = CHUNK, remembered: int = REMEMBERED,
) -> DataFrame:
    """Up to ``k`` distinct segmentations of each text, best noisy value first:
    ``doc_id, sample, noisy, log_chance, inclusion, ids``. ``alpha`` multiplies the
    scores: below 1 the samples are more even. The seed is the row's doc_id. A worker
    works on so many ``characters`` at once and has the lattices of so many words
    ``remembered``; neither changes a row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_sampling(path or default_path(), k, alpha, characters, remembered), SAMPLED)


def decode_ids(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of id sequences: bytes of the pieces, marks to spaces, without the mark
    that was put first."""
    table, begins, lengths = _spelling_table(vocabulary)
    piece_sizes = lengths[ids]
    raw = table[ranges(begins[ids], piece_sizes)].tobytes()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(np.bincount(owner, weights=piece_sizes, minlength=len(sizes)).astype(np.int64))
    texts, start = [], 0
    for end in ends.tolist():
        texts.append(raw[start:end].decode("utf-8", "replace").replace(SPACE, " ")[1:])
        start = end
    return texts


@lru_cache(maxsize=2)
def _spelling_table(vocabulary: Vocabulary):
    spelled = [p.encode("utf-8") for p in vocabulary.pieces]
    for byte, i in enumerate(vocabulary.byte_ids.tolist()):
        spelled[i] = bytes([byte])
    lengths = np.array([len(s) for s in spelled], dtype=np.int64)
    return np.frombuffer(b"".join(spelled), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def _decoding(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            offsets = column.offsets.to_numpy()
            ids = column.values.to_numpy()[offsets[0] : offsets[-1]]
            sizes = np.diff(offsets)
            ends = np.cumsum(sizes)
            for part in chunks_of(sizes, 1, DECODED):
                mine = sizes[part]
                begin = ends[part.start] - sizes[part.start]
                texts = decode_ids(ids[begin : begin + mine.sum()], mine, vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part.start, len(mine)).columns, pa.array(texts, pa.string())],
                    [*batch.schema.names, "text"],
                )

    return decode


def decode_segmentations(sampled: DataFrame, path: str | None = None) -> DataFrame:
    """``sampled`` (with a column ``ids``) and the decoded ``text``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sampled.drop("text").schema)
    return sampled.drop("text").mapInArrow(_decoding(path or default_path()), f"{fields}, text string")


def op3_gumbel_segmentations(spark, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decoded = decode_segmentations(sample_segmentations(docs))
    return decoded.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_tokens"), "noisy", "log_chance",
        "inclusion", F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
