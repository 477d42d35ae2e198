"""A unigram vocabulary, its segmentation lattices, and words of texts.

The public piece file is a BPE model: its scores are merge ranks, not
probabilities. The unigram model used here takes its pieces and byte fallback, and
gives the piece of rank r the probability 1 / ((r + 1) H), Zipf's law. Scores are
rounded to sixteenths, so that sums of them are exact in single precision too, and
ties between segmentations are real ties.

No piece goes across certain boundaries (before a space mark that follows a letter,
for example), so every segmentation of a text is one segmentation of each word.
Boundaries are derived from the vocabulary: two neighbouring characters belong to
different words if no piece has neighbours of their two classes.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece

from fieldtally.llm.batches import code_points, first_of_each, firsts, segment_hashes

SPACE = "▁"
#: Score of an unknown character below the least piece, as in the library.
UNKNOWN_PENALTY = 10.0
#: Separates words in the text that the automaton reads, and stands there for itself
#: where a word holds it; neither is ever part of a piece.
GAP, GAP_IN_WORD = "\U0010FFFF", "\U0010FFFE"
_LENGTH_BITS = 6
#: Classes of characters: in no piece, space mark, letter, digit, other.
_ABSENT, _MARK, _LETTER, _DIGIT, _OTHER = range(5)


@dataclass(frozen=True, eq=False)
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    classes: np.ndarray
    together: np.ndarray
    automaton: ahocorasick.Automaton
    single: np.ndarray
    unknown: float


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def zipf_scores(count: int) -> np.ndarray:
    harmonic = sum(1 / (rank + 1) for rank in range(count))
    return np.array([-round(16 * math.log((rank + 1) * harmonic)) / 16 for rank in range(count)])


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    normal = [
        i for i in range(size)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = np.full(size, -np.inf)
    scores[normal] = zipf_scores(len(normal))
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    classes = np.zeros(0x110000, dtype=np.int8)
    single = np.full(0x110000, -1, dtype=np.int32)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i in normal:
        if len(pieces[i]) == 1:
            single[ord(pieces[i])] = i
        else:
            automaton.add_word(pieces[i], i << _LENGTH_BITS | len(pieces[i]))
        for c in pieces[i]:
            kind = unicodedata.category(c)[0]
            classes[ord(c)] = (
                _MARK if c == SPACE else _LETTER if kind in "LM" else _DIGIT if kind == "N" else _OTHER
            )
    automaton.make_automaton()
    together = np.zeros((5, 5), dtype=bool)
    for i in normal:
        of = [classes[ord(c)] for c in pieces[i]]
        for a, b in zip(of, of[1:]):
            together[a, b] = True
    unknown = float(scores[normal].min()) - UNKNOWN_PENALTY
    return Vocabulary(pieces, scores, byte_ids, classes, together, automaton, single, unknown)


def normalised(text: str | None) -> str:
    """Spaces become marks, and one mark comes first; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@dataclass(frozen=True)
class Words:
    """The words of some texts: hash and text of each distinct word, which word
    stands at each place, and how many places each text has."""

    hashes: np.ndarray
    spellings: list[str]
    places: np.ndarray
    counts: np.ndarray


def words_of(texts: list[str | None], vocabulary: Vocabulary) -> Words:
    marked = [normalised(t) for t in texts]
    joined = "".join(marked)
    points, lengths = code_points(marked)
    if not len(points):
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty.astype(np.uint64), [], empty, np.zeros(len(texts), dtype=np.int64))
    kinds = vocabulary.classes[points]
    cut = np.ones(len(points), dtype=bool)
    cut[1:] = ~vocabulary.together[kinds[:-1], kinds[1:]]
    ends = np.cumsum(lengths)
    begins = (ends - lengths)[lengths > 0]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(points)))
    places, distinct = pd.factorize(segment_hashes(points, starts, sizes))
    first = firsts(places, len(distinct))
    spellings = [joined[s : s + n] for s, n in zip(starts[first].tolist(), sizes[first].tolist())]
    counts = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - lengths)
    return Words(distinct, spellings, places, counts)


@dataclass(frozen=True)
class Lattice:
    """The lattices of several words side by side. Nodes are the positions of the
    words' characters and one end node for each; edges are sorted by source node,
    then by target. ``piece`` is a piece, or ``-1 - code point`` of an unknown
    character."""

    first: np.ndarray
    nodes: int
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    position: np.ndarray
    length: np.ndarray


def lattice(spellings: list[str], vocabulary: Vocabulary) -> Lattice:
    """The automaton enumerates pieces of two characters and more; those of one are
    looked up by their code points."""
    sizes = np.fromiter(map(len, spellings), dtype=np.int64, count=len(spellings))
    joined = GAP.join(spellings)
    first = np.cumsum(sizes + 1) - sizes - 1
    nodes = int((sizes + 1).sum())
    points, _ = code_points([joined])
    inside = np.ones(len(points) + 1, dtype=bool)
    inside[first + sizes] = False
    inside = np.flatnonzero(inside)
    if joined.count(GAP) >= max(len(spellings), 1):
        joined = GAP.join(s.replace(GAP, GAP_IN_WORD) for s in spellings)
    matches = chain.from_iterable(vocabulary.automaton.iter(joined))
    found = np.fromiter(matches, dtype=np.int64).reshape(-1, 2)
    length = found[:, 1] & ((1 << _LENGTH_BITS) - 1)
    singles = vocabulary.single[points[inside]].astype(np.int64)
    known = singles >= 0
    source = np.concatenate([found[:, 0] - length + 1, inside])
    target = np.concatenate([found[:, 0] + 1, inside + 1])
    longer = found[:, 1] >> _LENGTH_BITS
    score = np.concatenate([
        vocabulary.scores[longer], np.where(known, vocabulary.scores[singles], vocabulary.unknown)
    ])
    piece = np.concatenate([longer, np.where(known, singles, -1 - points[inside].astype(np.int64))])
    order = np.argsort((source << _LENGTH_BITS) + target - source, kind="stable")
    position = np.arange(nodes) - np.repeat(first, sizes + 1)
    return Lattice(
        first, nodes, source[order], target[order], piece[order], score[order], position, sizes
    )


def best_paths(words: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: the score of its best path, its number of pieces, and how many
    of these are bytes of unknown characters. Among paths of equal score to a node
    the longest last piece wins, as in the library: starts are tried from left to
    right, and only a better one replaces an earlier one."""
    best = np.full(words.nodes, -np.inf)
    pieces = np.zeros(words.nodes, dtype=np.int64)
    unknown = np.zeros(words.nodes, dtype=np.int64)
    best[words.first] = 0.0
    code = np.where(words.piece < 0, -1 - words.piece, 0)
    size = np.where(
        words.piece >= 0, 1, 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
    )
    # Edges by position of their target; within a node by source.
    order = np.lexsort((words.source, words.target, words.position[words.target]))
    at = words.position[words.target[order]]
    bounds = np.append(first_of_each(at), len(at))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        edges = order[low:high]
        source, target = words.source[edges], words.target[edges]
        value = best[source] + words.score[edges]
        groups = first_of_each(target)
        top = np.maximum.reduceat(value, groups)
        counts = np.diff(np.append(groups, len(target)))
        equal = np.flatnonzero(value == np.repeat(top, counts))
        winner = equal[first_of_each(target[equal])]
        node = target[winner]
        best[node] = top
        pieces[node] = pieces[source[winner]] + size[edges[winner]]
        unknown[node] = unknown[source[winner]] + np.where(words.piece[edges[winner]] < 0, size[edges[winner]], 0)
    ends = words.first + words.length
    return best[ends], pieces[ends], unknown[ends]
