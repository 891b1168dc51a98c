"""The piece lattice of a unigram vocabulary: trie-shared forward scores, best paths and N-best search.

A text is cut into pre-tokens; a piece never crosses the border of a pre-token. The vocabulary is a list of pieces of a
public SentencePiece model. Such a BPE model gives its pieces by merge rank only, so their unigram probabilities follow
Zipf's law: the piece of rank r (from 1) has probability proportional to 1 / r. Scores are whole numbers (natural
logarithms times 2**20), so that sums and ties are exact. A character that is no piece is written as its UTF-8 bytes,
for 10 nats below the rarest piece. Ties: fewer pieces, then the shorter last piece.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SCALE = 1 << 20
SPACE = "▁"
#: Spaces and a word without ASCII punctuation; spaces and ASCII punctuation; spaces alone; any other white space.
PRETOKEN = re.compile(r" *[^\s!-/:-@\[-`{-~]+| *[!-/:-@\[-`{-~]+| +|\s")
UNKNOWN_NATS = 10
#: The trie of the pre-tokens up to this length is built level by level; the few that are longer are walked depth first.
LONG = 32
BASE = 0x9E3779B97F4A7C15
NEVER = -(1 << 60)


@dataclass(frozen=True)
class Vocabulary:
    """What travels to the tasks: pieces with their ids, and the id of byte 0 (the 256 byte pieces follow on)."""

    pieces: tuple[str, ...]
    ids: tuple[int, ...]
    byte_id: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        use = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return Vocabulary(tuple(model.id_to_piece(i) for i in use), tuple(use), model.piece_to_id("<0x00>"))


@dataclass
class Segmented:
    """Of each word: the best score, the next best score (NEVER if there is none), tokens of the best path, and its ids."""

    best: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    ids: np.ndarray | None = None
    starts: np.ndarray | None = None


class Lattice:
    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.byte_id, self.ids = v.byte_id, np.array(v.ids, np.int32)
        total = math.log(sum(1 / r for r in range(1, len(v.pieces) + 1)))
        self.scores = np.array([round(-(math.log(r) + total) * SCALE) for r in range(1, len(v.pieces) + 1)], np.int64)
        self.unknown = int(self.scores.min()) - UNKNOWN_NATS * SCALE
        self.index = {p.replace(SPACE, " "): i for i, p in enumerate(v.pieces)}
        self.longest = max(map(len, v.pieces))
        self.score_of = self.scores.tolist()
        self.power = np.array([pow(BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        hashes = np.zeros(len(v.pieces), np.uint64)
        for i, p in enumerate(v.pieces):
            h = 0
            for c in p.replace(SPACE, " "):
                h = (h * BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        order = np.argsort(hashes)
        self.keys, self.place = hashes[order], order
        assert len(np.unique(hashes)) == len(hashes), "two pieces share a hash"
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.keys)] = True
        self.utf8 = None
        self.bytes_of = {int(i): p.replace(SPACE, " ").encode() for p, i in zip(v.pieces, v.ids, strict=True)}
        self.bytes_of |= {v.byte_id + b: bytes([b]) for b in range(256)}
        self.byte_lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.byte_lengths[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.byte_ends = np.cumsum(self.byte_lengths)
        self.byte_table = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        #: What a caller keeps of ``n_best``, by word and n.
        self.searched: dict[tuple[str, int], list[tuple[int, list[int]]]] = {}

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(42)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and of those the pieces."""
        hit = np.flatnonzero(self.seen[self._slot(h)])
        at = np.searchsorted(self.keys, h[hit])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == h[hit]
        return hit[same], self.place[at[same]]

    def segment(self, words: list[str], want_ids: bool = False) -> Segmented:
        """The best segmentation of each distinct word. The words are put in a trie, level by level: what a prefix scores is
        found once for all words that begin with it, and read off at the node where a word ends."""
        n = len(words)
        out = Segmented(np.zeros(n, np.int64), np.full(n, NEVER, np.int64), np.zeros(n, np.int64))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        short = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=words.__getitem__)
        if short:
            rows = np.array(short)
            trie = _Trie(self, [words[i] for i in short])
            out.best[rows], out.second[rows], out.counts[rows] = trie.best, trie.second, trie.counts
            if want_ids:
                parts.append((rows, *trie.paths()))
        walk = _Walk(self)
        for i in sorted((i for i, w in enumerate(words) if len(w) > LONG), key=words.__getitem__):
            walk.to(words[i])
            out.best[i], out.second[i], out.counts[i] = walk.best[-1], walk.second[-1], walk.count[-1]
            if want_ids:
                got = self.expand(walk.path())
                parts.append((np.array([i]), np.array(got, np.int32), np.array([len(got)])))
        if want_ids:
            out.starts = np.concatenate([[0], np.cumsum(out.counts)])
            out.ids = np.zeros(int(out.starts[-1]), np.int32)
            for rows, ids, lengths in parts:
                out.ids[spread(out.starts[rows], lengths)] = ids
        return out

    def edges(self, word: str, end: int) -> Iterator[tuple[int, int, int]]:
        """What can end there, shortest first: (start, piece or minus one minus the code of an unknown character, score)."""
        get, scores = self.index.get, self.score_of
        for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
            if (p := get(word[start:end])) is not None:
                yield start, p, scores[p]
            elif start == end - 1:
                yield start, -1 - ord(word[start]), self.unknown

    def nth_best(self, word: str, n: int) -> int:
        """The score of the n-th best segmentation (NEVER if there are fewer); only as many positions as a piece is long are held."""
        window: deque[list[int]] = deque([[0]], self.longest)
        for end in range(1, len(word) + 1):
            near = (x + score for start, _, score in self.edges(word, end) for x in window[start - end])
            window.append(heapq.nlargest(n, near))
        return window[-1][n - 1] if len(window[-1]) >= n else NEVER

    def expand(self, path: list[int]) -> list[int]:
        """Piece indexes to ids; an unknown character to the ids of its bytes."""
        out: list[int] = []
        for p in path:
            out.extend([int(self.ids[p])] if p >= 0 else [self.byte_id + b for b in chr(-1 - p).encode()])
        return out

    def n_best(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations as (score, ids), best first: A* from the end of the word back to its start. The forward
        scores are exact, so every path that is taken off the queue whole is the next best one. Of equal ones the one nearest the
        start goes on first: there can be very many, and none is left half way."""
        walk = _Walk(self)
        walk.to(word)
        forward, first = walk.best, walk.path()
        # No more than the n best are wanted: what falls below the n-th best is not queued.
        least = self.nth_best(word, n)
        queue = [(-forward[-1], len(word), 0, 0, None)]
        found, serial = [], 0
        while queue and len(found) < n:
            _, at, _, behind, path = heapq.heappop(queue)
            if at == 0:
                out = []
                while path:
                    out.append(path[0])
                    path = path[1]
                found.append((behind, out))
                continue
            for start, piece, score in self.edges(word, at):
                if forward[start] + behind + score >= least:
                    serial += 1
                    heapq.heappush(queue, (-(forward[start] + behind + score), start, serial, behind + score, (piece, path)))
        rest = [(s, p) for s, p in found if p != first][: n - 1]
        return [(s, self.expand(p)) for s, p in [(forward[-1], first), *rest]]

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding (with the leading dummy space) the ids are."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decode_all(self, ids: np.ndarray, offsets: list[int]) -> list[bytes]:
        """The UTF-8 bytes (with the leading dummy space) of the ids between each two offsets."""
        lengths = self.byte_lengths[ids]
        raw = self.byte_table[spread(self.byte_ends[ids] - lengths, lengths)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] places, then the same from starts[1], and so on."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total) - np.repeat(before - starts, lengths)


class _Walk:
    """Long words in sorted order, as a depth-first walk of their trie: of each prefix of the present word the scores, and what the
    next word shares with it is kept."""

    def __init__(self, lattice: Lattice) -> None:
        self.lattice, self.word = lattice, ""
        self.best, self.second, self.count = array("q", [0]), array("q", [NEVER]), array("q", [0])
        self.start, self.piece = array("q", [0]), array("q", [0])

    def to(self, word: str) -> None:
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        best, second, count, back, kept = self.best, self.second, self.count, self.start, self.piece
        for column in (best, second, count, back, kept):
            del column[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            b1, b2, k, at, what = NEVER, NEVER, 0, 0, 0
            for start, piece, score in self.lattice.edges(word, end):
                x, y = best[start] + score, second[start] + score if second[start] > NEVER else NEVER
                c = count[start] + (1 if piece >= 0 else len(chr(-1 - piece).encode("utf-8", "surrogatepass")))
                if x > b1:
                    b1, b2, k, at, what = x, max(b1, y), c, start, piece
                else:
                    if x == b1 and c < k:
                        k, at, what = c, start, piece
                    b2 = max(b2, x, y)
            for column, value in ((best, b1), (second, b2), (count, k), (back, at), (kept, what)):
                column.append(value)
        self.word = word

    def path(self) -> list[int]:
        out, at = [], len(self.word)
        while at:
            out.append(self.piece[at])
            at = self.start[at]
        return out[::-1]


class _Trie:
    """Sorted distinct words as a trie, held by depth: node k of depth d is the k-th new prefix of d characters."""

    def __init__(self, lattice: Lattice, words: list[str]) -> None:
        self.lattice, n = lattice, len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, n)
        depth = int(self.lengths.max())
        codes = np.zeros((n, depth), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.repeat(np.arange(n), self.lengths), spread(np.zeros(n, np.int64), self.lengths)] = flat + 1
        differs = np.ones((n, depth), bool)
        differs[1:] = codes[1:] != codes[:-1]
        shared = np.where(differs.any(1), differs.argmax(1), depth)
        shared[0] = 0
        self.node = np.zeros((depth + 1, n), np.int32)
        hashes, best, second, count = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.full(1, NEVER)], [np.zeros(1, np.int64)]
        self.step, self.piece = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for d in range(1, depth + 1):
            new = (shared < d) & (self.lengths >= d)
            self.node[d] = np.cumsum(new) - 1
            rows = np.flatnonzero(new)
            c = codes[rows, d - 1].astype(np.uint64)
            h = hashes[d - 1][self.node[d - 1][rows]] * np.uint64(BASE) + c
            b1, b2 = np.full(len(rows), NEVER), np.full(len(rows), NEVER)
            k, step, piece = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for length in range(1, min(d, lattice.longest) + 1):
                up = self.node[d - length][rows]
                hit, found = lattice._find(h - hashes[d - length][up] * lattice.power[length])
                if length == 1:
                    missing = np.ones(len(rows), bool)
                    missing[hit] = False
                    lost = np.flatnonzero(missing)
                    if len(lost):
                        code = c[lost].astype(np.int64) - 1
                        tokens = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                        hit, found = np.concatenate([hit, lost]), np.concatenate([found, -1 - code])
                        score = np.where(found >= 0, lattice.scores[found], lattice.unknown)
                        add = np.concatenate([np.ones(len(hit) - len(lost), np.int64), tokens])
                    else:
                        score, add = lattice.scores[found], 1
                else:
                    score, add = lattice.scores[found], 1
                if not len(hit):
                    continue
                from_ = up[hit]
                x, y = best[d - length][from_] + score, second[d - length][from_]
                y = np.where(y > NEVER, y + score, NEVER)
                t = count[d - length][from_] + add
                old, was = b1[hit], k[hit]
                better = x > old
                b2[hit] = np.maximum(np.where(better, old, np.maximum(b2[hit], x)), y)
                take = better | ((x == old) & (t < was))
                won = hit[take]
                b1[won], k[won], step[won], piece[won] = x[take], t[take], length, found[take]
            for keep, value in ((hashes, h), (best, b1), (second, b2), (count, k), (self.step, step), (self.piece, piece)):
                keep.append(value)
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in best])])[:-1]
        ends = self.base[self.lengths] + self.node[self.lengths, np.arange(n)]
        self.best, self.second, self.counts = (np.concatenate(x)[ends] for x in (best, second, count))

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best paths, word after word, and how many each word has."""
        step, piece = np.concatenate(self.step), np.concatenate(self.piece)
        at, rows = self.lengths.copy(), np.arange(len(self.lengths))
        out, taken = np.zeros(int(self.counts.sum()), np.int32), self.counts.copy()
        starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        while len(rows):
            here = self.base[at[rows]] + self.node[at[rows], rows]
            p = piece[here]
            known = p >= 0
            taken[rows[known]] -= 1
            out[starts[rows[known]] + taken[rows[known]]] = self.lattice.ids[p[known]]
            for r, code in zip(rows[~known].tolist(), (-1 - p[~known]).tolist(), strict=True):
                raw = chr(code).encode("utf-8", "surrogatepass")
                taken[r] -= len(raw)
                out[starts[r] + taken[r] : starts[r] + taken[r] + len(raw)] = [self.lattice.byte_id + b for b in raw]
            at[rows] -= step[here]
            rows = rows[at[rows] > 0]
        return out, self.counts


_built: dict[int, Lattice] = {}


def lattice_of(vocabulary: Vocabulary) -> Lattice:
    """The tables of a vocabulary, built once in each Python worker."""
    key = hash(vocabulary)
    if key not in _built:
        _built.clear()
        _built[key] = Lattice(vocabulary)
    return _built[key]


def pretokens(text: str) -> list[str]:
    """With the leading dummy space; an empty text has none."""
    return PRETOKEN.findall(" " + text) if text else []
