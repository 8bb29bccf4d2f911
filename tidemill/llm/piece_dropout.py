"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

Encoding starts from single characters and always takes the best-scored
adjacent pair whose joined piece is in the vocabulary, the leftmost among
equals, until none is left.  With dropout, a candidate merge is skipped if a
hash keyed by (seed, document's id, word's number, place in the word, piece)
falls below the rate: each occurrence of a word draws for itself, and the
same in every run.

What an occurrence draws is known before its agenda: all candidates of a word
are the pieces among its substrings.  The segmentation follows from the word
and the set of skipped ones, so it is remembered under both; where none is
skipped that the plain agenda looks at, it is the plain one.  What is not
remembered goes through the agenda side by side in numpy: one row a word, one
merge a row and round.  Any segmentation decodes to the same text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import released

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A word with the spaces before it; no piece reaches beyond (checked when a model is read).
CHUNKS = re.compile(r" *[^ ]+| +")
#: Longer words than this take the agenda with a heap.
WIDEST = 64
#: Words and segmentations that a worker remembers, and characters encoded at a time.
CACHE, CHARS = 600_000, 600_000
#: Words with more candidates than this are only remembered with at most one of them skipped.
MASK = 40
UNKNOWN, FILLER = -1, -2


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers, by multiplying and folding."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PairTable:
    """Joined piece of a pair of pieces, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several, the last one gets the slot
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the pair makes no piece, or a side is not a piece."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -3
        out, slot = np.full(keys.shape, -1, np.int32), self._slot(keys)
        left_over = np.flatnonzero(keys.ravel() >= 0)
        keys, slot, flat = keys.ravel(), slot.ravel(), out.ravel()
        while len(left_over):
            held = self.keys[slot[left_over]]
            hit = held == keys[left_over]
            flat[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (held != -1)]
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


STEP = np.uint64(0x2545F4914F6CDD1D)


def halves(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 31 bits from hashes of strings, for a PairTable."""
    return (hashes >> np.uint64(33)).astype(np.int64), (hashes & np.uint64(0x7FFFFFFF)).astype(np.int64)


@dataclass
class Pieces:
    """A vocabulary: the pieces' bytes, their scores, what starts and joins them, and the joined ones by the hash of their signs."""

    bytes_of: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    char_ids: np.ndarray
    pairs: PairTable
    joins: PairTable
    longest: int

    @classmethod
    def read(cls, path: str = DEFAULT_MODEL) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = {name: i for i, name in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        if any(SPACE in name.lstrip(SPACE) for name in plain):
            raise ValueError("a piece goes on after a word's end; words can't be encoded one by one")
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        bytes_of = [raw.get(i) or (name.replace(SPACE, " ").encode() if name in plain else b"") for i, name in enumerate(names)]
        char_ids = np.full(0x110000, UNKNOWN, np.int32)
        for name, i in plain.items():
            if len(name) == 1:
                char_ids[ord(name)] = i
        char_ids[ord(" ")], char_ids[ord(SPACE)] = char_ids[ord(SPACE)], UNKNOWN  # the sign itself goes as bytes, so that it comes back
        lone = np.flatnonzero(char_ids[:128] == UNKNOWN)  # such as line ends: a byte piece, which joins with nothing
        char_ids[lone] = byte_ids[lone]
        joined = [(plain[a] << 32 | plain[b], i) for name, i in plain.items() for k in range(1, len(name)) if (a := name[:k]) in plain and (b := name[k:]) in plain]
        keys, values = np.array(joined, np.int64).reshape(-1, 2).T
        ends = np.unique(values)
        own = [names[i].replace(SPACE, " ") for i in ends]
        left, right = halves(np.array([cls.hash_of(name) for name in own], np.uint64))
        pairs, joins = PairTable(np.ascontiguousarray(keys), values.astype(np.int32)), PairTable(left << 32 | right, ends.astype(np.int32))
        return cls(bytes_of, np.array([sp.get_score(i) for i in range(n)], np.float32), byte_ids, char_ids, pairs, joins, max(map(len, own), default=0))

    @staticmethod
    def hash_of(name: str) -> int:
        h = 0
        for c in name:
            h = (h * int(STEP) + ord(c) + 1) & (2**64 - 1)
        return h

    def candidates(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, piece) of the pieces of two or more signs among the substrings of words, by word: all that merges can make."""
        word = np.repeat(np.arange(len(length)), length)
        i, left = np.arange(len(points)), np.repeat(begin + length, length) - np.arange(len(points))
        signs = points.astype(np.uint64) + np.uint64(1)
        h, found = signs, []
        for n in range(2, self.longest + 1):
            on = np.flatnonzero(left >= n)
            if not len(on):
                break
            i, left, h = i[on], left[on], h[on] * STEP + signs[i[on] + n - 1]
            piece = self.joins.get(*halves(h))
            hit = np.flatnonzero(piece >= 0)
            found.append((i[hit], piece[hit]))
        at, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(word[at], kind="stable")
        at, piece = at[order], piece[order]
        return word[at], at - begin[word[at]], piece

    def decode(self, ids) -> str:
        """The text of a list of piece ids; the space before the first word goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, code points and starts of words laid end to end."""
    length = np.array(list(map(len, words)))
    return length, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(length) - length


def _candidate(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return (place.astype(np.uint64) << np.uint64(24)) ^ piece.astype(np.uint64)


class Encoder:
    """Encodes texts under a seed, and remembers segmentations of words."""

    def __init__(self, pieces: Pieces, seed: int = 0, dropout: float = 0.1):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be in 0..1")
        self.pieces = pieces
        self.seed = mix(np.array([seed & (2**64 - 1)], np.uint64))
        self.rate = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.n, self.plain = np.zeros((3, CACHE + 1), np.int64)
        # Of all words' candidates: their keys, whether the plain agenda looks at them, the segmentation without only this one.
        self.candidates, self.seen, self.less = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.lesser: dict[int, int] = {}
        self.count = 0
        self.starts, self.sizes, self.flat = np.zeros(2 * CACHE + 1, np.int64), np.zeros(2 * CACHE + 1, np.int64), np.zeros(0, np.int32)

    def draws(self, doc_id: int | None, n: int) -> np.ndarray:
        """The key of each word of a document."""
        return mix(mix(np.array([(doc_id or 0) & (2**64 - 1)], np.uint64) ^ self.seed) + np.arange(n, dtype=np.uint64))

    def skipped(self, draw: np.ndarray, candidate: np.ndarray) -> np.ndarray:
        """Which candidate merges (place << 24 ^ piece) the keyed hash drops."""
        return mix(draw ^ candidate) < self.rate

    def _score(self, draw: np.ndarray | None, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The scores of candidate merges (flat arrays); minus infinity where there is no piece or the merge is skipped, which none is without a draw."""
        s = np.full(len(piece), -np.inf, np.float32)
        ok = np.flatnonzero(piece >= 0)
        if self.rate and draw is not None:
            ok = ok[~self.skipped(draw[ok], _candidate(start[ok], piece[ok]))]
        s[ok] = self.pieces.scores[piece[ok]]
        return s

    def _rows(self, symbols: np.ndarray, draw: np.ndarray | None, looked: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The agenda for rows of symbols (padded with FILLER): gives (rows, their symbols) as rows end; each round merges once in each row.

        Without a draw nothing is skipped, and looked gets the (rows, candidates) that were looked at.
        """

        def look(rows: np.ndarray, start: np.ndarray, piece: np.ndarray) -> None:
            if draw is None:
                ok = piece >= 0
                looked.append((rows[ok], _candidate(start[ok], piece[ok])))

        n, width = symbols.shape
        rows = np.arange(n)
        start = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width))
        joined = np.full((n, width), -1, np.int32)
        joined[:, :-1] = self.pieces.pairs.get(symbols[:, :-1], symbols[:, 1:])
        score = self._score(None if draw is None else np.repeat(draw, width), start.ravel(), joined.ravel()).reshape(n, width)
        look(np.repeat(rows, width), start.ravel(), joined.ravel())
        while True:
            best = score.argmax(axis=1)
            going = score[np.arange(len(rows)), best] > -np.inf
            if not going.all():
                yield rows[~going], symbols[~going]
                if not going.any():
                    return
            on = np.flatnonzero(going)
            rows, best, draw, width = rows[on], best[on], None if draw is None else draw[on], width - 1
            merged = joined[on, best]
            # The symbol after the merged pair's first goes; the rest moves up.
            cols = np.arange(width)
            take = (on * (width + 1))[:, None] + cols + (cols > best[:, None])
            symbols, start, joined, score = (x.take(take) for x in (symbols, start, joined, score))
            here = np.arange(len(rows))
            symbols[here, best] = merged
            for at in (best - 1, best):  # pairs beside the new symbol
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                i, j = here[ok], at[ok]
                joined[i, j] = pair = self.pieces.pairs.get(symbols[i, j], symbols[i, j + 1])
                score[i, j] = self._score(None if draw is None else draw[i], start[i, j], pair)
                look(rows[i], start[i, j], pair)
            end = np.flatnonzero(best == width - 1)
            score[end, best[end]] = -np.inf

    def _long(self, symbols: np.ndarray, draw: np.ndarray | None, looked: list, row: int) -> np.ndarray:
        """The same agenda for one long word, with a heap and linked symbols."""
        sym, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if 0 <= i < n and after[i] < n]
            if lefts:
                pieces = self.pieces.pairs.get(np.array([sym[i] for i in lefts]), np.array([sym[after[i]] for i in lefts]))
                if draw is None:
                    ok = pieces >= 0
                    looked.append((np.full(int(ok.sum()), row), _candidate(np.array(lefts)[ok], pieces[ok])))
                for i, p, s in zip(lefts, pieces.tolist(), self._score(None if draw is None else np.repeat(draw, len(lefts)), np.array(lefts), pieces).tolist()):
                    if s > -np.inf:
                        heapq.heappush(heap, (-s, i, p, sym[i], sym[after[i]], after[i]))

        offer(list(range(n)))
        while heap:
            _, i, p, left, right, j = heapq.heappop(heap)
            if sym[i] != left or after[i] != j or sym[j] != right:
                continue
            sym[i], sym[j], after[i] = p, FILLER, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        return np.array([s for s in sym if s != FILLER], np.int32)

    def _add(self, words: list[str]) -> None:
        """Number words, list their candidates and segment them without dropout."""
        at = slice(len(self.at), len(self.at) + len(words))
        self.plain[at], looked = self._learn(words, None)
        if self.rate:
            length, points, begin = _points(words)
            word, place, piece = self.pieces.candidates(points, begin, length)
            found = _candidate(place, piece)
            both = (word.astype(np.uint64) << np.uint64(40)) ^ found  # places are less than WIDEST here
            self.first[at], self.n[at] = len(self.candidates) + np.searchsorted(word, np.arange(len(words))), np.bincount(word, minlength=len(words))
            self.candidates = np.concatenate([self.candidates, found])
            self.seen = np.concatenate([self.seen, np.isin(both, (looked[0].astype(np.uint64) << np.uint64(40)) ^ looked[1])])
            self.less = np.concatenate([self.less, np.full(len(found), -1)])
        self.at.update(zip(words, range(at.start, at.stop)))

    def _find(self, words: list[str], word: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The segmentations of remembered words: their numbers, and -1 where a lone occurrence has none that could be remembered."""
        at = self.plain[word]
        if not self.rate or not len(word):
            return at
        n = self.n[word]
        ends = np.cumsum(n)
        who = np.repeat(np.arange(len(word)), n)
        bit = np.arange(len(who)) - (ends - n)[who]
        candidate = self.first[word][who] + bit
        lost = np.flatnonzero(self.skipped(draw[who], self.candidates[candidate]))
        who, bit, candidate = who[lost], bit[lost], candidate[lost]
        times, real = np.bincount(who, minlength=len(word)), np.bincount(who[self.seen[candidate]], minlength=len(word)) > 0

        one = np.flatnonzero((times == 1)[who] & real[who])
        spot, one = candidate[one], who[one]
        new, where = np.unique(spot[self.less[spot] < 0], return_index=True)
        if len(new):
            where = one[self.less[spot] < 0][where]
            self.less[new] = self._learn([words[i] for i in where.tolist()], draw[where])[0]
        at[one] = self.less[spot]

        more = np.flatnonzero((times > 1) & real)
        at[more] = -1
        more = more[n[more] <= MASK]
        if len(more):  # sums of different powers of two are exact
            mask = np.bincount(who, np.ldexp(1.0, np.minimum(bit, MASK)), len(word))[more].astype(np.int64)
            keys, where, back = np.unique(word[more] << MASK | mask, return_index=True, return_inverse=True)
            known = np.array([self.lesser.get(k, -1) for k in keys.tolist()])
            new = np.flatnonzero(known < 0)
            if len(new):
                where = more[where[new]]
                known[new] = self._learn([words[i] for i in where.tolist()], draw[where])[0]
                self.lesser.update(zip(keys[new].tolist(), known[new].tolist()))
            at[more] = known[back]
        return at

    def _learn(self, words: list[str], draw: np.ndarray | None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Segment words, each under its draw, and keep the segmentations: their numbers, and without a draw the (word, candidate) looked at."""
        length, points, begin = _points(words)
        symbols = self.pieces.char_ids[points]
        strange = np.add.reduceat(symbols == UNKNOWN, begin) > 0
        first, flats, base, looked = self.count, [self.flat], len(self.flat), []

        def keep(words: np.ndarray, grid: np.ndarray) -> None:
            nonlocal base
            held = grid != FILLER
            size = held.sum(axis=1)
            self.starts[first + words], self.sizes[first + words] = base + np.cumsum(size) - size, size
            flats.append(grid[held])
            base += int(size.sum())

        low = 0
        for width in (4, 6, 8, 10, 12, 16, 24, 32, WIDEST):
            own = np.flatnonzero((length > low) & (length <= width) & ~strange)
            low = width
            if len(own):
                cols = np.arange(width)
                grid = np.where(cols < length[own, None], symbols[np.minimum(begin[own, None] + cols, len(symbols) - 1)], FILLER)
                seen: list = []
                for rows, grid in self._rows(grid, None if draw is None else draw[own], seen):
                    keep(own[rows], grid)
                looked += [(own[rows], found) for rows, found in seen]
        for i in np.flatnonzero((length > WIDEST) | strange):
            ids = self._long(symbols[begin[i] : begin[i] + length[i]], None if draw is None else draw[i : i + 1], looked, i)
            if strange[i]:  # unknown signs come in order, as no merge takes them; each becomes its bytes
                own = points[begin[i] : begin[i] + length[i]]
                signs = iter(own[self.pieces.char_ids[own] == UNKNOWN].tolist())
                ids = np.concatenate([self.pieces.byte_ids[list(chr(next(signs)).encode("utf-8", "replace"))] if s == UNKNOWN else np.array([s], np.int32) for s in ids.tolist()])
            keep(np.array([i]), ids[None, :])
        self.flat = np.concatenate(flats)
        self.count += len(words)
        both = tuple(np.concatenate(x) for x in zip(*looked)) if looked else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        return np.arange(first, self.count), both

    def _part(self, words: list[str], draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words, and how many of them each word has.

        A word that is met once is segmented under its draw and forgotten, as are long ones.
        """
        if len(self.at) + len(words) > CACHE or self.count + 2 * len(words) > 2 * CACHE:
            self.reset()
        word = np.array(list(map(self.at.get, words, repeat(-1))))
        strange = np.flatnonzero(word < 0)
        others = [words[i] for i in strange.tolist()]
        new = [w for w, n in Counter(others).items() if n > 1 and len(w) <= WIDEST]
        if new:
            self._add(new)
            word[strange] = list(map(self.at.get, others, repeat(-1)))
        held = np.flatnonzero(word >= 0)
        at = np.full(len(words), -1)
        at[held] = self._find(words if len(held) == len(words) else [words[i] for i in held.tolist()], word[held], draw[held])
        lone = np.flatnonzero(at < 0)
        count, kept = self.count, self.flat
        if len(lone):
            at[lone] = self._learn([words[i] for i in lone.tolist()], draw[lone])[0]
        size = self.sizes[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[at] - (ends - size), size) + np.arange(ends[-1])]
        self.count, self.flat = count, kept
        return ids, size

    def encode(self, rows: list[tuple[int | None, str | None]]) -> list[np.ndarray]:
        """Piece ids of each (doc_id, text); none for null and empty texts."""
        words, draws, ends = [], [np.zeros(0, np.uint64)], [0]
        for doc_id, text in rows:
            words += CHUNKS.findall(" " + text) if text else ()
            draws.append(self.draws(doc_id, len(words) - ends[-1]))
            ends.append(len(words))
        draw, step = np.concatenate(draws), max(1, CACHE // 4)
        parts = [self._part(words[lo : lo + step], draw[lo : lo + step]) for lo in range(0, len(words), step)]
        ids, size = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return np.split(ids, np.concatenate([[0], np.cumsum(size)])[ends[1:-1]])[: len(rows)]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, seed: int = 17, dropout: float = 0.1) -> DataFrame:
    """doc_id, ids, n_bytes (of the text), lossless of every row, from its whole text.

    Null and empty texts have no pieces.  lossless tells that the ids decode
    to the text's very bytes.  Equal rows get equal ids; a null doc_id draws
    as 0 does.  Long texts are encoded word by word, whole.  An empty table
    gives no rows; columns besides doc_id and text are not read.  The model is read by
    the driver and sent to the executors; its size is that of the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, seed, dropout)
        table = shared.value.bytes_of

        def done(rows: list) -> pa.RecordBatch:
            ids = encoder.encode(rows)
            raw = [(t or "").encode() for _, t in rows]
            lossless = [b"".join(map(table.__getitem__, x.tolist()))[1:] == b for x, b in zip(ids, raw)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists, pa.array([len(b) for b in raw], pa.int64()), pa.array(lossless)], ["doc_id", "ids", "n_bytes", "lossless"])

        rows, chars = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
                chars += len(rows[-1][1] or "")
                if chars >= CHARS or len(rows) >= 5000:
                    yield done(rows)
                    rows, chars = [], 0
        if rows:
            yield done(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, ids array<int>, n_bytes long, lossless boolean")


def decode(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, text of rows with ids; null ids give a null text, no ids an empty one.  Rows come as often as they are there; other columns are not read."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.read(model_path).bytes_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not x.is_valid else b"".join(map(shared.value.__getitem__, x.values.to_pylist()))[1:].decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
