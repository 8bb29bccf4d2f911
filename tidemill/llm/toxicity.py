"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words, cut to their first STEM letters; every term of the labelled
examples (a bounded sample) is indexed.  A term weighs (1 + ln tf) times its
inverse document frequency in the whole corpus times its relevance, the
likelihood ratio statistic of term and label in the sample: with whole
vectors of plain TF-IDF, neighbours share a topic and not a tone (measured in
the README).  Cosines run over all indexed terms.

The examples are kept in an inverted index whose posting lists are cut into
blocks of examples, each with the largest weight of the term in it.  A query
adds up common terms, then rare ones in order of their impact, and stops when
the block maxima of the others show which few examples can still be among
the k nearest; those are compared in full, so the neighbours are exact.
Neighbours vote with weights that fall with distance, and the vote is
calibrated by leave-one-out votes of the examples themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import give_back, held_out, released, text_key, without, written

#: Letters of a term, and the pattern that takes so many of each word.
STEM = 8
WORDS = re.compile(r"([^\W\d_]{1,%d})[^\W\d_]*" % STEM)
#: Bound of the fitted model: labelled examples of each class.
PER_CLASS = 8000
NEIGHBOURS, BLOCK = 15, 512
#: Terms in more than one of so many examples are common; candidates that are compared in full.
COMMON, FEW = 16, 100
#: Stems that a worker remembers; documents scored at a time, and multiplied at a time; slices of a count vector.
CACHE, BATCH, TOGETHER, SLICES = 300_000, 512, 64, 64
#: Hashes that the driver looks up, and examples that a worker weighs, at a time.
PIECE, SOME = 1 << 18, 1024
#: Sums in single precision are this close to the exact ones; examples of a stretch whose largest score bounds the floor.
CLOSE, CHUNK = 1e-5, 64


def term_counts(text: str | None) -> Counter:
    """The terms of a text and how often each occurs."""
    return Counter(WORDS.findall(text.lower()) if text else ())


def term_hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term)


@dataclass
class Terms:
    """The indexed terms, by place in their sorted hashes."""

    hashes: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def bags(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of the indexed terms in each text, in order of term."""
        counts = [term_counts(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list({t for c in counts for t in c} - self.known.keys())
        if new:
            own = np.array([term_hash(t) for t in new], np.uint64)
            at = np.searchsorted(self.hashes, own)
            hit = at < len(self.hashes)
            hit[hit] = self.hashes[at[hit]] == own[hit]
            self.known.update(zip(new, np.where(hit, at, -1).tolist()))
        out = []
        for c in counts:
            terms, n = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))
            order = np.argsort(terms)[np.count_nonzero(terms < 0) :]
            out.append((terms[order], n[order]))
        return out


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several slices, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Examples:
    """Distinct bags of the examples, each with the weights of its clean and toxic examples and the least doc_id among them.

    This is what executors are sent; each worker builds its index from it once.
    """

    hashes: np.ndarray
    weight_of: np.ndarray  # of each term, at a count of one
    votes: np.ndarray
    ids: np.ndarray
    begins: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    zero: np.ndarray  # (clean, toxic) weights of examples without terms

    @classmethod
    def of(cls, hashes: np.ndarray, weight_of: np.ndarray, examples: Iterable[tuple[int, int, np.ndarray, np.ndarray]], class_weight: tuple[float, float]) -> Examples:
        """examples: (doc_id, toxic, terms, counts), by doc_id."""
        groups: dict[bytes, list] = {}
        zero = np.zeros(2)
        for doc_id, toxic, terms, counts in examples:
            if not len(terms):
                zero[toxic] += class_weight[toxic]
                continue
            key = xxhash.xxh3_128_digest(terms.tobytes() + counts.tobytes())
            if key not in groups:
                heavy = terms[np.argsort(-(1 + np.log(counts.astype(float))) * weight_of[terms], kind="stable")[:3]]
                groups[key] = [(*heavy.tolist(), doc_id), np.zeros(2), terms, counts]
            groups[key][1][toxic] += class_weight[toxic]
        # Bags with the same heaviest terms become neighbours, which makes the blocks' maxima tight.
        held = sorted(groups.values(), key=lambda g: g[0])
        join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(g[i] for g in held)])
        begins = np.concatenate([[0], np.cumsum([len(g[2]) for g in held])]).astype(np.int64)
        votes, ids = np.array([g[1] for g in held]).reshape(-1, 2), np.array([g[0][-1] for g in held], np.int64)
        return cls(hashes, weight_of, votes, ids, begins, join(2, np.int32), join(3, np.uint8), zero)

    @cached_property
    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex.build(self)

    @cached_property
    def lookup(self) -> Terms:
        return Terms(self.hashes)


@dataclass
class BlockMaxIndex:
    """The vectors of examples, and what their votes weigh.

    Vectors are held by example (terms, counts from begins; norms) and by term
    (places, weights from starts); common terms as rows of a matrix.  tops
    are the largest weights of a term in each block it occurs in.
    """

    weight_of: np.ndarray
    votes: np.ndarray
    ids: np.ndarray
    begins: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    logs: np.ndarray
    norms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    top_starts: np.ndarray
    top_blocks: np.ndarray
    tops: np.ndarray
    largest: np.ndarray
    row_of: np.ndarray
    rows: np.ndarray
    zero: np.ndarray  # (clean, toxic) weights of examples without terms

    @classmethod
    def build(cls, x: Examples) -> BlockMaxIndex:
        n, n_terms = len(x.ids), len(x.weight_of)
        sizes = np.diff(x.begins)
        logs = 1 + np.log(np.maximum(1, np.arange(int(x.counts.max(initial=0)) + 1)))
        norms, weights = np.zeros(n), np.zeros(len(x.terms), np.float32)
        for lo in range(0, n, SOME):  # a worker holds little more than the index itself
            begin, end = x.begins[lo], x.begins[min(n, lo + SOME)]
            raw = logs[x.counts[begin:end]] * x.weight_of[x.terms[begin:end]]
            norms[lo : lo + SOME] = np.sqrt(np.add.reduceat(raw * raw, x.begins[lo : min(n, lo + SOME)] - begin))
            weights[begin:end] = raw / np.repeat(norms[lo : lo + SOME], sizes[lo : lo + SOME])
        order = np.argsort(x.terms, kind="stable")
        places = np.repeat(np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.int32), sizes)[order]
        by_term, weights = x.terms[order], weights[order]
        del order
        starts = np.searchsorted(by_term, np.arange(n_terms + 1))
        block = (places // BLOCK).astype(np.int32)
        cut = np.flatnonzero(np.concatenate([[True], (by_term[1:] != by_term[:-1]) | (block[1:] != block[:-1])])) if len(places) else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(weights, cut) if len(cut) else weights
        top_starts = np.searchsorted(by_term[cut], np.arange(n_terms + 1))
        largest = np.zeros(n_terms)
        np.maximum.at(largest, by_term[cut], tops)
        row_of = np.full(n_terms, -1, np.int32)
        common = np.flatnonzero(np.diff(starts) > max(1, n // COMMON))
        row_of[common] = np.arange(len(common))
        rows = np.zeros((len(common), n), np.float32)
        own = row_of[by_term] >= 0
        rows[row_of[by_term[own]], places[own]] = weights[own]
        return cls(x.weight_of, x.votes, x.ids, x.begins, x.terms, x.counts, logs, norms, starts, places, weights, top_starts, block[cut], tops, largest, row_of, rows, x.zero)

    @staticmethod
    def unit(terms: np.ndarray, counts: np.ndarray, weight_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts.astype(float))) * weight_of[terms]
        return terms, w / (np.sqrt((w * w).sum()) or 1.0)

    def _exact(self, places: np.ndarray, terms: np.ndarray, w: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Cosines of a query with some examples, rounded to 9 digits; spread has a zero for every term."""
        sizes = self.begins[places + 1] - self.begins[places]
        at = _gather(self.begins[places], sizes)
        spread[terms] = w * self.weight_of[terms]
        out = np.add.reduceat(spread[self.terms[at]] * self.logs[self.counts[at]], np.cumsum(sizes) - sizes) / self.norms[places]
        spread[terms] = 0.0
        return np.round(out, 9)

    def nearest(self, bags: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each bag the vectors and cosines of the k nearest and all that tie with the k-th, nearest first.  Only cosines above zero count."""
        units = [self.unit(*b, self.weight_of) for b in bags]
        spread = np.zeros(len(self.weight_of))
        wide = np.zeros((len(units), len(self.rows)), np.float32)
        for i, (t, w) in enumerate(units):
            own = self.row_of[t]
            wide[i, own[own >= 0]] = w[own >= 0]
        out: list = [None] * len(units)
        # Queries with the same heaviest common term go together, so that fewer rows are multiplied.
        order = np.argsort(wide.argmax(axis=1), kind="stable") if len(self.rows) else np.arange(len(units))
        for lo in range(0, len(units), TOGETHER):
            own = order[lo : lo + TOGETHER]
            used = np.flatnonzero(wide[own].any(axis=0))
            sums = wide[np.ix_(own, used)] @ self.rows[used]
            for i, s in zip(own.tolist(), sums):
                out[i] = self._search(*units[i], s, spread, k)
        return out

    def _search(self, terms: np.ndarray, w: np.ndarray, score: np.ndarray, spread: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(score)
        rare = np.flatnonzero(self.row_of[terms] < 0)
        impact = w[rare] * self.largest[terms[rare]]
        rare = rare[np.argsort(-impact, kind="stable")]
        impact = np.sort(impact)[::-1]
        # The most that terms from here on can add: the sum of their impacts, or (by Cauchy and Schwarz) the length of the query in them.
        far = np.sqrt(np.cumsum(w[rare][::-1] ** 2)[::-1])
        left = np.concatenate([np.minimum(np.cumsum(impact[::-1])[::-1], far), [0.0]])
        blocks, done, floor, score = -(-n // BLOCK), 0, 0.0, score.astype(np.float64)
        for part in (0.1, 0.02, 0.0):
            upto = max(done, int(np.searchsorted(-left, -part * left[0])))
            if upto > done:
                t = terms[rare[done:upto]]
                begin, end = self.starts[t], self.starts[t + 1]
                cuts = list(map(slice, begin.tolist(), end.tolist()))
                added = np.concatenate([self.weights[c] for c in cuts])
                added *= np.repeat(w[rare[done:upto]].astype(np.float32), end - begin)
                score += np.bincount(np.concatenate([self.places[c] for c in cuts]), added, n)
                done = upto
            if n > CHUNK * k:  # the k-th largest score is no less than the k-th largest maximum of stretches
                peaks = score[: n // CHUNK * CHUNK].reshape(-1, CHUNK).max(axis=1)
                floor = max(floor, np.partition(peaks, len(peaks) - k)[len(peaks) - k])
            best = score[score >= floor]
            floor = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else floor
            low = max(floor, 0.0) - CLOSE
            if part == 0.0 or left[done] <= 0:
                near = np.flatnonzero((score >= low) & (score > 0))
                break
            if left[done] >= floor:
                continue
            near = np.flatnonzero(score + left[done] >= low)
            if len(near) <= FEW:
                break
            # What the terms left over can add in each block, by their largest weights there.
            t = terms[rare[done:]]
            sizes = self.top_starts[t + 1] - self.top_starts[t]
            at = _gather(self.top_starts[t], sizes)
            more = np.bincount(self.top_blocks[at], np.repeat(w[rare[done:]], sizes) * self.tops[at], blocks)
            near = near[score[near] + more[near // BLOCK] >= low]
            if len(near) <= FEW:
                break
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0)
        cosine = self._exact(near, terms, w, spread)
        order = np.lexsort((near, -cosine))
        near, cosine = near[order], cosine[order]
        keep = (cosine > 0) & (cosine >= (cosine[k - 1] if len(cosine) > k else 0))
        return near[keep], cosine[keep]

    def vote(self, bags: list[tuple[np.ndarray, np.ndarray]], less: list[tuple[int, float]] | None = None) -> list[tuple[float, list[int]]]:
        """For each bag the share of toxic votes and the nearest examples.  less: (class, weight) of the example itself, for leave-one-out."""
        prior = self.votes.sum(axis=0) + self.zero + 1e-9
        prior /= prior.sum()
        out: list = [None] * len(bags)
        filled = [i for i, b in enumerate(bags) if len(b[0])]
        for i, b in enumerate(bags):
            if not len(b[0]):
                votes = self.zero.copy()
                if less:
                    votes[less[i][0]] = max(0.0, votes[less[i][0]] - less[i][1])
                out[i] = (votes + prior, [])
        found = self.nearest([bags[i] for i in filled]) if len(self.ids) else [(np.zeros(0, np.int64), np.zeros(0))] * len(filled)
        for i, (v, c) in zip(filled, found):
            w = self.votes[v].copy()
            if less and len(c) and c[0] > 1 - 1e-8:
                w[0, less[i][0]] = max(0.0, w[0, less[i][0]] - less[i][1])
            out[i] = ((w * (c**2)[:, None]).sum(axis=0) + prior, self.ids[v[:3]].tolist())  # one vote by the base rate
        return [(float(votes[1] / votes.sum()), near) for votes, near in out]


@dataclass
class Model:
    """What was learnt; shared is the same on the executors."""

    examples: Examples
    slope: float
    shift: float
    shared: Broadcast | None = None


def _scores(examples: Examples, slope: float, shift: float, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
    found = examples.index.vote(bags)
    p = _sigmoid(slope * _logit(np.array([p for p, _ in found])) + shift)
    return list(zip(p.tolist(), (near for _, near in found)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _calibration(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels to votes by Newton steps."""
    beta, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = _sigmoid(design @ beta)
        grad = design.T @ (w * (y - p)) - 1e-3 * (beta - [1.0, 0.0])
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(0.05, float(beta[0])), float(beta[1])


def relevance(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Likelihood ratio statistic of terms that a of pos toxic and b of neg clean examples have."""
    part = lambda k, e: k * np.log(np.where(k > 0, k, 1) / np.where(e > 0, e, 1))
    rate = (a + b) / (pos + neg)
    return np.maximum(0.0, 2 * (part(a, pos * rate) + part(b, neg * rate) + part(pos - a, pos * (1 - rate)) + part(neg - b, neg * (1 - rate))))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row begins."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.ListArray) else pa.concat_arrays(whole.chunks)
    return whole.values.to_numpy(), whole.offsets.to_numpy()


def _bagged(docs: DataFrame, terms: Terms) -> DataFrame:
    """doc_id, fp (text_key), terms and counts (packed whole numbers) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms.hashes))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value  # what a worker has looked up serves its later tasks too
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = lookup.bags(part.column(2).to_pylist())
                packed = [pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *packed], ["doc_id", "fp", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("fp"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, fp long, terms binary, counts binary")


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in column]


def document_frequencies(bags: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The number of rows, and how many of them have each of n terms: one number a term from each partition, added by slices."""
    step = -(-n // SLICES) or 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(n, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=n)
        slices = [total[i : i + step].tobytes() for i in range(0, n, step)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array([-1, *range(len(slices))], pa.int32()), "counts": pa.array([np.array([rows], np.int64).tobytes(), *slices], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[s] = sums.get(s, 0) + np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "slice int, counts binary"
    parts = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in bags.select("terms").mapInArrow(released(count), schema).repartition("slice").mapInArrow(released(add), schema).collect()}
    rows = int(parts.pop(-1, np.zeros(1))[0])
    return rows, np.concatenate([parts[s] for s in sorted(parts)]) if parts else np.zeros(n, np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """What _fit learns."""
    return _fit(docs, labels, per_class)[0]


def _fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model | None, DataFrame | None]:
    """The model, and the bags of all of docs under its terms; None without labels of both classes.

    It learns from about per_class labelled documents of each class, chosen by a hash of doc_id.

    Rows that are held out are never looked at for labels.  Document
    frequencies come from all of docs.  Rows that repeat a doc_id with other
    texts are examples of their own; equal rows are one.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != {0, 1}:
        return None, None
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / n[1]))).otherwise(F.lit(min(1.0, per_class / n[0])))
    sample = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").distinct()  # the sample is bounded by per_class

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t) for t in batch.column(2).to_pylist()]
            hashes = [np.array([term_hash(t) for t in c], np.uint64).view(np.int64) for c in found]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "toxic": batch.column(1), "terms": pa.array(hashes, pa.list_(pa.int64())), "counts": pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))})

    held = written(chosen.mapInArrow(released(bags), "doc_id long, toxic int, terms array<long>, counts array<int>"), "examples")
    table = held.toArrow()  # bounded by per_class
    toxic, ids = table["toxic"].to_numpy().astype(np.int8), table["doc_id"].to_numpy().copy()
    if not {0, 1} <= set(toxic.tolist()):
        return None, None
    (hashes, begins), (counts, _) = _lists(table["terms"]), _lists(table["counts"])
    counts, hashes = counts.astype(np.min_scalar_type(counts.max() if len(counts) else 0)), hashes.view(np.uint64)
    del table
    terms = Terms(np.unique(hashes))
    place = np.empty(len(hashes), np.int32)
    for i in range(0, len(hashes), PIECE):  # the driver holds little more than the sample itself
        place[i : i + PIECE] = np.searchsorted(terms.hashes, hashes[i : i + PIECE])
    del hashes
    size, has = len(terms.hashes), np.zeros((2, len(terms.hashes)))
    order = np.lexsort((toxic, ids))
    for i in order:
        has[toxic[i]][place[begins[i] : begins[i + 1]]] += 1
    pos, neg = float((toxic == 1).sum()), float((toxic == 0).sum())
    weight = relevance(has[1], has[0], pos, neg)
    all_bags = written(_bagged(docs, terms), "bags")
    rows_all, df = document_frequencies(all_bags, size)
    weight *= np.log((1 + rows_all) / (1 + df)) + 1
    class_weight = (n[0] / neg, n[1] / pos)

    def examples() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i in order:
            own, times = place[begins[i] : begins[i + 1]], counts[begins[i] : begins[i + 1]]
            by = np.argsort(own)
            by = by[weight[own[by]] > 0]
            yield int(ids[i]), int(toxic[i]), own[by], times[by]

    learnt = Examples.of(terms.hashes, weight, examples(), class_weight)
    shared = docs.sparkSession.sparkContext.broadcast(learnt)  # bounded by per_class

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, index = shared.value.hashes, shared.value.index
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                own = []
                for h, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    t = np.searchsorted(terms, np.array(h, np.int64).view(np.uint64))
                    order = np.argsort(t)
                    order = order[index.weight_of[t[order]] > 0]
                    own.append((t[order], np.array(c, np.int64)[order]))
                y = part.column(0).to_pylist()
                found = index.vote(own, [(k, class_weight[k]) for k in y])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p for p, _ in found], pa.float64())], ["toxic", "vote"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    voted = held.select("toxic", "terms", "counts").repartition(tasks).mapInArrow(released(votes), "toxic int, vote double").toArrow()
    y, vote = voted["toxic"].to_numpy().astype(float), voted["vote"].to_numpy()
    order = np.lexsort((vote, y))
    y, vote = y[order], vote[order]
    slope, shift = _calibration(_logit(vote), y, np.where(y == 1, class_weight[1], class_weight[0]))
    del voted, place, counts, has, order
    give_back()
    return Model(learnt, slope, shift, shared), all_bags


def _score_bags(bags: DataFrame, model: Model) -> DataFrame:
    """doc_id, fp, score, neighbours of every bag."""
    shared, slope, shift = model.shared, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = _scores(shared.value, slope, shift, list(zip(_unpacked(part.column(2)), _unpacked(part.column(3)))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([s for s, _ in found], pa.float64()), pa.array([near for _, near in found], pa.list_(pa.int64()))], ["doc_id", "fp", "score", "neighbours"])

    return bags.mapInArrow(released(run), "doc_id long, fp long, score double, neighbours array<long>")


def _unscored(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("neighbours"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (0 to 1), neighbours (doc_ids of the nearest examples) of every row, from its whole text.

    Null, empty and wordless texts, and those that share no term with any
    example, take the rate of examples without terms and have no neighbours.
    Without a model every score is 0.
    """
    if model is None:
        return _unscored(docs)
    return _score_bags(_bagged(docs, model.examples.lookup), model).drop("fp")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that are not held out, then score all: doc_id, held_out, score, predicted, neighbours.

    One row for each row of docs, repeated ones too, each by its own whole
    text.  Null, empty and wordless texts take the rate of examples without
    terms.  Labels other than 0 and 1, and of ids that docs has not, teach
    nothing; an id labelled both ways is toxic.  A null doc_id is neither
    labelled nor held out.  Without labels of both classes every score is 0.
    An empty table gives an empty result; columns besides doc_id and text are
    not read.
    """
    model, bags = _fit(docs, labels)
    out = _unscored(docs) if model is None else _score_bags(bags, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose own text reaches the threshold; all columns stay.

    Every row is judged by itself, whatever other rows share its doc_id, and
    also without a doc_id.  Without a model nothing goes.
    """
    model, bags = _fit(docs, labels)
    if model is None:
        return docs
    kept = without(docs, _score_bags(bags, model).where(F.col("score") >= threshold))
    # What goes is written by now, and nothing reads the examples again.
    model.shared.destroy()
    del model, bags
    give_back()
    return kept
