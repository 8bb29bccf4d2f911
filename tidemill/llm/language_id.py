"""Language identification: known words first, then ever shorter n-grams.

A text's words are scored by their log frequency in each language.  A word
that was not learnt falls back to its character n-grams, longest first; the
first length of which any gram was learnt gives the word's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import held_out

WORDS = re.compile(r"[^\W\d_]+")
#: Bound of the sample that is learnt from; its statistics are whole.  Letters of the longest n-gram.
DOCS_PER_LANG, LONGEST_GRAM = 3000, 4
#: Scored words that a worker remembers.
CACHE = 300_000


class Model:
    """Log frequencies per language of words and of n-grams, as rows of one matrix."""

    def __init__(self, langs: list[str], tokens: list[str], of: list[str], times: list[int], prior: dict[str, int]):
        """tokens, the languages they were seen in, and how often; a token is a word, or n NUL signs before an n-gram."""
        self.langs = langs
        at = {g: i for i, g in enumerate(langs)}
        self.index: dict[str, int] = {}
        for token in tokens:
            self.index.setdefault(token, len(self.index))
        counts = np.zeros((len(self.index), len(langs)))
        np.add.at(counts, (np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens)), np.fromiter(map(at.__getitem__, of), np.int64, len(of))), times)
        kind = np.array([len(t) - len(t.lstrip("\0")) for t in self.index])
        for k in set(kind.tolist()):
            own = kind == k
            counts[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * (own.sum() + 1)))
        self.logs = counts
        total = sum(prior.values())
        self.prior = np.array([math.log(prior[g] / total) for g in langs]) if langs else np.zeros(0)
        self.longest = int(kind.max()) if len(kind) else 0

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of the word's longest known n-grams; zeros (no evidence) if none is known."""
        marked = f"<{word}>"
        for n in range(min(self.longest, len(marked)), 0, -1):
            zeros = "\0" * n
            found = [r for i in range(len(marked) - n + 1) if (r := self.index.get(zeros + marked[i : i + n])) is not None]
            if found:
                return self.logs[found].mean(axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Sums over words, with the scores of words seen lately kept as matrix rows."""

    def __init__(self, model: Model):
        self.model = model
        self.known = {t: i for t, i in model.index.items() if not t.startswith("\0")}
        self.reset()

    def reset(self) -> None:
        self.rows, self.size = dict(self.known), len(self.model.logs)
        self.matrix = np.vstack([self.model.logs, np.zeros((CACHE, len(self.model.langs)))])

    def sums(self, word_lists: list[list[str]]) -> np.ndarray:
        """Per list the sum of its words' log frequencies."""
        out = np.zeros((len(word_lists), len(self.model.langs)))
        for i, ws in enumerate(word_lists):
            for part in (ws[j : j + CACHE // 2] for j in range(0, len(ws), CACHE // 2)):
                unseen = {w for w in part if w not in self.rows}
                if self.size + len(unseen) > len(self.matrix):
                    self.reset()
                    unseen = {w for w in part if w not in self.rows}
                for w in unseen:
                    self.matrix[self.size] = self.model.backoff(w)
                    self.rows[w] = self.size
                    self.size += 1
                out[i] += self.matrix[[self.rows[w] for w in part]].sum(axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lists = [WORDS.findall(t.lower()) if t else [] for t in texts]
        lists = [ws if any(map(str.isalpha, ws)) or any(c.isalpha() for c in chain(*ws)) else [] for ws in lists]
        if not self.model.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        n = np.array([len(ws) for ws in lists])
        logit = self.sums(lists) + self.model.prior
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.model.langs[b] if k else "und" for b, k in zip(best, n)], np.where(n > 0, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Learn from about docs_per_lang documents of each language, chosen by a hash of doc_id, or from all if there are fewer.

    docs must hold only rows that may be learnt from.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    prior = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in prior.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / n))).otherwise(share)
    sample = labelled.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = [], []
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = WORDS.findall(t.lower())
                word += ws
                lang += [g] * len(ws)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "token": pa.array(word, pa.string())})

    words = sample.select("lang", "text").mapInArrow(counted, "lang string, token string").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    marked = words.withColumn("m", F.concat(F.lit("<"), "token", F.lit(">")))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LONGEST_GRAM), F.length("m")))
    gram = F.explode(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length("m") - k + 1), lambda i: F.concat(F.repeat(F.lit("\0"), k), F.substring(F.col("m"), i, k))))))
    grams = marked.select("lang", "n", gram.alias("token")).groupBy("lang", "token").agg(F.sum("n").alias("n"))

    rows = words.union(grams.select("lang", "token", "n")).toArrow()  # bounded by the sample
    return Model(sorted(prior), rows["token"].to_pylist(), rows["lang"].to_pylist(), rows["n"].to_numpy(), prior)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learnt.  Among equal scores the language first in alphabetical order wins.
    The score is the winner's posterior probability.  Equal texts get equal
    results, and rows that repeat come as often as they are there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, then identify all: doc_id, held_out, lang_pred, score.

    One row for each row of docs, repeated ones too; a null doc_id is not held
    out.  Rows with a null lang teach nothing.  Texts are read whole, however
    long.  An empty table gives an empty result; other columns than doc_id,
    text and lang are not read, whatever their names.
    """
    model = fit(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
