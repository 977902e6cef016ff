"""Toxicity scores from gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a built-in lexicon and of one learned from the labelled sample (words that toxic
texts hold more often, by a z-score of log odds), how near second-person words are to lexicon words,
capitals, punctuation and its repetition, and obfuscation (symbols or digits inside words, and lexicon
words that appear once those are undone). Trees are grown on histograms of the features with logistic
loss; the calibration is fitted by isotonic regression on rows that the trees did not see.

The trees and the lexicon are fitted on at most ``fit_rows`` labelled rows, the first by a hash of their
id: a documented bound on what reaches the driver, whatever the input. Every text is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _bytes as B
from .language import fold

#: A built-in lexicon of insults and threats, and second-person words.
LEXICON = """idiot idiots moron morons stupid dumb fool fools loser losers trash garbage scum clown clowns worthless pathetic
disgusting hate kill die shut liar liars crap damn hell jerk coward cowards pig pigs freak ugly imbecile cretin dimwit
idiote idiota imbécil imbécile crétin dummkopf trottel estúpido estúpida tonto basura merde connard abschaum""".split()
SECOND_PERSON = "you your yours yourself u ur tu te ti toi vous votre du dich dir dein deine ihr euch usted tú vosotros".split()
FEATURES = [
    "log_words", "lexicon", "learned", "learned_weight", "learned_best", "learned_distinct", "hidden", "hidden_any", "person", "person_near", "lexicon_any",
    "capitals", "shouted", "exclamation", "question", "punctuation", "repeated", "inside", "digits_inside", "stretched", "word_length", "other_bytes", "learned_peak",
]
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Undoes the usual substitutions of letters; other marks are dropped.
_UNDO = B.LOWER.copy()
for _a, _b in zip(b"@4301$5!7", b"aaeoissit", strict=True):
    _UNDO[_a] = _b
_TERM = _ALPHA.copy()
_TERM[39] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(B.hash_words(data, np.concatenate([[0], ends[:-1]]), ends)) if words else np.zeros(0, B.U64)


def _among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def features(data: np.ndarray, offsets: np.ndarray, learned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """documents x FEATURES of a slice; learned: sorted word hashes and their weights."""
    n = len(offsets) - 1
    starts, ends, first = B.words(data, offsets, _TERM)
    doc = np.repeat(np.arange(n), np.diff(first))
    words = np.maximum(np.diff(first), 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    keys = B.hash_words(data, starts, ends, lower=True)
    per = lambda x: np.bincount(doc, weights=x, minlength=n)
    bad = _among(_hashes(LEXICON), keys)
    known = _among(learned[0], keys)
    weight = np.where(known, learned[1][np.minimum(np.searchsorted(learned[0], keys), max(0, len(learned[0]) - 1))] if len(learned[0]) else 0.0, 0.0)
    person = _among(_hashes(SECOND_PERSON), keys)
    at = lambda mask: np.bincount(np.searchsorted(offsets, np.flatnonzero(mask), "right") - 1, minlength=n)[:n].astype(float)
    offence = np.flatnonzero(bad | known)
    near = np.zeros(len(keys), bool)
    you = np.flatnonzero(person)
    if len(offence) and len(you):
        right = np.minimum(np.searchsorted(you, offence), len(you) - 1)
        left = np.maximum(right - 1, 0)
        near[offence] = np.minimum(np.where(doc[you[right]] == doc[offence], np.abs(you[right] - offence), 99), np.where(doc[you[left]] == doc[offence], np.abs(you[left] - offence), 99)) <= 5
    # tokens between blanks: what stands inside them, and what they spell once undone
    ts, te, tf = B.words(data, offsets)
    tdoc = np.repeat(np.arange(n), np.diff(tf))
    alpha, mark, digit = _ALPHA[data], _MARK[data], _DIGIT[data]
    inner = np.zeros(len(data), bool)
    inner[1:-1] = alpha[:-2] & alpha[2:]
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    odd, num = sums(inner & mark & (data != 39) & (data != 45)), sums(inner & digit)
    token_odd, token_num = (odd[te] - odd[ts]) > 0, (num[te] - num[ts]) > 0
    undone = _UNDO[data]
    keep = _ALPHA[undone] | B.IS_SPACE[data]
    moved = sums(keep)
    us, ue, uf = B.words(undone[keep], moved[offsets])
    udoc = np.repeat(np.arange(n), np.diff(uf))
    spelt = B.hash_words(undone[keep], us, ue)
    seen = np.bincount(udoc, weights=_among(_hashes(LEXICON), spelt) | _among(learned[0], spelt), minlength=n)
    hidden = np.maximum(0, seen - per(bad | known))
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    upper = _UPPER[data]
    caps = sums(upper)
    shouted = ((caps[ends] - caps[starts]) == ends - starts) & (ends - starts >= 3)
    run = np.zeros(len(data), bool)
    run[1:] = mark[1:] & mark[:-1]
    which = np.unique(np.stack([doc[known], keys[known].view(np.int64)]), axis=1) if known.any() else np.zeros((2, 0), np.int64)
    peak = np.zeros(n)
    if known.any():  # the most learned words among any 50
        total, here = sums(known), np.flatnonzero(known)
        stop = np.minimum(here + 50, first[doc[here] + 1])
        np.maximum.at(peak, doc[here], total[stop] - total[here])
    best = np.zeros(n)
    np.maximum.at(best, doc, weight)
    columns = [
        np.log1p(np.diff(first)), per(bad) / words, per(known) / words, per(weight) / words, best, np.log1p(np.bincount(which[0], minlength=n)), hidden / words, hidden > 0,
        per(person) / words, per(near) / words, per(bad | known) > 0, at(upper) / size, per(shouted) / words, at(data == 33) / size, at(data == 63) / size, at(mark) / size, at(run) / size,
        np.bincount(tdoc, weights=token_odd, minlength=n) / words, np.bincount(tdoc, weights=token_num, minlength=n) / words, at(same & alpha) / size, per((ends - starts).astype(float)) / words,
        at(data >= 128) / size, peak,
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


class Boosted:
    """Binary trees on binned features, fitted by Newton steps of the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        self.model, score = [], np.full(len(y), self.base)
        for _ in range(self.trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(code, p - y, np.maximum(p * (1 - p), 1e-6))
            self.model.append(tree)
            score += self._walk(tree, code)
        return self

    def _grow(self, code, g, h):
        leaves = 1 << self.depth
        feature, cut, value = np.full(leaves, -1), np.zeros(leaves, int), np.zeros(2 * leaves)
        node = np.ones(len(g), int)
        width = self.bins + 1
        for level in range(self.depth):
            low = 1 << level
            here = node - low
            best = np.zeros(low)
            for f in range(code.shape[1]):
                cell = here * width + code[:, f]
                G = np.bincount(cell, weights=g, minlength=low * width).reshape(low, width).cumsum(1)
                H = np.bincount(cell, weights=h, minlength=low * width).reshape(low, width).cumsum(1)
                gt, ht = G[:, -1:], H[:, -1:]
                gain = G**2 / (H + self.ridge) + (gt - G) ** 2 / (ht - H + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(H < 2) | (ht - H < 2)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(low), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[low + i], cut[low + i] = top[i], f, k[i]
            f = feature[node]
            node = 2 * node + np.where(f >= 0, code[np.arange(len(node)), np.maximum(f, 0)] > cut[node], 0)
        G, H = np.bincount(node, weights=g, minlength=2 * leaves), np.bincount(node, weights=h, minlength=2 * leaves)
        value = -self.rate * G / (H + self.ridge)
        return feature, cut, value

    def _walk(self, tree, code):
        feature, cut, value = tree
        node = np.ones(len(code), int)
        for _ in range(self.depth):
            f = feature[node]
            node = 2 * node + np.where(f >= 0, code[np.arange(len(node)), np.maximum(f, 0)] > cut[node], 0)
        return value[node]

    def decide(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        out = np.full(len(x), self.base)
        for tree in self.model:
            out += self._walk(tree, code)
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to score (pool adjacent violators); equal scores are one block from the start."""
    values, of, times = np.unique(score, return_inverse=True, return_counts=True)
    means = np.bincount(of, weights=y, minlength=len(values)) / np.maximum(times, 1)
    blocks: list[list[float]] = []
    for s, v, n in zip(values.tolist(), means.tolist(), times.tolist(), strict=True):
        blocks.append([v, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = [(x, b[0]) for b in blocks for x in dict.fromkeys((b[2], b[3]))]
    return np.array([x for x, _ in knots]), np.array([v for _, v in knots])


class Model:
    """Lexicon, trees and calibration. A score is 0.98 of the calibrated value and 0.02 of the trees' own logistic one, which keeps the order within a step of the calibration."""

    def __init__(self, learned, trees: Boosted | None, knots):
        self.learned, self.trees, self.knots = learned, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), 0.5)
        raw = self.trees.decide(x)
        own = 1 / (1 + np.exp(-raw))
        fitted = np.interp(raw, *self.knots) if len(self.knots[0]) else own
        return np.clip(0.98 * fitted + 0.02 * own, 0, 1)  # the share of its own keeps the order within a step


def _measure(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                x = features(data, offsets, learned)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in columns], pa.array([r.tobytes() for r in x], pa.binary())], [*columns, "x"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in B.text_slices(batch.column("text")):
                s = model.score(features(data, offsets, model.learned))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label a word occurs."""
    tally: dict[int, list[int]] = {}
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for lo, _hi, data, offsets in B.text_slices(batch.column("text")):
            starts, ends, first = B.words(data, offsets, _TERM)
            keys = B.hash_words(data, starts, ends, lower=True)
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pair = np.unique(np.stack([keys.view(np.int64), doc]), axis=1)
            for k, d in zip(pair[0].tolist(), label[lo + pair[1]].tolist(), strict=True):
                tally.setdefault(k, [0, 0])[int(d)] += 1
    rows = [(k, a, b) for k, (a, b) in tally.items()]
    for i in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 50_000], strict=True)], ["word", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, lexicon_words: int = 400, seed: int = 7) -> Model:
    """labels: doc_id, toxic (0 or 1; a document with several takes the larger, nulls do not count).

    Where there are more labelled ids than ``fit_rows``, those below a threshold of a hash are taken, which
    is set so that their number stays below the bound by four standard deviations. Of rows that share a
    doc_id one text is learned from, the first in order.
    """
    spark = docs.sparkSession
    label = B.cut(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    known, range_ = label.count(), 1 << 40
    below = range_ if known <= fit_rows else int(range_ * max(0.0, fit_rows - 4 * fit_rows**0.5) / known)
    h = F.xxhash64("doc_id", F.lit(seed))
    some = label.where(F.pmod(F.shiftright(h, 8), F.lit(range_)) < below).select("doc_id", "toxic", (F.pmod(h, F.lit(4)) == 0).alias("later"))
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic", "later").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    texts = B.cut(texts)
    early = texts.where("not later")
    totals = {r.toxic: r.n for r in early.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = totals.get(0, 0), totals.get(1, 0)
    learned = np.zeros(0, B.U64), np.zeros(0)
    if a and b:
        counts = early.mapInArrow(_words, "word long, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where("t >= 5")
        odds = F.log((F.col("t") + 0.5) / (b - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (a - F.col("c") + 0.5))
        z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
        top = counts.select("word", odds.alias("odds"), z.alias("z")).where("z > 4 and odds > 1").orderBy(F.desc("z"), "word").limit(lexicon_words).collect()
        key = np.array([r.word for r in top], np.int64).view(B.U64)
        order = np.argsort(key)
        learned = key[order], np.array([r.odds for r in top], float)[order]
    shared = spark.sparkContext.broadcast(learned)
    rows = texts.mapInArrow(_measure(shared, ["doc_id", "toxic", "later"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, later boolean, x binary").toPandas()
    rows = rows.sort_values(["doc_id"], kind="stable")
    if not len(rows):
        return Model(learned, None, (np.zeros(0), np.zeros(0)))
    x, y, later = np.stack([np.frombuffer(v, float) for v in rows["x"]]), rows["toxic"].to_numpy(float), rows["later"].to_numpy(bool)
    y = (y > 0).astype(float)
    trees = Boosted().fit(x[~later], y[~later])
    return Model(learned, trees, isotonic(trees.decide(x[later]), y[later]))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1; see ``Model``) and predicted (1 from 0.5) of every text of docs (doc_id, text).

    Null and empty texts have the features of no words and a score like any other. Rows without or with
    equal doc_id are scored each by itself. With nothing to learn from, every score is 0.5. An empty table
    gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {kind}, score double, predicted int")


def op4_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; labels are learned outside fold 0 of 5."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(fold(5) != 0))
    return score_toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
