"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import LOWER, Block, blocks, flag_table, hashed_sample, span_hasher, word_spans

LETTERS = flag_table((97, 122), (128, 255))
MARKS = flag_table((33, 47), (58, 64), (91, 96), (123, 126))
#: Digits and signs that stand for letters in obfuscated words.
STAND_IN = dict(zip(b"013457@$", b"oieastas"))
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[list(STAND_IN)] = list(STAND_IN.values())
#: Second-person pronouns of the corpus languages.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch tu toi te ton ta tes vous votre ti tú tus usted ustedes vos".split()

#: Labelled rows that the model is fitted on, at most about; entries that a lexicon may hold; rows that an entry needs.
TRAINING_ROWS, LEXICON_ROWS, LEAST_ROWS = 40_000, 20_000, 3
#: Words between a lexicon word and a pronoun that still count as near.
NEAR = 3
#: Forms of a word in the lexicons: the whole word, and its first bytes, which inflected and invented forms share.
PREFIXES = (0, 4, 5, 6)
#: Log-odds from which a form counts as toxic.
STRONG = 2.0


@dataclass
class Lexicon:
    """Hashes with weights, found through a bit table first."""

    keys: np.ndarray
    weights: np.ndarray
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        may = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(may) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == hashes[may], self.weights[at], 0.0)
        return out


def forms(hashes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A hash of each form of each word; the form's number is part of it."""
    out = []
    for number, first in enumerate(PREFIXES):
        stop = np.minimum(starts + first, ends) if first else ends
        with np.errstate(over="ignore"):
            out.append(hashes(starts, stop) * np.uint64(2 * number + 3))
    return out


def features(block: Block, lexicon: Lexicon) -> np.ndarray:
    """Dense features of each text; the number of columns is fixed."""
    rows, data = len(block), LOWER[block.data]
    low = Block(0, rows, data, block.at)
    starts, ends, owner = word_spans(low, LETTERS)
    hashes = span_hasher(data)
    n = np.bincount(owner, minlength=rows)
    per_word = 1 / np.maximum(n, 1)
    sums = lambda who, x: np.bincount(who, weights=x, minlength=rows)
    columns = []
    any_hit = np.zeros(len(starts), bool)
    for f in forms(hashes, starts, ends):
        w = lexicon.weigh(f)
        top = np.zeros(rows)
        np.maximum.at(top, owner[w > 0], w[w > 0])
        any_hit |= w > 0
        hits = sums(owner, w > 0)
        columns += [hits * per_word, np.log1p(hits), top]
    pronouns = np.array([pronoun_hash(p) for p in SECOND_PERSON], np.uint64)
    person = np.isin(hashes(starts, ends), pronouns)
    near = np.zeros(len(starts), bool)
    for k in range(1, NEAR + 1):
        near[k:] |= person[:-k] & (owner[k:] == owner[:-k])
        near[:-k] |= person[k:] & (owner[k:] == owner[:-k])
    columns += [sums(owner, near & any_hit) * per_word, sums(owner, person) * per_word]
    # Words written with stand-ins: read again with letters in their place.
    spelt = PLAIN[data]
    s2, e2, o2 = word_spans(Block(0, rows, spelt, block.at), LETTERS)
    changed = np.concatenate([[0], np.cumsum(spelt != data)])
    letters = np.concatenate([[0], np.cumsum(LETTERS[data])])
    masked = (changed[e2] > changed[s2]) & (letters[e2] - letters[s2] >= 2)
    s2, e2, o2 = s2[masked], e2[masked], o2[masked]
    again = lexicon.weigh(forms(span_hasher(spelt), s2, e2)[0]) if len(s2) else np.zeros(0)
    columns += [sums(o2, np.ones(len(s2))) * per_word, np.log1p(sums(o2, again > 0))]
    size = np.diff(block.at)
    of_byte = np.repeat(np.arange(rows), size)
    upper = (block.data >= 65) & (block.data <= 90)
    columns += [sums(of_byte, upper) / np.maximum(size, 1), sums(of_byte, MARKS[block.data]) / np.maximum(size, 1), sums(of_byte, block.data == 33) / np.maximum(size, 1), np.log1p(n)]
    return np.stack(columns, axis=1)


def pronoun_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hasher(raw)(np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Trees:
    """Boosted trees as arrays: per tree the feature, cut, and leaf values of a complete tree of equal depth."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > c[node])
            out += v[node - (len(v) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms; every level of a tree is split at once."""
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1 << depth)))
    edges = [np.unique(np.quantile(column[column > column.min()] if (column > column.min()).any() else column, np.linspace(0, 1, bins - 1)) - 1e-12) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1)
    raw, fs, cs, vs = np.full(len(y), model.base), [], [], []
    width = bins + 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, c, node = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), np.zeros(len(y), np.int64)
        for level in range(depth):
            many, first = 1 << level, (1 << level) - 1
            best, place = np.full(many, 1e-9), np.full((many, 2), -1)
            for j in range(x.shape[1]):
                slot = (node - first) * width + binned[:, j]
                left_g = np.cumsum(np.bincount(slot, weights=g, minlength=many * width).reshape(many, width), axis=1)
                left_h = np.cumsum(np.bincount(slot, weights=h, minlength=many * width).reshape(many, width), axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain = gain[:, : len(edges[j])]
                top = gain.argmax(axis=1)
                value = gain[np.arange(many), top]
                better = value > best
                best[better], place[better] = value[better], np.stack([np.full(many, j), top], axis=1)[better]
            for k, (j, b) in enumerate(place):
                f[first + k], c[first + k] = (j, edges[j][b]) if j >= 0 else (0, np.inf)
            at = f[node]
            node = 2 * node + 1 + (x[np.arange(len(x)), at] > c[node])
        leaf = node - ((1 << depth) - 1)
        value = -rate * np.bincount(leaf, weights=g, minlength=1 << depth) / (np.bincount(leaf, weights=h, minlength=1 << depth) + ridge)
        raw += value[leaf]
        fs.append(f), cs.append(c), vs.append(value)
    return Trees(model.base, np.array(fs), np.array(cs), np.array(vs))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of labels to raw scores (pool adjacent violators), with a pseudo-row of the mean in each pooled block."""
    order = np.argsort(raw, kind="stable")
    blocks_: list[list[float]] = []
    for r, v in zip(raw[order].tolist(), y[order].tolist()):
        blocks_.append([v, 1.0, r])
        while len(blocks_) > 1 and blocks_[-2][0] * blocks_[-1][1] >= blocks_[-1][0] * blocks_[-2][1]:
            total, n, at = blocks_.pop()
            last = blocks_[-1]
            last[2] = (last[2] * last[1] + at * n) / (last[1] + n)
            last[0], last[1] = last[0] + total, last[1] + n
    mean = float(y.mean())
    # The pseudo-row weighs more in a small block, so a later block may not fall below an earlier one.
    return np.array([b[2] for b in blocks_]), np.maximum.accumulate([(b[0] + mean) / (b[1] + 1) for b in blocks_])


@dataclass
class Model:
    """A lexicon, trees and a calibration; ``constant`` stands in where labels do not allow a fit."""

    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    constant: float = 0.0

    def score(self, block: Block) -> np.ndarray:
        if self.trees is None:
            return np.full(len(block), self.constant)
        raw = self.trees.raw(features(block, self.lexicon))
        if self.knots is None:
            return 1 / (1 + np.exp(-raw))
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)


def _labelled(docs: DataFrame, ids: np.ndarray, toxic: np.ndarray, work, schema: str) -> DataFrame:
    """Run ``work(block, labels)`` on the rows of the sample, where they lie: no text is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            key = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
            mine = np.flatnonzero(known & (ids[at] == key))
            texts = batch.column("text").take(pa.array(mine))
            for block in blocks(texts):
                yield work(block, toxic[at[mine]][block.first : block.last])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, *, training_rows: int = TRAINING_ROWS) -> Model:
    """Fit on about ``training_rows`` labelled rows at most, chosen by a hash of doc_id.

    Half of them give the lexicons, a quarter the trees, a quarter the calibration, so no stage is fitted on rows that
    an earlier one has seen. Ids and labels of the sample go to the tasks; their texts never leave them.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sorted((r.doc_id, int(r.toxic)) for r in hashed_sample(known, "doc_id", training_rows, known.count()).collect())
    nothing = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    if not sample:
        return Model(nothing, None, None)
    ids, toxic = (np.array(c, np.int64) for c in zip(*sample))
    share = float(toxic.mean())
    if share in (0.0, 1.0):
        return Model(nothing, None, None, share)
    part = (np.random.default_rng(1).permutation(len(ids)) % 4).astype(np.int64)

    def count(block: Block, label: np.ndarray) -> pa.RecordBatch:
        data = LOWER[block.data]
        starts, ends, owner = word_spans(Block(0, len(block), data, block.at), LETTERS)
        found = np.concatenate(forms(span_hasher(data), starts, ends)) if len(starts) else np.zeros(0, np.uint64)
        who = np.tile(owner, len(PREFIXES))
        order = np.lexsort((who, found))
        found, who = found[order], who[order]
        once = np.ones(len(found), bool)
        once[1:] = (found[1:] != found[:-1]) | (who[1:] != who[:-1])
        key, place = np.unique(found[once], return_inverse=True)
        bad = np.bincount(place, weights=label[who[once]], minlength=len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bad), pa.array(np.bincount(place, minlength=len(key)))], ["form", "toxic", "rows"])

    first = part < 2
    counts = _labelled(docs, ids[first], toxic[first], count, "form long, toxic long, rows long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    bad, good = int(toxic[first].sum()), int((1 - toxic[first]).sum())
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("rows") - F.col("toxic") + 0.5) / (good + 1))
    entries = counts.where(F.col("toxic") >= LEAST_ROWS).select("form", odds.alias("odds"), "toxic").where(F.col("odds") >= STRONG)
    entries = entries.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "form").limit(LEXICON_ROWS).collect()
    lexicon = Lexicon(np.array([r.form for r in entries], np.int64).view(np.uint64), np.array([r.odds for r in entries], np.float64))

    def measure(block: Block, label: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(features(block, lexicon).tolist(), pa.list_(pa.float64())), pa.array(label)], ["x", "y"])

    def rows(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = sorted((r.x, r.y) for r in _labelled(docs, ids[which], toxic[which], measure, "x array<double>, y long").collect())
        return np.array([g[0] for g in got]), np.array([g[1] for g in got], np.float64)

    x, y = rows(part >= 2)
    fit = np.random.default_rng(2).permutation(len(y)) % 2 == 0
    if not len(y) or not 0 < y[fit].mean() < 1:
        return Model(lexicon, None, None, share)
    trees = boost(x[fit], y[fit])
    held = ~fit
    knots = isotonic(trees.raw(x[held]), y[held]) if held.any() and 0 < y[held].mean() < 1 else None
    return Model(lexicon, trees, knots)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row: the calibrated probability that a text is toxic.

    Null and empty texts have all-zero features and get the model's score for these. Repeated rows get equal scores.
    An empty table gives no row. Without labels every score is 0; with labels of one kind only, it is their
    share. A text of any length counts whole. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(block)), pa.array(model.score(block))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
