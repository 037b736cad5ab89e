"""Quality by weak labels: expectation-maximisation weighs heuristic labellers, their posterior trains a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import Block, blocks, flag_table, hashed_sample, mixed, span_hashes, word_spans

#: Bytes that separate words, and classes of the others.
TOKEN = ~flag_table((0x20, 0x20), (0x09, 0x0D))
UPPER, DIGIT = flag_table((65, 90)), flag_table((48, 57))
LETTER = flag_table((65, 90), (97, 122), (128, 255))
#: Marks that end or join clauses in prose. Every other mark counts as a symbol.
PROSE_MARK = flag_table(*((ord(c), ord(c)) for c in ".,;:?'\"()-"))
SYMBOL = ~(LETTER | DIGIT | PROSE_MARK) & TOKEN
STOP = flag_table((0x2E, 0x2E), (0x3F, 0x3F), (0x21, 0x21))

#: Bytes of text that a kernel handles at once: it holds about ten numbers of 8 bytes for each.
BLOCK_BYTES = 1 << 20
#: Documents that the linear scorer is fitted on, and its size.
TRAINING_ROWS, FEATURES = 3000, 1 << 17
VOTES = ("symbols", "repeats", "capitals", "pairs", "lone_marks", "short_words", "sentences")


@dataclass
class Tokens:
    """Tokens of a block with what the labellers and the scorer look at."""

    owner: np.ndarray
    n: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    same: np.ndarray
    symbol_bytes: np.ndarray
    bytes_of: np.ndarray
    upper: np.ndarray
    letters: np.ndarray
    short: np.ndarray
    lone: np.ndarray
    stops: np.ndarray


def tokens_of(block: Block) -> Tokens:
    data, rows = block.data, len(block)
    starts, ends, owner = word_spans(block, TOKEN)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=sums[1:])
        return sums[ends] - sums[starts]

    length, upper, digit, letter, symbol = ends - starts, count(UPPER), count(DIGIT), count(LETTER), count(SYMBOL)
    word = span_hashes(data, starts, ends)
    same = np.zeros(len(starts), bool)
    if len(starts):
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    first_upper = UPPER[data[starts]] if len(starts) else same
    case = np.where(upper == 0, 0, np.where(upper * 2 > length, 2, np.where(first_upper, 1, 3)))
    last = data[ends - 1] if len(starts) else np.zeros(0, np.uint8)
    size = np.searchsorted([2, 4, 8], length, side="right")
    shape = (((case * 2 + (digit > 0)) * 3 + np.minimum(symbol, 2)) * 2 + PROSE_MARK[last]) * 4 + size
    sums = lambda x: np.bincount(owner, weights=x, minlength=rows)
    return Tokens(
        owner, np.bincount(owner, minlength=rows), shape, word, same, sums(symbol), sums(length), sums(upper), sums(letter),
        sums((letter > 0) & (length <= 3)), sums((letter == 0) & (digit == 0)), sums(STOP[last]),
    )


def votes(block: Block) -> np.ndarray:
    """A column per labeller: 1 good, -1 bad, 0 abstains. Texts of under eight tokens only have their marks and case judged."""
    t = tokens_of(block)
    n, rows = np.maximum(t.n, 1), len(block)
    enough = t.n >= 8
    pair = np.zeros(len(t.word), np.uint64)
    if len(pair):
        with np.errstate(over="ignore"):
            pair[1:] = mixed(t.word[1:] * np.uint64(3) + t.word[:-1])
        pair[np.flatnonzero(np.diff(t.owner, prepend=-1))] = 0
    # 22 bits name the text (a block has no more tokens than 4 MB can hold) and 42 the pair.
    key = np.sort((t.owner.astype(np.uint64) << np.uint64(42)) | (pair >> np.uint64(22)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(42)).astype(np.int64), minlength=rows) / n
    repeats = np.bincount(t.owner, weights=t.same, minlength=rows) / n

    def judge(bad: np.ndarray, good: np.ndarray, when: np.ndarray) -> np.ndarray:
        return np.where(when, np.where(bad, -1, np.where(good, 1, 0)), 0)

    symbols, capitals = t.symbol_bytes / np.maximum(t.bytes_of, 1), t.upper / np.maximum(t.letters, 1)
    lone, short, stops = t.lone / n, t.short / n, t.stops / n
    any_words = t.n > 0
    return np.stack(
        [
            judge(symbols > 0.1, symbols < 0.02, any_words),
            judge(repeats > 0.2, repeats < 0.05, enough),
            judge(capitals > 0.5, capitals < 0.15, any_words),
            judge(distinct < 0.5, distinct > 0.8, enough),
            judge(lone > 0.15, lone < 0.02, any_words),
            judge(short < 0.04, (short > 0.12) & (short < 0.7), enough),
            judge((stops < 0.004) | (stops > 0.6), (stops > 0.01) & (stops < 0.4), t.n >= 40),
        ],
        axis=1,
    ).astype(np.int64)


def pattern_of(v: np.ndarray) -> np.ndarray:
    """The votes of a text as one number, a base-3 digit per labeller."""
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def fit_labellers(patterns: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Posterior probability of good for each vote pattern, and each labeller's estimated accuracy when it votes.

    Labellers are taken as independent given the class. The first posterior is the share of good votes; smoothing of
    one pseudo-vote per outcome keeps a labeller that never errs on the data from being trusted without limit.
    """
    codes = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[c] for c in codes], np.float64)
    m = len(VOTES)
    digit = (codes[:, None] // 3 ** np.arange(m)) % 3
    good, bad = (digit == 2).sum(1), (digit == 0).sum(1)
    post = (good + 0.5) / (good + bad + 1.0)
    prior, table = 0.5, np.zeros((2, m, 3))
    for _ in range(rounds):
        for c, p in ((1, post), (0, 1 - post)):
            for v in range(3):
                table[c, :, v] = ((digit == v) * (weight * p)[:, None]).sum(0) + 1
            table[c] /= table[c].sum(axis=1, keepdims=True)
        prior = ((weight * post).sum() + 1) / (weight.sum() + 2)
        # An abstention is no evidence: only votes speak, so texts too short to be judged keep the prior.
        spoken = digit != 1
        like = [np.where(spoken, np.log(np.take_along_axis(table[c][None].repeat(len(codes), 0), digit[:, :, None], 2)[:, :, 0]), 0).sum(1) for c in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1] + np.log((1 - prior) / prior), -50, 50)))
    right = prior * table[1, :, 2] + (1 - prior) * table[0, :, 0]
    wrong = prior * table[1, :, 0] + (1 - prior) * table[0, :, 2]
    return dict(zip(codes.tolist(), post.tolist())), right / (right + wrong)


def feature_ids(t: Tokens) -> list[np.ndarray]:
    """Hashed features of each token: its shape, its shape after the previous one's, its letters, and whether it repeats."""
    previous = np.concatenate([[-1], t.shape[:-1]]) if len(t.shape) else t.shape
    fold = lambda x, salt: (mixed(x.astype(np.uint64) * np.uint64(8) + np.uint64(salt)) % np.uint64(FEATURES)).astype(np.int64)
    return [fold(t.shape, 1), fold((previous + 1) * 1024 + t.shape, 2), fold(t.word >> np.uint64(8), 3), fold(t.same, 4)]


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias) on sparse shares and posterior labels, by Adagrad on all rows."""
    weights, speed = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    if not rows:
        return weights
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    ids, share = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    label = np.array([r[2] for r in rows])
    # Both classes weigh the same, however rare one is.
    balance = label / max(label.sum(), 1e-9) + (1 - label) / max((1 - label).sum(), 1e-9)
    for _ in range(rounds):
        logit = np.bincount(at, weights=weights[ids] * share, minlength=len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) * balance
        slope = np.append(np.bincount(ids, weights=error[at] * share, minlength=FEATURES), error.sum()) + ridge * weights / len(rows)
        speed += slope**2
        weights -= 0.5 * slope / np.sqrt(speed)
    return weights


def learn(docs: DataFrame, *, training_rows: int = TRAINING_ROWS) -> np.ndarray:
    """Weights of the scorer.

    All rows vote on all rows: seven overlapping labellers judge every whole text, and the counts of their vote patterns
    (at most 3 ** 7) are what expectation-maximisation sees. The scorer is then fitted on about ``training_rows``
    rows chosen by a hash of doc_id (of the text where it is null), with posteriors as labels. No given label is used.
    """
    slim = docs.select("doc_id", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                codes, counts = np.unique(pattern_of(votes(block)), return_counts=True)
                for c, n in zip(codes.tolist(), counts.tolist()):
                    seen[c] = seen.get(c, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["pattern", "n"])

    counted = slim.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = {r.pattern: r.n for r in counted.collect()}
    posterior, _ = fit_labellers(patterns) if patterns else ({}, None)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                t, label = tokens_of(block), pattern_of(votes(block))
                ids = np.concatenate(feature_ids(t))
                at = np.tile(t.owner, 4)
                key, n = np.unique(at * FEATURES + ids, return_counts=True)
                row = key // FEATURES
                cuts = np.searchsorted(row, np.arange(len(block) + 1))
                share = n / t.n[row]
                found = [[(key[a:b] % FEATURES).tolist(), share[a:b].tolist()] for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array(label)],
                    ["doc_id", "ids", "share", "pattern"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = hashed_sample(slim, "doc_id", training_rows, sum(patterns.values()), spare="text").mapInArrow(features, f"doc_id {kind}, ids array<long>, share array<double>, pattern long")
    rows = sorted(((r.doc_id, r.ids, r.share, posterior[r.pattern]) for r in sample.collect() if r.ids), key=lambda r: (r[0] is None, r[0], r[1]))
    return fit_scorer([(np.array(r[1], np.int64), np.array(r[2]), r[3]) for r in rows])


def scores(block: Block, weights: np.ndarray) -> np.ndarray:
    """The probability that each text is well-formed prose; it depends on the text alone."""
    t = tokens_of(block)
    total = np.zeros(len(block))
    for ids in feature_ids(t):
        total += np.bincount(t.owner, weights=weights[ids], minlength=len(block))
    value = 1 / (1 + np.exp(-np.clip(total / np.maximum(t.n, 1) + weights[-1], -30, 30)))
    return np.where(t.n > 0, value, 0.0)


def quality(docs: DataFrame, *, training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, keep`` per row: the probability that a text is well-formed prose, and whether it passes.

    The scorer that ``learn`` fits scores every row, also one with a null doc_id.

    Null, empty and blank texts have score 0 and do not pass. Repeated rows get equal scores. An empty table gives no
    row. A text of any length counts whole. Other columns are ignored.
    """
    weights = learn(docs, training_rows=training_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                value = scores(block, weights)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(block)), pa.array(value), pa.array(value >= threshold)], ["doc_id", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def without_low_quality(docs: DataFrame, *, training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that pass. Each row is judged by its own text, whatever its doc_id, also a null one."""
    weights = learn(docs, training_rows=training_rows)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                yield batch.slice(block.first, len(block)).filter(pa.array(scores(block, weights) >= threshold))

    return docs.mapInArrow(passing, docs.schema)
