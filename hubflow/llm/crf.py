"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import LOWER, Block, blocks, flag_table, span_hasher, word_spans, written

LETTERS = flag_table((97, 122), (128, 255))
#: Words of a chain; a longer text is several chains. Hashed features.
CHAIN, FEATURES = 32, 1 << 16
#: Documents that the model is fitted on, about, but one of each language at least; chains of each.
TRAINING_ROWS, CHAINS_PER_ROW = 1200, 4
#: Rows of a language from which few are chosen exactly; posteriors of words by language that are held at once.
SPARE_ROWS, POSTERIORS_AT_ONCE = 20, 1 << 24


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and feature of every (word, feature) pair: the word itself as lexicon entry, affixes of one to three bytes, and byte n-grams of two and three."""
    hashes, words, ids = span_hasher(data), [], []
    every = np.arange(len(starts))

    def add(who: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> None:
        with np.errstate(over="ignore"):
            h = hashes(a, b) * np.uint64(2 * kind + 1)
        words.append(who)
        ids.append((h >> np.uint64(48)).astype(np.int64))

    add(every, starts, ends, 0)
    for n in (1, 2, 3):
        add(every, starts, np.minimum(starts + n, ends), n)
        add(every, np.maximum(ends - n, starts), ends, 3 + n)
    for n in (2, 3):
        many = np.maximum(ends - starts - n + 1, 0)
        who = np.repeat(every, many)
        at = np.repeat(starts, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        add(who, at, at + n, 6 + n)
    return np.concatenate(words), np.concatenate(ids)


@dataclass
class Chain:
    """Weights of the field: features by language, transitions between languages of neighbouring words, and starts.

    Only features that training has seen have a row in ``weights``; ``place`` gives it, and the last row, of zeros, for all others.
    """

    languages: list[str]
    place: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def emissions(self, n: int, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ids = self.place[ids]
        return np.stack([np.bincount(words, weights=self.weights[ids, k], minlength=n) for k in range(len(self.languages))], axis=1)

    def forward_backward(self, scores: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of each language for each word (chains, words, languages), with the parts that pair marginals need."""
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a = np.exp(self.moves - self.moves.max())
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[:, 0] = e[:, 0] * np.exp(self.begin - self.begin.max())
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, e.shape[1]):
            step = (forward[:, t - 1] @ a) * e[:, t]
            forward[:, t] = step / step.sum(axis=1, keepdims=True)
        for t in range(e.shape[1] - 2, -1, -1):
            step = (e[:, t + 1] * backward[:, t + 1]) @ a.T
            step /= step.sum(axis=1, keepdims=True)
            backward[:, t] = np.where((t < length - 1)[:, None], step, 1.0)
        post = forward * backward
        return post / post.sum(axis=2, keepdims=True), forward, backward, e

    def label(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of each language over the words of each text, and the number of words."""
        rows, data = len(block), LOWER[block.data]
        starts, ends, owner = word_spans(Block(0, rows, data, block.at), LETTERS)
        many = np.bincount(owner, minlength=rows)
        if not len(starts):
            return np.zeros((rows, len(self.languages))), many
        whole = span_hasher(data)(starts, ends)
        _, first, back = np.unique(whole, return_index=True, return_inverse=True)
        known = self.emissions(len(first), *word_features(data, starts[first], ends[first]))
        nth = np.arange(len(starts)) - (np.cumsum(many) - many)[owner]
        chains = -(-many // CHAIN)
        chain = (np.cumsum(chains) - chains)[owner] + nth // CHAIN
        out = np.empty((len(starts), len(self.languages)))
        total = int(chains.sum())
        step = min(4096, max(1, POSTERIORS_AT_ONCE // (CHAIN * len(self.languages))))
        for at in range(0, total, step):  # a block of chains at a time
            mine = slice(*np.searchsorted(chain, [at, at + step]))
            c, t = chain[mine] - at, nth[mine] % CHAIN
            scores = np.zeros((min(step, total - at), CHAIN, len(self.languages)))
            scores[c, t] = known[back[mine]]
            out[mine] = self.forward_backward(scores, np.bincount(c, minlength=len(scores)))[0][c, t]
        sums = np.stack([np.bincount(owner, weights=out[:, k], minlength=rows) for k in range(out.shape[1])], axis=1)
        return sums / np.maximum(many, 1)[:, None], many


def fit(chains: list[tuple[list[bytes], str]], rounds: int = 50, ridge: float = 1e-3) -> Chain:
    """Maximise the conditional likelihood by Adagrad.

    A labelled text speaks one language, which would teach that languages never change. So every second training
    chain is spliced with the end of another one, at a random word, which makes transitions learnable.
    """
    languages = sorted({lang for _, lang in chains})
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(11)
    words: dict[bytes, int] = {}
    token, label, length = (np.zeros((len(chains), CHAIN), np.int64) for _ in range(3))
    length = np.zeros(len(chains), np.int64)
    other = rng.permutation(len(chains))
    for i, (own, lang) in enumerate(chains):
        mixed_in, lang2 = chains[other[i]]
        cut = int(rng.integers(1, len(own) + 1)) if i % 2 else len(own)
        row = [(w, lang) for w in own[:cut]] + [(w, lang2) for w in mixed_in[: CHAIN - cut] if i % 2]
        length[i] = len(row)
        token[i, : len(row)] = [words.setdefault(w, len(words)) for w, _ in row]
        label[i, : len(row)] = [number[x] for _, x in row]
    raw = b" ".join(words)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    who, ids = word_features(np.frombuffer(raw, np.uint8), starts, starts + sizes)
    seen = np.unique(ids)
    place = np.full(FEATURES, len(seen))
    place[seen] = np.arange(len(seen))
    many = len(languages)
    model = Chain(languages, place, np.zeros((len(seen) + 1, many)), np.zeros((many, many)), np.zeros(many))
    inside = np.arange(CHAIN)[None, :] < length[:, None]
    speed = [np.full_like(x, 1e-6) for x in (model.weights, model.moves, model.begin)]
    n = float(inside.sum())
    step = max(1, POSTERIORS_AT_ONCE // (CHAIN * many))
    parts = [slice(at, at + step) for at in range(0, len(chains), step)]
    for _ in range(rounds):
        emitted, a = model.emissions(len(words), who, ids), np.exp(model.moves - model.moves.max())
        of_word, of_move, of_begin = np.zeros((len(words), many)), np.zeros((many, many)), np.zeros(many)
        for part in parts:  # a block of chains at a time, all of them in every round
            ins, tok = inside[part], token[part]
            truth = np.eye(many)[label[part]] * ins[:, :, None]
            joined = ins[:, 1:]
            post, f, b, e = model.forward_backward(emitted[tok] * ins[:, :, None], length[part])
            # Expected pairs: forward of a word, move, emission and backward of the next, each pair summing to one.
            after = e[:, 1:] * b[:, 1:]
            whole = ((f[:, :-1] @ a) * after).sum(axis=2)
            of_move += np.tensordot(truth[:, :-1] * joined[:, :, None], truth[:, 1:], ([0, 1], [0, 1]))
            of_move -= np.tensordot(f[:, :-1] * (joined / whole)[:, :, None], after, ([0, 1], [0, 1])) * a
            of_begin += (truth[:, 0] - post[:, 0]).sum(axis=0)
            error, flat = (truth - post * ins[:, :, None]).reshape(-1, many), tok.ravel()
            of_word += np.stack([np.bincount(flat, weights=error[:, k], minlength=len(words)) for k in range(many)], axis=1)
        slope = np.stack([np.bincount(place[ids], weights=of_word[who, k], minlength=len(seen) + 1) for k in range(many)], axis=1)
        slopes = [slope / n - ridge * model.weights / n, of_move / n, of_begin / n]
        for x, g, s in zip((model.weights, model.moves, model.begin), slopes, speed):
            s += g**2
            x += 0.3 * g / np.sqrt(s)
    return model


def learn(docs: DataFrame, *, training_rows: int = TRAINING_ROWS) -> Chain | None:
    """Fit on about ``training_rows`` rows with a language, but on one of every language at least, chosen by a hash of doc_id, and on ``CHAINS_PER_ROW`` chains spread over each text."""
    named = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    per_lang = written(named.groupBy("lang").agg(F.count("*").alias("count")), "language-counts")
    spoken = per_lang.count()
    if not spoken:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                data = LOWER[block.data]
                starts, ends, owner = word_spans(Block(0, len(block), data, block.at), LETTERS)
                edges = np.searchsorted(owner, np.arange(len(block) + 1))
                out = []
                for a, b in zip(edges, edges[1:]):
                    chains = -(-(b - a) // CHAIN)
                    chosen = range(chains) if chains <= CHAINS_PER_ROW else np.linspace(0, chains - 1, CHAINS_PER_ROW).astype(int)
                    out.append([[data[s:e].tobytes() for s, e in zip(starts[a + c * CHAIN : min(b, a + (c + 1) * CHAIN)], ends[a + c * CHAIN : b])] for c in chosen])
                own = slice(block.first, block.last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[own], batch.column("lang")[own], pa.array(out, pa.list_(pa.list_(pa.binary())))], ["doc_id", "lang", "chains"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Each language gives the same number of rows, so that a rare one is learned as well.
    size = max(1, training_rows // spoken)
    # A share leaves a language out by chance if few rows are wanted; then more pass and the first by their hash are taken.
    wanted = size if size >= SPARE_ROWS else size + SPARE_ROWS
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30))
    share = F.when(F.col("count") <= wanted, F.lit(1 << 30)).otherwise(F.floor(F.lit(float(wanted << 30)) / F.col("count")))
    sample = named.join(per_lang, "lang").where(draw < share).select("doc_id", "lang", "text")
    if size < SPARE_ROWS:
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text")))
        sample = sample.withColumn("nth", nth).where(F.col("nth") <= size).drop("nth")
    rows = sorted(((r.doc_id, r.lang, r.chains) for r in sample.mapInArrow(cut, f"doc_id {kind}, lang string, chains array<array<binary>>").collect()))
    chains = [([bytes(w) for w in c], lang) for _, lang, cs in rows for c in cs if c]
    return fit(chains) if chains else None


def languages(docs: DataFrame, model: Chain | None) -> DataFrame:
    """``doc_id, lang_pred, score`` per row: the language with the largest mean posterior over all words, and that mean.

    ``und`` with score 0 stands for null and empty texts, texts without a letter, and all texts if there is no model. Ties
    go to the language that sorts first. Repeated rows get equal results. Every word of a text of any length is
    labelled, in chains of ``CHAIN`` words. An empty table gives no row. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                rows = len(block)
                if model is None:
                    pred, score = ["und"] * rows, np.zeros(rows)
                else:
                    mean, many = model.label(block)
                    ascii_letters = np.concatenate([[0], np.cumsum((LOWER[block.data] >= 97) & (LOWER[block.data] <= 122))])
                    sure = ascii_letters[block.at[1:]] > ascii_letters[block.at[:-1]]
                    spoken = [bool(many[i]) and (bool(sure[i]) or any(c.isalpha() for c in block.text(i).decode("utf-8", "replace"))) for i in range(rows)]
                    best = mean.argmax(axis=1)
                    pred = [model.languages[k] if s else "und" for k, s in zip(best, spoken)]
                    score = np.where(spoken, mean[np.arange(rows), best], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, rows), pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
