"""Packing by a mixture: deficit round-robin over source queues fills each window to target token shares."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import written

#: Fixed value: the pre-splitting rule of the byte-level vocabulary.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of white space on which the faster library's pattern would recurse too deep; a text that has one takes the other way.
LONG_BLANKS = re.compile(r"\s{10000}")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of whole texts, equal to those of a byte-level tokenizer file.

    The file's vocabulary is handed as ranks, with the same pre-splitting rule, to the faster of the two installed
    libraries (an id is a merge's place in such a file, so both give the same ids; the tests compare them). A text that
    holds a special token's string, or a very long run of white space, goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        byte_of = byte_alphabet()
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in self.special
        }
        self.ordinary = tiktoken.Encoding("ranks", pat_str=PRE_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special) or LONG_BLANKS.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ordinary(text)
        return np.array(ids, self.kind).tobytes()


class Schedule:
    """How many tokens each queue has given after any number of tokens, without a walk over the windows before.

    Each queue is entitled to its target share of every token served. Token j of a queue with T tokens falls due at
    (j + 1/2) / T, and tokens are served in the order in which they fall due (ties: lower queue first). So a
    queue's deficit, entitlement less tokens given, stays within half a token per queue, and what it is at
    the start of a window follows from the totals alone: a task can carry on any deficit without its predecessor.
    Without ``rates``, targets are the shares of the whole corpus, the only ones that let all queues run dry in the last
    window. With them, token j falls due at (j + 1/2) / rate, and what a dry queue leaves goes to the others by their rates.
    """

    def __init__(self, totals: list[int], rates: list[float] | None = None):
        self.totals = np.array(totals, np.float64)
        self.n = int(sum(totals))
        self.rates = self.totals if rates is None else np.array(rates, np.float64)
        self.even = rates is None

    def _due_before(self, t: np.ndarray, also_equal: bool) -> np.ndarray:
        """Tokens of each queue that fall due before ``t`` (or at ``t``); exact for the rounded due times."""
        t = t[:, None]
        count = np.clip(np.floor(t * self.rates + 0.5) - 1, 0, self.totals)
        for _ in range(3):
            due = (count + 0.5) / self.rates
            count = np.where((count < self.totals) & ((due <= t) if also_equal else (due < t)), count + 1, count)
        return count

    def served(self, house: np.ndarray) -> np.ndarray:
        """Tokens of each queue (columns) among the first ``house`` tokens (rows)."""
        house = np.minimum(house.astype(np.float64), self.n)
        slack = len(self.totals) + 1
        low = np.maximum(0.0, (house - slack) / self.n) if self.even else np.zeros(len(house))
        high = (house + slack) / self.n if self.even else np.full(len(house), 1.0 + (self.totals / self.rates).max())
        while True:
            middle = (low + high) / 2
            if not ((middle > low) & (middle < high)).any():
                break
            enough = self._due_before(middle, True).sum(axis=1) >= house
            high = np.where(enough, middle, high)
            low = np.where(enough, low, middle)
        count = self._due_before(high, False)
        due_now = self._due_before(high, True) - count
        left = (house - count.sum(axis=1))[:, None]
        turn = np.cumsum(due_now, axis=1)
        return (count + np.where(turn <= left, due_now, 0)).astype(np.int64)

    def position(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """How many tokens of all queues are served before these tokens of queues."""
        t = (token + 0.5) / self.rates[queue]
        before = self._due_before(t, False)
        level = self._due_before(t, True) - before
        return (before.sum(axis=1) + np.where(np.arange(len(self.totals)) < queue[:, None], level, 0).sum(axis=1)).astype(np.int64)


class Mixture:
    """A schedule of any number of queues: beyond ``width`` of them, the smallest share a lane that has a schedule of its own.

    A lane's schedule names the lane whose token is next, and the schedule inside the lane the queue. So each step looks at
    ``width`` totals, and the deficit of a queue follows from the totals of the groups that it belongs to. ``totals`` are
    sorted so that the first ones get lanes of their own.
    """

    def __init__(self, totals: list[int], rates: list[float] | None = None, width: int = 64, own: int = 0):
        self.n = sum(totals)
        self.schedules: list[Schedule] = []
        self.path: list[list[tuple[int, int]]] = [[] for _ in totals]
        todo = [(list(range(len(totals))), [], max(own, width - 1))]
        while todo:
            queues, above, alone = todo.pop()
            if len(queues) <= max(width, alone):
                groups = [[q] for q in queues]
            elif not above:
                groups = [[q] for q in queues[:alone]] + [queues[alone:]]
            else:
                size = -(-len(queues) // width)
                groups = [queues[at : at + size] for at in range(0, len(queues), size)]
            node = len(self.schedules)
            sums = [sum(totals[q] for q in g) for g in groups]
            self.schedules.append(Schedule(sums, None if rates is None else [sum(rates[q] for q in g) for g in groups]))
            for child, group in enumerate(groups):
                here = [*above, (node, child)]
                if len(group) == 1:
                    self.path[group[0]] = here
                else:
                    todo.append((group, here, 0))

    def _steps(self, queue: np.ndarray, depth: int) -> Iterator[tuple[Schedule, np.ndarray, np.ndarray]]:
        """Schedules of a depth with the rows whose queues they serve, and the lanes of these rows."""
        node, lane = (np.array([self.path[q][depth][i] if depth < len(self.path[q]) else -1 for q in queue.tolist()], np.int64) for i in (0, 1))
        for n in np.unique(node[node >= 0]).tolist():
            rows = np.flatnonzero(node == n)
            yield self.schedules[n], rows, lane[rows]

    def pieces(self, queue: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Cut token ranges of queues into windows: row, window, first and last token, and place in the window."""
        depths = range(max((len(self.path[q]) for q in np.unique(queue).tolist()), default=0))
        first, last = start.astype(np.int64), stop.astype(np.int64) - 1
        for depth in reversed(depths):
            for schedule, rows, lane in self._steps(queue, depth):
                first[rows], last[rows] = schedule.position(lane, first[rows]), schedule.position(lane, last[rows])
        first, last = first // window, last // window
        many = last - first + 1
        row = np.repeat(np.arange(len(queue)), many)
        at = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        # Tokens of all queues, then of the lane, and in the end of the queue, before the window and up to its end.
        begin, end, offset = at * window, np.minimum((at + 1) * window, self.n), np.zeros(len(at), np.int64)
        for depth in depths:
            for schedule, rows, lane in self._steps(queue[row], depth):
                house, place = np.unique(np.concatenate([begin[rows], end[rows]]), return_inverse=True)
                served, (a, b) = schedule.served(house), np.split(place, 2)
                given = served[b] - served[a]
                nth = np.arange(len(rows))
                offset[rows] += np.cumsum(given, axis=1)[nth, lane] - given[nth, lane]
                begin[rows], end[rows] = served[a, lane], served[b, lane]
        low, high = np.maximum(start[row], begin), np.minimum(stop[row], end)
        keep = low < high
        return row[keep], at[keep], low[keep], high[keep], (offset + low - begin)[keep]


def tokenized(docs: DataFrame, vocabulary: str, *, queue: str, closing_id: int) -> DataFrame:
    """Ids of every whole text plus ``closing_id``, with the tokens that its queue holds before it in the same task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        closing = np.array([closing_id], encoder.kind).tobytes()
        task, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                queues = part.column("queue").to_pylist()
                ids = [encoder.encode(t or "") + closing for t in part.column("text").to_pylist()]
                before = []
                for q, x in zip(queues, ids):
                    before.append(held.get(q, 0))
                    held[q] = before[-1] + len(x) // encoder.kind.itemsize
                lengths = pa.array([len(x) // encoder.kind.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(queues, pa.string()), pa.array([task] * len(ids), pa.int32()), pa.array(before, pa.int64()), lengths, pa.array(ids, pa.binary())],
                    ["doc_id", "queue", "task", "before", "tokens", "ids"],
                )

    named = docs.select("doc_id", "text", F.coalesce(F.col(queue).cast("string"), F.lit("")).alias("queue"))
    return named.mapInArrow(encode, "doc_id long, queue string, task int, before long, tokens long, ids binary")


def pack(docs: DataFrame, vocabulary: str, *, queue: str = "source", window: int = 1024, closing_id: int = 0, queues: int = 64, shares: dict[str, float] | None = None) -> DataFrame:
    """Pack all documents into windows of ``window`` tokens that hold each source at its share of the corpus.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue``. Every window is
    full but the last of all, so there is no other padding. Inside a window, queues stand in a fixed order.

    A queue is a value of ``queue``; null is the queue "". Of more than ``queues`` values, the smallest share a lane, in
    which they are scheduled by their own shares. ``shares`` gives sources other target shares than those of the corpus;
    sources that it does not name fill the rest at their shares, and what a dry source leaves goes to the others. Null and empty texts give one piece with the closing id alone. A repeated row (or doc_id) is
    packed once per row. A text of any length is cut over as many windows as it needs. An empty table gives
    no piece. Other columns are ignored, whatever their names.

    Texts are encoded once and written to the shared folder as ids; only token counts per task and queue
    are shuffled, so a hot source moves no more than others do.
    """
    ids = written(tokenized(docs, vocabulary, queue=queue, closing_id=closing_id), "packing-ids")
    per_task = ids.groupBy("queue", "task").agg(F.sum("tokens").alias("tokens"))
    named = shares or {}
    if any(not 0 < x <= 1 for x in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError("target shares must be above 0 and sum up to 1 at most")
    # One number per source; everything else stays in tables.
    totals = [(r.queue, r.tokens) for r in per_task.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()]
    totals.sort(key=lambda x: (x[0] not in named, -x[1], x[0]))
    others = sum(n for q, n in totals if q not in named)
    rest = 1 - sum(named.values())
    if named and others and rest <= 1e-9:
        raise ValueError("the target shares leave nothing for the sources that they do not name")
    rates = [named[q] if q in named else rest * n / others for q, n in totals] if named else None
    mixture = Mixture([n for _, n in totals], rates, queues, own=sum(q in named for q, _ in totals))
    lanes = docs.sparkSession.createDataFrame([(q, i) for i, (q, _) in enumerate(totals)], "queue string, lane int")
    order = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.join(lanes, "queue").select("queue", "task", "lane", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("ahead"))
    # Written, so that its size is known when the join is planned: a small one is broadcast, and no ids are shuffled.
    ahead = written(ahead, "packing-ahead")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                begin = part.column("begin").to_numpy()
                doc, tokens, raw = part.column("doc_id"), part.column("tokens").to_numpy(), part.column("ids").to_pylist()
                row, sequence, low, high, offset = mixture.pieces(part.column("lane").to_numpy().astype(np.int64), begin, begin + tokens, window)
                wide = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(raw, tokens.tolist())]
                low, high = low - begin[row], high - begin[row]
                crc = [zlib.crc32(wide[r][a:b]) for r, a, b in zip(row.tolist(), low.tolist(), high.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row)), pa.array(low), pa.array(high - low), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(sequence), pa.array(offset), part.column("queue").take(pa.array(row))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )

    placed = ids.join(ahead, ["queue", "task"]).select("doc_id", "queue", "lane", (F.col("ahead") + F.col("before")).alias("begin"), "tokens", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
