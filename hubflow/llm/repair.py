"""Conversation repair: the cheapest edits that give a valid sequence of roles, by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns that one search spans. A longer conversation is searched part by part, each from the end states of the part before.
PART = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: No end state of a part that costs more than this above the cheapest can lie on a best repair: two insertions lead from any state
#: to the role that a kept turn needs, and deleting a system turn that only a start admits costs 2.
SPREAD = 2 * INSERT + DELETE
#: Where a repaired conversation stands: nothing yet, or its last role. Each state admits one role to be written.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
WRITES = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
VALID_ENDS = (START, ASSISTANT)
BLANKS = " \t\n\x0b\x0c\r"


def code_of(role: str, fault: str) -> str:
    """One letter that holds what matters for the search: ``x`` must go; otherwise the role's initial (``o``: none of s, u, a), upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if fault == "truncated" else letter


def suffix_bounds(codes: str) -> list[int]:
    """What the turns from each place on cost at least, whatever the roles around them."""
    least = [0]
    for code in reversed(codes):
        own = DELETE if code == "x" or code.isupper() else REROLE if code == "o" else KEEP
        least.append(least[-1] + own)
    return least[::-1]


@lru_cache(1 << 16)
def search(codes: str, roots: tuple[tuple[int, int], ...], last: bool) -> tuple[tuple[int, int, str], ...]:
    """Best ``(state, cost, audit)`` for each end state of a part; of the last part only the best valid one.

    ``roots`` are the (cost, state) to start from, in the order of their audits so far; an audit begins with its root's
    number there. The stack holds open prefixes, cheapest edit on top. A prefix is dropped if its cost plus the
    suffix's lower bound is beyond the incumbent, or equal and already later in order, or if another prefix came to the same node, so many turns
    done and the same state, for less or equally and earlier in order. What is left when the stack is empty is proved best.
    """
    n, least = len(codes), suffix_bounds(codes)
    table: dict[tuple[int, int], tuple[int, str]] = {}
    found: dict[int, tuple[int, str]] = {}
    cheapest = None
    stack = []

    def push(i: int, state: int, cost: int, audit: str) -> None:
        bound = cost + least[i]
        if cheapest is not None:
            limit = cheapest[0] if last else cheapest[0] + SPREAD
            if bound > limit or (last and bound == limit and audit > cheapest[1][: len(audit)]):
                return
        before = table.get((i, state))
        if before is None or (cost, audit) < before:
            table[i, state] = (cost, audit)
            stack.append((i, state, cost, audit))

    for number in range(len(roots) - 1, -1, -1):
        push(0, roots[number][1], roots[number][0], str(number))
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit):
            continue
        writes = WRITES[state]
        if i == n and not last:
            if state not in found or (cost, audit) < found[state]:
                found[state] = (cost, audit)
                cheapest = min(found.values())
            continue
        if i == n and state in VALID_ENDS and (cheapest is None or (cost, audit) < cheapest):
            cheapest = (cost, audit)
            found = {state: cheapest}
        push(i, writes, cost + INSERT, audit + "I")
        if i == n:
            continue
        push(i + 1, state, cost + DELETE, audit + "D")
        code = codes[i]
        if code != "x":
            extra = TRUNCATED if code.isupper() else 0
            push(i + 1, writes, cost + REROLE + extra, audit + "R")
            kept = NEXT[state].get(code.lower())
            if kept is not None:
                push(i + 1, kept, cost + KEEP + extra, audit + "K")
    return tuple((state, *found[state]) for state in sorted(found))


class Repair:
    """One conversation, turn by turn. Held are at most ``PART`` turns, and four candidates of cost, audit and hash state."""

    def __init__(self, conv: str):
        self.conv = conv
        self.turns: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = self.initial = None
        #: Candidates in order of their audits: cost, state, hash of what is repaired, audit as (earlier parts, this part).
        self.ends = [(0, START, hashlib.sha256(), None)]

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.distinct += turn != self.last_turn
            self.last_turn = turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if seen else "truncated" if body[-1] not in ".!?" else ""
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if len(self.turns) == PART:
            self._close(False)
        self.turns.append((role, text))
        self.codes.append(code_of(role, fault))

    def _close(self, last: bool) -> None:
        low = min(cost for cost, *_ in self.ends)
        roots = tuple((cost - low, state) for cost, state, *_ in self.ends)
        ends = []
        for state, cost, audit in sorted(search("".join(self.codes), roots, last), key=lambda x: x[2]):
            _, at, repaired, earlier = self.ends[int(audit[0])]
            repaired, turns = repaired.copy(), iter(self.turns)
            for edit in audit[1:]:
                role, text = ("", "") if edit == "I" else next(turns)
                if edit == "D":
                    continue
                to = NEXT[at][role[:1]] if edit == "K" else WRITES[at]
                line = f"{role if edit == 'K' else ROLE[to]}:{text}"
                repaired.update((line if at == START else "\n" + line).encode())
                at = to
            ends.append((cost + low, state, repaired, (earlier, audit[1:])))
        self.ends, self.turns, self.codes = ends, [], []

    def result(self) -> tuple:
        self._close(True)
        ((cost, _, repaired, audit),) = self.ends
        parts = []
        while audit is not None:
            audit, part = audit
            parts.append(part)
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(parts)), repaired.hexdigest())


SCHEMA = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
_KINDS = [pa.string() if part.endswith("string") else pa.int64() for part in SCHEMA.split(", ")]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations from turns that are sorted by conversation and place."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    at = None
    for batch in batches:
        done = []
        for conv, turn, role, text, seen, gone in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "seen", "gone"))):
            if at is None or conv != at.conv:
                if at is not None:
                    done.append(at.result())
                at = Repair(conv)
            if not gone:
                at.add(turn, role, text, seen)
        if done:
            yield batch_of(done)
    if at is not None:
        yield batch_of([at.result()])


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after a fixed damage by a hash of conversation and turn: about one turn in four changes.

    Of 20 classes, 0 drops the turn (``gone``), 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's.
    Null roles and texts are one blank; a null conversation or turn is one blank in the hash, too.
    """
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).withColumn("gone", F.col("kind") == 0)
    return rows.withColumn("copy", F.explode(F.expr("IF(kind = 3, array(0, 1), array(0))"))).select("conv_id", "turn", "role", "text", "gone")


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``turns`` has ``conv_id, turn, role, text``, and optionally ``gone``, which keeps a conversation in the result without the turn.
    Turns are taken in order of ``turn``, null first; those of one number by role and a hash of the text, so equal
    rows are neighbours. The first fault of a turn counts: no visible character, role and text of an earlier turn, no sentence end.
    The repair has roles ``(s?(ua)+)?`` by initials at the least cost; of equal costs the audit (K, R, D, I in order) that is least in ASCII.
    Null roles and texts count as empty; rows with a null conv_id form one conversation. Other columns are ignored. An
    empty table gives no row. A conversation whose turns are all gone has zeros, an empty audit and the hash of nothing.

    Texts are shuffled once, by conversation, and read in order: the hash of a repaired conversation needs that. A
    task holds few turns at a time, so a conversation of any length takes bounded memory besides its audit.
    """
    none = F.lit("")
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), none).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"), gone.alias("gone")
    )
    # What is gone is no earlier turn for others.
    same = ["conv", "gone", "role", *[F.xxhash64(F.lit(lane), "text") for lane in (1, 2)]]
    place = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64(F.lit(1), F.col("text")), F.xxhash64(F.lit(2), F.col("text"))]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.repartition("conv").withColumn("nth", nth).sortWithinPartitions("conv", *place, "nth")
    found = rows.select("conv", "turn", "role", "text", (F.col("nth") > 1).alias("seen"), "gone").mapInArrow(_repaired, SCHEMA)
    kind = turns.schema["conv_id"].dataType
    return found.select(F.when(F.col("conv") != "", F.col("conv")).cast(kind).alias("conv_id"), *_NAMES[1:])
