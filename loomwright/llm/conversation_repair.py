"""Cheapest repair of the role order of conversations: a dynamic program over shared edit prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import give_back, small_batches

SPACES = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
UNTRIMMED = 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired roles end with
#: (state before, initial of the role put out): state after
STEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the role that a state lets be written next, when it is chosen freely
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEGAL = {"su", "ua", "au"}
COMPACT = 4096
MODULUS, FACTOR = (1 << 61) - 1, 0x1B873593_7F4A7C15 % ((1 << 61) - 1)


class Prefixes:
    """Texts that grow at their end and share their beginnings, as linked nodes.

    A node is a text: the text of its parent and one more letter. It knows its length, a rolling hash of the whole text
    and its ancestors 1, 2, 4, ... letters up. Two texts are compared by the longest beginning that they share, found by
    those ancestors and hashes; that the hashes did not collide is verified letter by letter down to the node where
    both meet.
    """

    def __init__(self):
        self.letter, self.length, self.hash, self.up = [""], [0], [0], [()]
        self.known: dict[tuple[int, str], int] = {}

    def grown(self, node: int, letter: str) -> int:
        made = self.known.get((node, letter))
        if made is not None:
            return made
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        made = len(self.letter)
        self.letter.append(letter)
        self.length.append(self.length[node] + 1)
        self.hash.append((self.hash[node] * FACTOR + ord(letter)) % MODULUS)
        self.up.append(tuple(ups))
        self.known[node, letter] = made
        return made

    def ancestor(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def text(self, node: int, below: int = 0) -> str:
        """The letters from node ``below`` (an ancestor) to this node."""
        out = []
        while node != below:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def same(self, one: int, other: int) -> bool:
        """Equal texts of the same length, verified."""
        while one != other:
            if self.letter[one] != self.letter[other]:
                return False
            one, other = self.up[one][0], self.up[other][0]
        return True

    def less(self, one: int, other: int) -> bool:
        """Whether the text of ``one`` comes before that of ``other``."""
        if one == other:
            return False
        short = min(self.length[one], self.length[other])
        a, b = self.ancestor(one, self.length[one] - short), self.ancestor(other, self.length[other] - short)
        if a == b or (self.hash[a] == self.hash[b] and self.same(a, b)):
            return self.length[one] < self.length[other]
        if self.hash[a] == self.hash[b]:
            return self.text(one) < self.text(other)
        k = len(self.up[a]) - 1
        while k >= 0:  # the highest pair of ancestors that still differs
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
            k -= 1
        above = self.up[a][0], self.up[b][0]
        if not self.same(*above):  # a collision: spelled out
            return self.text(one) < self.text(other)
        return self.letter[a] < self.letter[b]


class Audit:
    """The cheapest edits of the rows so far, for each state that the repaired roles can end in.

    Costs decide first, then the edits' letters. Two texts of equal cost for the same rows and state are never each
    other's beginning (the longer one would hold more inserts and cost more), so the lesser stays the lesser whatever
    follows. States that can't win any more are dropped: what follows a state without rows costs at most ``DELETE`` more
    after a whole pair, and what follows a lone system turn costs no more after a whole pair.
    """

    def __init__(self):
        self.texts = Prefixes()
        self.base = 0  # letters up to this node are settled
        self.best: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}
        self._insert()

    def _offer(self, states: dict, state: int, cost: int, node: int, letter: str) -> None:
        held = states.get(state)
        if held is None or cost < held[0]:
            states[state] = (cost, self.texts.grown(node, letter))
        elif cost == held[0]:
            made = self.texts.grown(node, letter)
            if self.texts.less(made, held[1]):
                states[state] = (cost, made)

    def _insert(self) -> None:
        best = self.best
        for _ in range(2):  # after two inserts a state is met again at a higher cost
            for state in sorted(best, key=lambda s: best[s][0]):
                cost, node = best[state]
                self._offer(best, STEPS[state, NEXT[state]], cost + INSERT, node, "I")

    def row(self, initial: str, must_go: bool, cut_off: bool) -> None:
        """One more row: its role's initial, whether it has to be deleted, whether keeping it costs more."""
        found: dict[int, tuple[int, int]] = {}
        extra = UNTRIMMED if cut_off else 0
        for state, (cost, node) in self.best.items():
            self._offer(found, state, cost + DELETE, node, "D")
            if must_go:
                continue
            after = STEPS.get((state, initial))
            if after is not None:
                self._offer(found, after, cost + KEEP + extra, node, "K")
            self._offer(found, STEPS[state, NEXT[state]], cost + REROLE + extra, node, "R")
        self.best = found
        self._insert()
        pair = found[ASSISTANT][0]
        if EMPTY in found and found[EMPTY][0] > pair + DELETE:
            del found[EMPTY]
        if SYSTEM in found and found[SYSTEM][0] > pair:
            del found[SYSTEM]

    def settled(self) -> str:
        """The letters that all states agree on beyond those returned before; forgets what is no longer needed."""
        texts = self.texts
        heads = [node for _, node in self.best.values()]
        meet = heads[0]
        for node in heads[1:]:
            short = min(texts.length[meet], texts.length[node])
            meet, node = texts.ancestor(meet, texts.length[meet] - short), texts.ancestor(node, texts.length[node] - short)
            k = len(texts.up[meet]) - 1
            while k >= 0:  # nodes are made once per text, so equal texts are one node
                if k < len(texts.up[meet]) and texts.up[meet][k] != texts.up[node][k]:
                    meet, node = texts.up[meet][k], texts.up[node][k]
                k -= 1
            if meet != node:
                meet = texts.up[meet][0]
        out = texts.text(meet, self.base)
        if len(texts.letter) > COMPACT:
            tails = {state: (cost, texts.text(node, meet)) for state, (cost, node) in self.best.items()}
            self.texts, self.base, self.best = Prefixes(), 0, {}
            for state, (cost, tail) in tails.items():
                node = 0
                for letter in tail:
                    node = self.texts.grown(node, letter)
                self.best[state] = (cost, node)
        else:
            self.base = meet
        return out

    def finished(self) -> tuple[int, str]:
        """The cost of the whole repair, and the letters beyond those settled."""
        ends = [self.best[s] for s in (EMPTY, ASSISTANT) if s in self.best]
        won = ends[0]
        for cost, node in ends[1:]:
            if (cost == won[0] and self.texts.less(node, won[1])) or cost < won[0]:
                won = (cost, node)
        return won[0], self.texts.text(won[1], self.base)


class Repair:
    """One conversation, row by row: counts, audit, and the hash of what is left."""

    def __init__(self):
        self.audit, self.letters = Audit(), []
        self.waiting: list[tuple[str, str]] = []  # rows whose letter is not settled
        self.sent = 0  # rows before them
        self.state, self.hash, self.empty = EMPTY, hashlib.sha256(), True
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.turn = None
        self.turns = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            if self.turn != turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        must_go = fault in ("blank", "duplicate")
        self.audit.row(initial, must_go, fault == "truncated")
        self.waiting.append((role, "" if must_go else text))
        if len(self.waiting) >= 64:
            self._write(self.audit.settled())

    def _write(self, letters: str) -> None:
        self.letters.append(letters)
        at = 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.waiting[at]
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "user" if NEXT[self.state] == "u" else "assistant"
            self.state = STEPS[self.state, role[0]]
            if not self.empty:
                self.hash.update(b"\n")
            self.empty = False
            self.hash.update(f"{role}:{text}".encode())
        del self.waiting[:at]

    def done(self) -> dict:
        cost, letters = self.audit.finished()
        self._write(letters)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.letters), "repaired_sha256": self.hash.hexdigest()}


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass(frozen=True)
class ConversationRepair:
    """Faults of conversations and the cheapest edits that give them the roles ``(system? (user assistant)+)?``.

    Rows of a conversation stand by turn (NULL first), equal turn numbers by the SHA-256 of role and text. A row is blank
    if its text has nothing but ASCII white space, a duplicate if an earlier row has the same role and text, truncated if
    the last character that is no white space is none of ``.!?``; the first of these counts. Keeping a row is free, giving
    it another role costs 3, deleting it 4 (blank and duplicate rows have to go), putting an empty row anywhere 3; a
    truncated row that stays costs 3 more. A role is told by its first letter. NULL role or text is one space.

    The rows come from ``damaged`` or any table with the columns conv, turn, role, text and copies (rows that stand for
    several equal ones in a row). Rows without id are one conversation, without id. Conversations of ``ids`` that have
    no rows left get zeros, an empty audit and the hash of nothing. Other columns play no part.

    First places of (conversation, role, text) are aggregated before they are shuffled; texts are shuffled once and stream
    through ``Repair`` in order, so a conversation of any length is never gathered: what is held are the rows whose edit
    is open. The hash of the whole repaired text has to be made in order, by one task per conversation.
    """

    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"

    def __call__(self, rows: DataFrame, damage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """One row per conversation of ``rows``: counts, cost, audit and repaired_sha256."""
        space = F.lit(" ")
        named = rows.select(F.col(self.conv).alias("conv"), F.col(self.turn).alias("turn"), F.coalesce(self.role, space).alias("role"),
                            F.coalesce(self.text, space).alias("text"), F.lit(1).alias("copies"))
        ids = rows.select(F.col(self.conv).alias("conv")).distinct()
        repaired = self.repaired(damage(named) if damage is not None else named)
        zero, nothing = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
        # NULL ids are equal here; an id has one row on either side
        out = ids.alias("i").join(repaired.alias("r"), F.col("i.conv").eqNullSafe(F.col("r.conv")), "left")
        return out.select(F.col("i.conv").alias(self.conv), *[F.coalesce(n, zero).alias(n) for n in NUMBERS],
                          F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))

    @staticmethod
    def told(rows: DataFrame) -> DataFrame:
        """Rows with their digest, and whether they are blank or truncated."""
        trimmed = F.rtrim("text", F.lit(SPACES))
        digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256))
        return rows.select("conv", "turn", "role", "text", "copies", digest.alias("digest"), (trimmed == "").alias("blank"),
                           (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))

    def repaired(self, rows: DataFrame) -> DataFrame:
        told = self.told(rows)
        kind = rows.schema["conv"].dataType.simpleString()
        first = told.where(~F.col("blank")).groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("at")).select(
            "conv", F.col("at.turn").alias("turn"), "digest", F.lit(0).alias("copies"))
        marked = first.unionByName(told, allowMissingColumns=True)
        streamed = small_batches(marked.repartition("conv").sortWithinPartitions(
            F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest", "copies"))

        def emitted(out: list[tuple]) -> pa.RecordBatch:
            convs, made = [c for c, _ in out], [m for _, m in out]
            return pa.RecordBatch.from_pydict({
                "conv": pa.array(convs, pa.int64() if kind == "bigint" else None), **{n: pa.array([m[n] for m in made], pa.int64()) for n in NUMBERS},
                "audit": pa.array([m["audit"] for m in made], pa.string()), "repaired_sha256": pa.array([m["repaired_sha256"] for m in made], pa.string())})

        def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, repair, mark = None, None, None
            for batch in batches:
                out = []
                for conv, turn, digest, copies, role, text, blank, cut in zip(
                        *(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                    if repair is None or conv != now:
                        if repair is not None:
                            out.append((now, repair.done()))
                        now, repair, mark = conv, Repair(), None
                    if copies == 0:  # the next row is the first with this role and text
                        mark = digest
                        continue
                    for _ in range(copies):
                        fault = "blank" if blank else "duplicate" if digest != mark else "truncated" if cut else ""
                        mark = None
                        repair.add(turn, role, text, fault)
                if out:
                    yield emitted(out)
            if repair is not None:
                yield emitted([(now, repair.done())])
            give_back()

        columns = ("conv", "turn", "digest", "copies", "role", "text", "blank", "cut")
        schema = ", ".join([f"conv {kind}", *[f"{n} long" for n in NUMBERS], "audit string", "repaired_sha256 string"])
        return streamed.select(*columns).mapInArrow(walked, schema)


def dealt_damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv:turn`` modulo 20: 0 goes, 1 loses its text, 2 its ``.!?``, 3 stands twice, 4 is the user's."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.pmod(F.crc32(F.concat_ws(":", shown("conv"), shown("turn")).cast("binary")), F.lit(20))
    return rows.withColumn("lot", lot).where("lot != 0").select(
        "conv", "turn", F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("lot") == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))
