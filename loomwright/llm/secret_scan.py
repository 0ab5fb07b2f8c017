"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that tags more of them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import batch_map, give_back, kept, text_slices
from loomwright.llm.learning import Adam
from loomwright.session import stored

#: fixed values: kinds in their order, with pattern and group whose length counts, and the least length
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
TRIGGERS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NAME_WORDS = (*TRIGGERS, "api-key", "credential", "private", "access", "bearer", "auth")
NAMES = re.compile(r"(?i)passw(?:or)?d|secret|token|api[_-]?key|credential|private|access|bearer|auth")
TAGGED = "crf"
#: characters of which keys are made, and marks that join the parts of paths, names, dates and numbers
VALUE_SETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
HARMLESS_MARKS = ("/", ".", "-", "_")

DIGITS = re.compile("[0-9]")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
OUT, BEGIN, INSIDE = 0, 1, 2
BEFORE, AFTER = 96, 48  # characters around a candidate that its window holds
SHORT_RUN, LONG_RUN = 8, 16
HASHED = 1 << 14
STEPS = (-2, -1, 1)  # neighbours whose features a token has
KEPT_TOKENS, KEPT_CHARACTERS = 1 << 17, 1 << 21  # scores of tokens that a worker keeps

HEX = np.zeros(256, bool)
HEX[[*range(48, 58), *range(97, 103)]] = True
RUN = np.zeros(256, bool)
RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
VALUE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORT_RUN},}}")
KEY_LIKE = re.compile(rf".{{{LONG_RUN}}}|[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z][A-Z]", re.S)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of every pattern, leftmost and without overlap in a kind."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), rank, (kind, m.start(), m.end(), m.start(group))) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [span for _, _, span in sorted(out)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def key_like(run: str) -> bool:
    """Whether a run of value characters, none shorter than ``SHORT_RUN``, is long, mixes digits and letters, or goes
    from a small letter to a capital."""
    return KEY_LIKE.search(run) is not None


def _holders(data: np.ndarray, bounds: np.ndarray, parts: tuple[bytes, ...]) -> list[int]:
    """Texts with one of the parts, in small letters or capitals."""
    found, low = [], data.tobytes().lower()
    for part in parts:
        at = low.find(part)
        while at >= 0:
            text = int(np.searchsorted(bounds, at, "right")) - 1
            found.append(text)
            at = low.find(part, int(bounds[text + 1]))
    return found


def patterned(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts that can hold a base span: each has a trigger word, an access key's first letters or 32 hexadecimal characters
    in a row."""
    first, end = _runs(HEX[data])
    long_ = end - first >= 32
    ends = (np.searchsorted(bounds, at[long_], "right") - 1 for at in (first, end - 1))
    # a run over the border of two texts is taken as one here; the patterns decide
    found = [text for a, b in zip(*(e.tolist() for e in ends), strict=True) for text in range(a, b + 1)]
    return np.unique(np.array(found + _holders(data, bounds, (*(t.encode() for t in TRIGGERS), b"akia")), np.int64))


def suspects(data: np.ndarray, bounds: np.ndarray, likely: bool = False) -> np.ndarray:
    """Texts with a window to learn from. That is a run of value characters that is long, mixes
    digits and letters or goes from a small letter to a capital, a long run of hexadecimal ones, an access key's first
    letters, or a name of secrets. With ``likely``, only long runs that mix digits and letters and trigger words count."""
    found = []
    for table, least in ((HEX, 32), (RUN, LONG_RUN if likely else SHORT_RUN)):
        flags = np.append(table[data], False)
        first, end = _runs(flags[:-1])
        # a run over the border of two texts is taken as one here; the scan of either text decides
        long_ = end - first >= least
        first, end = first[long_], end[long_]
        if table is RUN and len(first):
            digits, letters = (np.concatenate([[0], np.cumsum(t[data])]) for t in (DIGIT, LETTER))
            kept = (digits[end] > digits[first]) & (letters[end] > letters[first])
            if not likely:
                rises = np.flatnonzero((data[:-1] >= 97) & (data[:-1] <= 122) & (data[1:] >= 65) & (data[1:] <= 90))
                kept |= (end - first >= LONG_RUN) | (np.searchsorted(rises, end - 1) > np.searchsorted(rises, first))
            first, end = first[kept], end[kept]
        lasts = np.searchsorted(bounds, end - 1, "right") - 1
        for a, b in zip((np.searchsorted(bounds, first, "right") - 1).tolist(), lasts.tolist(), strict=True):
            found.extend(range(a, b + 1))
    found += _holders(data, bounds, (*(t.encode() for t in (TRIGGERS if likely else NAME_WORDS)), b"akia"))
    return np.unique(np.array(found, np.int64))


def windows(text: str, spans: list[tuple[str, int, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Token runs around what looks like a secret, and around names of secrets; (token, start, end) each. Windows that
    touch are one."""
    places = [(a, b) for _, a, b, _ in spans]
    places += [(m.start(), m.end()) for m in VALUE.finditer(text) if key_like(m.group())]
    places += [(m.start(), m.end()) for m in NAMES.finditer(text)]
    joined: list[list[int]] = []
    for a, b in sorted((max(0, a - BEFORE), min(len(text), b + AFTER)) for a, b in places):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out = []
    for a, b in joined:
        while a and not text[a - 1].isspace() and a > 0 and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        out.append([(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, a, b)])
    return out


def shapes(token: str) -> tuple[str, ...]:
    """Features of a token alone: short ones by characters and length, long ones also by each measure for itself."""
    if token.isascii():
        held = (token != token.upper(), token != token.lower(), not token.isalpha() and DIGITS.search(token) is not None)
    else:
        held = (any(map(str.islower, token)), any(map(str.isupper, token)), any(map(str.isdigit, token)))
    classes = "".join(c for c, some in zip("aA0-", (*held, not token.isalnum()), strict=True) if some)
    size = len(token)
    if size < LONG_RUN // 2:
        return (f"{classes}{size}",)
    counts = Counter(token)
    entropy = -sum([n / size * math.log2(n / size) for n in counts.values()])
    turns = 8 * sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False)) // size if held[2] else 0
    marks = 8 * sum(not c.isalnum() for c in token) // size if "-" in classes else 0
    return (f"long{classes}", f"size{min(6, size.bit_length())}", f"even{int(2 * entropy)}", f"turns{min(4, turns)}", f"marks{marks}",
            f"mix{'0' in classes}{'a' in classes or 'A' in classes}{turns > 0}{marks > 0}{entropy > 3}")


def features(tokens: list[tuple[str, int, int]], secrets: int) -> list[list[int]]:
    """Hashed features of each token: its own shape, its neighbours, names in front of it, and how much the file holds."""
    own = [shapes(t) for t, _, _ in tokens]
    words = [t.lower() if len(t) <= 12 else "" for t, _, _ in tokens]
    names = [bool(NAMES.search(t)) and len(t) <= 24 for t, _, _ in tokens]
    out = []
    for k in range(len(tokens)):
        mine = [*(f"s={s}" for s in own[k]), f"n={min(secrets, 3)}/{own[k][-1]}", "1", f"name={names[k]}"]
        for step in STEPS:
            if 0 <= k + step < len(tokens):
                mine += [f"s{step}={own[k + step][0]}", f"w{step}={words[k + step]}"]
            else:
                mine.append(f"edge{step}")
        near = [j for j in range(1, 6) if k >= j and names[k - j]]
        mine.append(f"named={near[0] if near else 0}/{len(own[k]) > 1}")
        out.append([zlib.crc32(f.encode()) % HASHED for f in mine])
    return out


def varied(tokens: list[tuple[str, int, int]], own: list[int], random: np.random.Generator) -> list[tuple[str, int, int]]:
    """The sequence with other secrets in the same places, half of them without a name in front, and with harmless
    long tokens made from its words."""
    letters = VALUE_SETS[int(random.integers(len(VALUE_SETS)))]
    plain, out = bool(random.integers(2)), []
    for (token, a, b), tag in zip(tokens, own, strict=True):
        if tag != OUT:
            token = "".join(letters[i] for i in random.integers(0, len(letters), int(random.integers(SHORT_RUN, 49))))
            if not key_like(token):  # short ones in one kind of letters are words
                token += "".join(letters[i] for i in random.integers(0, len(letters), LONG_RUN - len(token)))
        elif plain and NAMES.search(token) and len(token) <= 24:
            token = "word"
        elif token.isalpha() and random.random() < 0.15:
            mark = HARMLESS_MARKS[int(random.integers(len(HARMLESS_MARKS)))]
            parts = [tokens[i][0] for i in random.integers(0, len(tokens), 4)]
            parts = [p if len(p) < LONG_RUN else str(i) for i, p in enumerate(parts)]
            token = mark.join([token, *parts, str(int(random.integers(3000)))]) if random.integers(2) else mark.join(
                f"{n:02d}" for n in random.integers(0, 60, 6))
        out.append((token, a, b))
    return out


def tags(tokens: list[tuple[str, int, int]], spans: list[tuple[str, int, int, int]]) -> list[int]:
    """Begin and inside where the pattern's secrets are."""
    out = []
    for _, start, end in tokens:
        held = next((s for s in spans if start < s[2] and end > s[3]), None)
        out.append(OUT if held is None else BEGIN if start <= held[3] else INSIDE)
    return out


class Crf:
    """Linear chain over three tags: token weights per tag, and weights of tag pairs; inside never follows outside."""

    def __init__(self):
        self.emit, self.move = np.zeros((HASHED, 3)), np.zeros((3, 3))
        self.start = np.zeros(3)

    @property
    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        move, start = self.move.copy(), self.start.copy()
        move[OUT, INSIDE] = start[INSIDE] = -1e9
        return move, start

    def fit(self, rows: list[tuple[list[list[int]], list[int]]], rounds: int, rate: float, shrink: float) -> Crf:
        """Likelihood of the tags of all sequences at once: forward and backward sums over padded tables."""
        if not rows:
            return self
        longest = max(len(t) for _, t in rows)
        count = len(rows)
        size = np.array([len(t) for _, t in rows])
        cell = np.concatenate([np.repeat(i * longest + np.arange(len(t)), [len(f) for f in fs]) for i, (fs, t) in enumerate(rows)])
        flat = np.concatenate([np.concatenate(fs) for fs, _ in rows]).astype(np.int64)
        gold = np.full((count, longest), -1)
        for i, (_, t) in enumerate(rows):
            gold[i, : len(t)] = t
        inside = gold >= 0
        adam = Adam([self.emit, self.move, self.start], rate)
        every = np.arange(count)
        for step in range(rounds):
            adam.rate = rate * (1 - step / rounds)
            move, start = self._moves
            scores = np.stack([np.bincount(cell, self.emit[flat, k], count * longest) for k in range(3)], 1).reshape(count, longest, 3)
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = start + scores[:, 0]
            for t in range(1, longest):
                grown = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + scores[:, t]
                ahead[:, t] = np.where(inside[:, t, None], grown, ahead[:, t - 1])
            total = np.logaddexp.reduce(ahead[every, size - 1], axis=1)
            for t in range(longest - 2, -1, -1):
                grown = np.logaddexp.reduce(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where(inside[:, t + 1, None], grown, 0.0)
            chance = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * inside[..., None]
            truth = (gold[..., None] == np.arange(3)) * 1.0
            pull = ((chance - truth) / count).reshape(-1, 3)
            by_emit = np.stack([np.bincount(flat, pull[cell, k], HASHED) for k in range(3)], 1)
            pairs = np.zeros((3, 3))
            for t in range(1, longest):
                both = inside[:, t]
                if both.any():
                    joint = ahead[both, t - 1, :, None] + move + (scores[both, t] + behind[both, t])[:, None, :] - total[both, None, None]
                    pairs += np.exp(np.minimum(joint, 0)).sum(0) - np.einsum("ni,nj->ij", truth[both, t - 1], truth[both, t])
            adam([by_emit + shrink * self.emit, pairs / count + shrink * self.move, (chance[:, 0] - truth[:, 0]).mean(0)])
        return self

    def decode(self, found: list[list[int]]) -> list[int]:
        """The best tag sequence (Viterbi)."""
        move, start = self._moves
        scores = np.array([self.emit[f].sum(0) for f in found])
        best, came = start + scores[0], []
        for own in scores[1:]:
            ways = best[:, None] + move
            came.append(ways.argmax(0))
            best = ways.max(0) + own
        path = [int(best.argmax())]
        for back in reversed(came):
            path.append(int(back[path[-1]]))
        return path[::-1]


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode()) % HASHED


class Decoder:
    """The chain over all tokens of many texts at once.

    The scores of ``features`` are sums over parts that belong to one token each, so they are worked out once per different
    token and looked up. A run of tokens is tagged other than OUT only if the best sum of gains over OUT of any run around
    it is not negative; only such runs are decoded, with OUT on both sides, which gives the best path of the whole text.
    """

    def __init__(self, model: Crf):
        self.model = model
        self.edge = np.array([model.emit[_place(f"edge{step}")] for step in STEPS])
        self.named = np.array([[model.emit[_place(f"named={near}/{long_}")] for long_ in (False, True)] for near in range(6)]).reshape(-1, 3)
        self.words = [zlib.crc32(f"w{step}=".encode()) for step in STEPS]
        self.forget()

    def forget(self) -> None:
        # number 0 stands for what is in front of a text and behind it
        self.index: dict[str, int] = {}
        self.characters, self.held = 0, 1
        self.kinds: dict[tuple[tuple[str, ...], bool], int] = {}
        self.own, self.beside, self.flags = [np.zeros((4, 3))], [self.edge], [(False, False)]
        self.kind_of, self.around = np.zeros(1 << 10, np.int64), np.zeros((1 << 10, len(STEPS), 3))
        self.around[0] = self.edge

    def kind(self, token: str) -> int:
        """Number of the token's shape and whether it names secrets."""
        own, emit = (shapes(token), len(token) <= 24 and NAMES.search(token) is not None), self.model.emit
        if own not in self.kinds:
            shape, name = own
            self.kinds[own] = len(self.own)
            fixed = emit[[*(_place(f"s={s}") for s in shape), _place("1"), _place(f"name={name}")]].sum(0)
            self.own.append(fixed + emit[[_place(f"n={n}/{shape[-1]}") for n in range(4)]])
            self.beside.append(emit[[_place(f"s{step}={shape[0]}") for step in STEPS]])
            self.flags.append((name, len(shape) > 1))
        return self.kinds[own]

    def learn(self, tokens: list[str]) -> None:
        """Kinds of new tokens, and their scores as neighbours."""
        kinds = [self.kind(t) for t in tokens]
        words = [t.lower().encode() if len(t) <= 12 else b"" for t in tokens]
        places = np.array([[zlib.crc32(w, begun) for begun in self.words] for w in words], np.int64) % HASHED
        held, end = self.held, self.held + len(tokens)
        if end > len(self.kind_of):
            more = max(end, 2 * len(self.kind_of))
            self.kind_of, self.around = (np.concatenate([a, np.zeros((more - len(a), *a.shape[1:]), a.dtype)]) for a in (self.kind_of, self.around))
        self.kind_of[held:end] = kinds
        self.around[held:end] = self.model.emit[places] + np.array(self.beside)[kinds]
        self.index.update(zip(tokens, range(held, end), strict=True))
        self.held, self.characters = end, self.characters + sum(map(len, tokens))

    def scores(self, texts: list[str], secrets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every token's tags, and the bounds of the texts among the tokens."""
        if self.held > KEPT_TOKENS or self.characters > KEPT_CHARACTERS:
            self.forget()
        found = [TOKEN.findall(text) for text in texts]
        if new := set().union(*found).difference(self.index):
            self.learn(sorted(new))
        sizes = np.array([len(tokens) for tokens in found], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(bounds[-1])
        # two places of number 0 in front of every text and behind the last
        ids, at = np.zeros(len(place) + 2 * len(sizes) + 2, np.int64), place + 2 * text_of + 2
        ids[at] = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, len(place))
        del found
        kinds = self.kind_of[ids[at]]
        out = np.array(self.own).reshape(-1, 3)[4 * kinds + np.minimum(secrets, 3)[text_of]]
        around = self.around.reshape(-1, 3)
        for k, step in enumerate(STEPS):
            out += around[len(STEPS) * ids[at + step] + k]
        name, long_ = np.array(self.flags)[kinds].T
        names = np.maximum.accumulate(np.where(name, place, -9))
        last = np.concatenate([[-9], names])[: len(place)]
        near = np.where((last >= bounds[text_of]) & (place - last <= 5), place - last, 0)
        return out + self.named[2 * near + long_], bounds

    def runs(self, scores: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Runs of tokens out of which none can be tagged other than OUT, each within one text."""
        move, start = self.model._moves
        starts = bounds[:-1][np.diff(bounds) > 0]
        gains = scores[:, 1:] - scores[:, :1]
        most = (gains + (move[:, 1:].max(0) - move[OUT, OUT])).max(1)
        most[starts] = np.maximum(most[starts], (gains[starts] + (start[1:] - start[OUT])).max(1))
        # best sums of runs that end and that begin at a token; runs over the border of two texts only add tokens
        sums = np.concatenate([[0.0], np.cumsum(most)])
        ending = sums[1:] - np.minimum.accumulate(sums)[:-1]
        beginning = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[:-1]
        left = max(0.0, float((move[1:, OUT] - move[OUT, OUT]).max()))
        some = ending + beginning - most + left >= -1e-6
        edge = some.copy()
        edge[1:] &= ~some[:-1]
        edge[starts] = some[starts]
        firsts = np.flatnonzero(edge)
        stop = ~some
        stop[starts[1:]] |= True
        stops = np.append(np.flatnonzero(stop), len(some))
        ends = stops[np.searchsorted(stops, firsts, "right")]
        return list(zip(firsts.tolist(), ends.tolist(), strict=True))

    def tags(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best tags of every text (Viterbi), the runs side by side from long to short."""
        out = np.zeros(len(scores), np.int8)
        if not len(scores):
            return out
        move, start = self.model._moves
        runs = sorted(self.runs(scores, bounds), key=lambda r: r[0] - r[1])
        if not runs:
            return out
        first, end = (np.array(side) for side in zip(*runs, strict=True))
        size, text_starts = end - first, np.isin(first, bounds)
        best = np.where(text_starts[:, None], start, move[OUT]) + scores[first]
        lasts, came = np.zeros(len(runs), np.int8), []
        closing = np.where(np.isin(end, bounds)[:, None], 0.0, move[:, OUT])
        for step in range(int(size[0])):
            going = int(np.searchsorted(-size, -step))  # runs longer than the step
            if step:
                ways = best[:going, :, None] + move
                came.append(ways.argmax(1).astype(np.int8))
                best = ways.max(1) + scores[first[:going] + step]
            done = int(np.searchsorted(-size, -step - 1))  # from here on runs end at this step
            lasts[done:going] = (best[done:going] + closing[done:going]).argmax(1)
        now = np.zeros(len(runs), np.int8)
        for step in range(int(size[0]) - 1, -1, -1):
            going = int(np.searchsorted(-size, -step))
            longer = int(np.searchsorted(-size, -step - 1))
            if step < len(came):
                now[:longer] = came[step][np.arange(longer), now[:longer]]
            now[longer:going] = lasts[longer:going]
            out[first[:going] + step] = now[:going]
        return out

    def spans(self, texts: list[str], secrets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Start and end of what the chain tags, by text."""
        scores, bounds = self.scores(texts, secrets)
        found = self.tags(scores, bounds)
        begins = np.flatnonzero(found == BEGIN)
        stops = np.append(np.flatnonzero(found != INSIDE), len(found))
        ends = np.minimum(stops[np.searchsorted(stops, begins, "right")], bounds[np.searchsorted(bounds, begins, "right")])
        out: dict[int, list[tuple[int, int]]] = {}
        for text, a, b in zip((np.searchsorted(bounds, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            out.setdefault(text, []).append((a - int(bounds[text]), b - int(bounds[text])))
        for text, tokens in out.items():
            places = [m.span() for m in TOKEN.finditer(texts[text])]
            out[text] = [(places[a][0], places[b - 1][1]) for a, b in tokens]
        return out


def all_spans(texts: pa.Array, model: Crf | None) -> Iterator[tuple[int, str, list[tuple[str, int, int, int]]]]:
    """Row, text and spans of every text that has some: base spans, and the spans that the chain tags where no base span
    is; by start, then kind. The chain reads all tokens of all texts."""
    rank = {kind: k for k, (kind, *_) in enumerate(PATTERNS)} | {TAGGED: len(PATTERNS)}
    decoder = None if model is None else kept(f"secrets {zlib.crc32(b''.join(w.tobytes() for w in (model.emit, model.move, model.start)))}", lambda: Decoder(model))
    for row, end, data, bounds in text_slices(texts):
        base, held = patterned(data, bounds).tolist(), [""] * (end - row)
        for t in range(end - row) if decoder else base:
            held[t] = texts[row + t].as_py() or ""
        spans = {t: found for t in base if (found := base_spans(held[t]))}
        if decoder:
            counts = np.zeros(end - row, np.int64)
            counts[[*spans]] = [len(found) for found in spans.values()]
            for t, places in decoder.spans(held, counts).items():
                own = spans.get(t, [])
                added = [(TAGGED, a, b, a) for a, b in places if not any(a < last and b > first for _, first, last, _ in own)]
                if added:
                    spans[t] = sorted([*own, *added], key=lambda s: (s[1], rank[s[0]], s[2]))
        for t, found in sorted(spans.items()):
            yield row + t, held[t], found


@dataclass(frozen=True)
class SecretScan:
    """Find secrets in whole texts.

    Three fixed patterns give the base spans. A linear-chain conditional random field adds spans: it tags all tokens of
    all texts as begin, inside or outside, by their shape, the words around them and the number of base spans of the text,
    and decodes with Viterbi. It learns from the base spans of a bounded sample: ``sample``
    different texts that hold a long mixed run or a trigger word, and at most ``most_parts`` sequences of up to ``most_tokens``
    tokens from all over each, up to an eighth of them from where nothing looks like a secret (tasks cut them out, so that no
    text reaches the driver); and from variants of them with other secrets, names blanked and harmless long tokens (paths,
    dates) put in, so that it also learns from shape and place alone.

    Spans are in code points, end exclusive. NULL and empty texts have none. Repeated rows each get their spans, other
    columns stay as they are. Without any base span in the sample nothing is added.
    """

    sample: int = 500
    rounds: int = 60
    rate: float = 0.3
    shrink: float = 1e-4
    most_tokens: int = 64
    most_parts: int = 16
    text: str = "text"
    key: str = "doc_id"

    def fit(self, docs: DataFrame) -> Crf | None:
        def suspicious(batch: pa.RecordBatch) -> dict:
            found = [row + np.asarray(suspects(data, bounds, likely=True)) for row, _, data, bounds in text_slices(batch.column(0))]
            rows = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))
            return {"text": batch.column(0).take(rows)}

        # equal texts are learned from once at most: the sample goes by a hash of the text
        some = stored(batch_map(docs.select(self.text), "text string", suspicious).select(
            "text", F.xxhash64(F.lit("secrets"), "text").alias("place")), "suspects")
        chosen = F.broadcast(some.select("place").distinct().orderBy("place").limit(self.sample))  # bounded by sample
        texts = some.join(chosen, "place").dropDuplicates(["place"]).select("place", "text")
        kind = "place long, part int, features binary, sizes binary, tags binary"
        found = batch_map(texts, kind, self._examples).toArrow().sort_by([("place", "ascending"), ("part", "ascending")])
        rows, held = [], False
        for feature, size, tag in zip(*(found.column(c) for c in ("features", "sizes", "tags")), strict=True):
            sizes, label = np.frombuffer(size.as_buffer(), np.uint8), [*tag.as_py()]
            held = held or BEGIN in label
            rows.append((np.split(np.frombuffer(feature.as_buffer(), np.int32), np.cumsum(sizes.astype(np.int64))[:-1]), label))
        model = Crf().fit(rows, self.rounds, self.rate, self.shrink) if held else None
        del rows, found
        give_back()
        return model

    def _examples(self, batch: pa.RecordBatch) -> dict:
        """Sequences of each text to learn from: features and their number per token, and tags."""
        out = []
        for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans, parts = base_spans(text), []
            random = np.random.default_rng(zlib.crc32(text.encode()))
            held = windows(text, spans)
            for tokens in held:
                own = tags(tokens, spans)
                parts += [(tokens[k: k + self.most_tokens], own[k: k + self.most_tokens]) for k in range(0, len(tokens), self.most_tokens)]
            plain = self._plain(text, [(w[0][1], w[-1][2]) for w in held if w])
            most = min(len(plain), self.most_parts // 8)
            parts = self._some(parts, self.most_parts - most, random) + [(p, [OUT] * len(p)) for p in self._some(plain, most, random)]
            for part, label in parts:
                if label[0] == INSIDE:
                    label = [BEGIN, *label[1:]]
                changed = varied(part, label, random)
                for own_tokens, count in ((part, len(spans)), (changed, int(random.integers(len(spans) + 1)))):
                    each = features(own_tokens, count)
                    out.append((place, len(out), np.concatenate(each).astype(np.int32).tobytes(), bytes(map(len, each)), bytes(label)))
        columns = zip(*out, strict=True) if out else ((),) * 5
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ("place", "part", "features", "sizes", "tags")
        return {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}

    def _plain(self, text: str, held: list[tuple[int, int]]) -> list[list[tuple[str, int, int]]]:
        """Sequences of tokens between the windows."""
        out, at = [], 0
        for a, b in [*held, (len(text), len(text))]:
            tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, at, a)]
            out += [tokens[k: k + self.most_tokens] for k in range(0, len(tokens), self.most_tokens)]
            at = b
        return out

    @staticmethod
    def _some(parts: list, most: int, random: np.random.Generator) -> list:
        return [parts[k] for k in sorted(random.permutation(len(parts))[:most].tolist())] if len(parts) > most else parts

    def __call__(self, docs: DataFrame, keep: tuple[str, ...] | None = None, model: Crf | None = None) -> DataFrame:
        """The rows with ``spans`` added: kind, start, end, and where the secret itself starts."""
        model = model or self.fit(docs)
        names = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
        kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
        shared = docs.sparkSession.sparkContext.broadcast(model)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.int64())]))

        def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, found = batch.column(len(names)), [[] for _ in range(batch.num_rows)]
            for row, _, spans in all_spans(texts, shared.value):
                found[row] = [dict(zip(("kind", "start", "end", "secret"), s, strict=True)) for s in spans]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(found, kind)], names=[*names, "spans"])

        return batch_map(docs.select(*names, F.col(self.text).alias("_text")),
                         f"{kept}spans array<struct<kind:string,start:long,end:long,secret:long>>", scanned)

    def redact(self, docs: DataFrame, mask: str = "<secret>", model: Crf | None = None) -> DataFrame:
        """The rows with every secret replaced by ``mask``; all columns and all other text stay."""
        model = model or self.fit(docs)
        names, at = docs.columns, docs.columns.index(self.text)
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at)
            changed: dict[int, str] = {}
            for row, text, spans in all_spans(texts, shared.value):
                out, end = [], 0
                for a, b in sorted((s[3], s[2]) for s in spans):
                    if a >= end:
                        out += [text[end:a], mask]
                    end = max(end, b)
                changed[row] = "".join([*out, text[end:]])
            if not changed:
                return batch
            rows = sorted(changed)
            flags = np.zeros(batch.num_rows, bool)
            flags[rows] = True
            new = pa.compute.replace_with_mask(texts, pa.array(flags), pa.array([changed[r] for r in rows], texts.type))
            return pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(len(names))], names=names)

        return batch_map(docs, docs.schema, masked)
