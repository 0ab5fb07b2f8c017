"""Conversation operators against brute force and SQL, on whole small tables and on rows that are odd in every way."""

import hashlib
import random
import re
import zlib

import pytest
from compare import compare, connect

from loomwright.llm import conversation_repair as repair_module
from loomwright.llm import conversation_trie as trie_module
from loomwright.llm import queries as Q
from loomwright.llm.conversation_repair import Audit, ConversationRepair, Prefixes, dealt_damage
from loomwright.llm.conversation_trie import ConversationTrie, Full, Indexed, RadixTree

SCHEMA = "conv_id long, turn long, role string, text string, key string, node int, digest double"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()


def by_turn(turn, role, text):
    return turn is not None, turn or 0, digest(role, text)


def four(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs in every column, empty and long texts, ties, repeated rows, long conversations with shared beginnings, clashing names."""
    rnd = random.Random(3)
    rows = []
    for c in [None, *range(60)]:
        copy = rnd.random() < 0.3
        for t in range(rnd.choice([0, 1, 2, 5, 9, 30])):
            role = "user" if copy else rnd.choice(["user", "assistant", "system", None, "tool", "", "User"])
            text = "same" if copy else rnd.choice([None, "", " \n", "Hi.", "hi", "a!  \t", "é?", "..x", "long " * 20_000 if t == 2 and c == 7 else "end."])
            rows.append((c, rnd.choice([t, t, t, None, 2 * t]), role, text))
    for c in (1000, 1005, 1010, 1011):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"long{t}" if c != 1011 or t < 20 else "other") for t in range(30)]
    rows += [(99, 0, "user", "x")] * 3
    return spark.createDataFrame([(*r, "k", 1, 2.0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_conversation_trie"])
def test_equal_to_sql(spark, sf, name):
    assert compare(Q.QUERIES[name](spark, sf), connect(sf), Q.ORACLES[name]) == []


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if lot:
            out += [(c, t, "user" if lot == 4 else r, "" if lot == 1 else re.sub("[.!?]", "", x) if lot == 2 else x)] * (2 if lot == 3 else 1)
    return out


STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def freely(state):
    return "a" if state == "u" else "u"


def by_whole_texts(initials, faults):
    """The least (cost, audit) by a table of whole texts."""
    def closed(best):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit) in [*best.items()]:
                to, new = freely(state), (cost + 3, audit + "I")
                if to not in best or new < best[to]:
                    best[to], changed = new, True
        return best

    best = closed({"": (0, "")})
    for initial, fault in zip(initials, faults, strict=True):
        offers = []
        for state, (cost, audit) in best.items():
            offers.append((state, (cost + 4, audit + "D")))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                offers.append((freely(state), (cost + 3 + more, audit + "R")))
                if (state, initial) in STEPS:
                    offers.append((STEPS[state, initial], (cost + more, audit + "K")))
        best = closed({state: min(o for s, o in offers if s == state) for state, _ in offers})
    return min(best[state] for state in ("", "a") if state in best)


def by_all_edits(initials, faults):
    """The least (cost, audit) of all edits of a few rows."""
    best = (10**9, "")

    def go(i, state, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(initials) and state in ("", "a"):
            best = min(best, (cost, audit))
        go(i, freely(state), cost + 3, audit + "I")
        if i < len(initials):
            go(i + 1, state, cost + 4, audit + "D")
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if (state, initials[i]) in STEPS:
                    go(i + 1, STEPS[state, initials[i]], cost + more, audit + "K")
                go(i + 1, freely(state), cost + 3 + more, audit + "R")

    best = (4 * len(initials), "D" * len(initials))
    go(0, "", 0, "")
    return best


def edited(audit, rows):
    out, state, left = [], "", iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[2:]
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if freely(state) == "a" else "user"
        out.append(f"{role}:{text}")
        state = role[0]
    assert next(left, None) is None
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in out))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_repair(rows):
    convs = {r[0]: [] for r in rows}
    for row in damaged(rows):
        convs[row[0]].append(row)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: by_turn(*r[1:]))
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = SOLID.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = by_whole_texts([r[2][:1] for r in own], faults)
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, edited(audit, own)))
    return sorted(out, key=str)


def repair(df):
    return sorted([tuple(r) for r in ConversationRepair()(df, dealt_damage).collect()], key=str)


def test_repair_is_exact_on_odd_rows(odd, monkeypatch):
    monkeypatch.setattr(repair_module, "COMPACT", 16)
    assert repair(odd) == brute_repair(four(odd))


def test_repair_of_given_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert repair(rows) == brute_repair(four(rows))


def test_repair_of_nothing(empty):
    assert repair(empty) == []


def test_repair_without_damage(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Alone.")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in ConversationRepair()(rows).collect()}
    assert got == {1: (0, "KK"), 2: (3, "IK")}


@pytest.mark.parametrize(("compact", "modulus"), [(4096, None), (16, None), (4096, 3)])
def test_audit_is_the_least(monkeypatch, compact, modulus):
    """Also with hashes that collide nearly always."""
    monkeypatch.setattr(repair_module, "COMPACT", compact)
    if modulus:
        monkeypatch.setattr(repair_module, "MODULUS", modulus)
    rnd = random.Random(compact)
    for k in range(400):
        n = rnd.choice([0, 1, 2, 3, 4, 8, 30, 200])
        initials = [rnd.choice("usax" if k % 2 else "ua") if rnd.random() < 0.5 else "ua"[i % 2] for i in range(n)]
        faults = [rnd.choice(["", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        audit, letters = Audit(), ""
        for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
            audit.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
            if i % 7 == 0:
                letters += audit.settled()
        cost, rest = audit.finished()
        assert (cost, letters + rest) == by_whole_texts(initials, faults)
        if n <= 4:
            assert (cost, letters + rest) == by_all_edits(initials, faults)


def test_texts_compare_like_strings(monkeypatch):
    monkeypatch.setattr(repair_module, "MODULUS", 5)
    rnd = random.Random(2)
    texts = Prefixes()
    nodes = {}
    for _ in range(300):
        text = rnd.choice(["", "KK", "KKDKKDKKDKKD"]) + "".join(rnd.choice("DIKR") for _ in range(rnd.randint(0, 9)))
        node = 0
        for letter in text:
            node = texts.grown(node, letter)
        nodes[text] = node
        assert texts.text(node) == text
    for one in nodes:
        for other in rnd.sample([*nodes], 20):
            assert texts.less(nodes[one], nodes[other]) == (one < other)


def test_undecided_rows_stay_few():
    rnd = random.Random(4)
    audit, most = Audit(), 0
    for i in range(20_000):
        audit.row(rnd.choice("usa"), rnd.random() < 0.05, rnd.random() < 0.05)
        if i % 64 == 0:
            audit.settled()
            most = max(most, len(audit.texts.letter))
    assert most < 2 * repair_module.COMPACT

def brute_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((by_turn(t, r, x), (r, x)))
    own = {c: [v for _, v in sorted(turns, key=lambda p: p[0])] for c, turns in convs.items()}
    nodes, children = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        for d in range(len(built) + 1):
            nodes.setdefault(built[:d], []).append((c, len(built) == d))
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = sum(saved[p] for p in below) + ((len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in members if end))
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), parent, len(members), len(children.get(path, [])), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(df, **how):
    return sorted([tuple(r) for r in ConversationTrie(**how)(df).collect()], key=str)


@pytest.mark.parametrize(("segment", "chunk"), [(256, 4096), (4, 4096), (3, 2)])
def test_trie_is_exact_on_odd_rows(odd, monkeypatch, segment, chunk):
    monkeypatch.setattr(trie_module, "CHUNK_PATHS", chunk)
    monkeypatch.setattr(trie_module, "TEXT_BYTES", 8)
    assert trie(odd, segment=segment) == brute_trie(four(odd))


def test_trie_of_given_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert trie(rows) == brute_trie(four(rows))


def test_trie_of_nothing(empty):
    assert trie(empty) == []


def test_radix_tree_holds_its_keys():
    rnd = random.Random(1)
    keys = sorted({bytes(rnd.randrange(b) for _ in range(16 * rnd.randint(1, 4))) for b in (2, 5, 30, 256) for _ in range(400)})
    tree = RadixTree()
    for k in rnd.sample(range(len(keys)), len(keys)):
        tree.add(keys[k], k)
    found, kinds, stack = [], set(), [tree.root]
    while stack:
        node = stack.pop()
        kinds.add(type(node.children))
        if node.path is not None:
            assert node.key[: node.end] == keys[node.path]
            found.append(node.path)
        stack += reversed([*(node.children or ())])
    assert found == list(range(len(keys)))
    assert {Indexed, Full} <= kinds
