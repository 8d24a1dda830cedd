"""The trie of conversation prefixes against a plain trie in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from lorewright.llm.conversation_trie import prefix_trie
from lorewright.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, depth long, owner string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        first = turns.get(c - int(c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = tuple(first[:h] + turns[c][h:])
    return out


def plain(rows):
    convs, members = rebuilt(rows), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    for node, who in members.items():
        below, stack = [], [node]
        while stack:
            below.append(stack.pop())
            stack += kids[below[-1]]
        ends = ",".join(map(str, sorted(c for c in who if convs[c] == node)))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append(
            (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids[node]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in prefix_trie(df, Scratch(spark, "t12"), **more).collect()), key=repr)
    assert got == plain(rows)
    return got


def test_shared_openings_copies_and_short_conversations(spark):
    rnd, rows = random.Random(2), []
    for c in [*range(130), *range(195, 320, 3), -7, -100, -205]:
        for t in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant"]), rnd.choice(["hello", "hé", "", "what now?"]), 5, "x"))
    rnd.shuffle(rows)
    got = check(spark, rows)
    assert max(r[3] for r in got) > 100 and any(r[3] > 1 and r[5] > 1 for r in got)
    check(spark, rows, block=2, ids=3)


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, None, None, "first", None, None), (1, 0, "user", None, None, None), (1, 0, "user", "b", None, None), (1, 0, "bot", "a", None, None),
        (2, 3, "user", "same", 1, ""), (2, 3, "user", "same", 1, ""), (None, 1, "user", "nobody", 1, ""), (7, 1, "us", "er", 1, ""), (9, 1, "user", "", 1, ""), (11, 1, "u", "ser", 1, ""),
    ]
    check(spark, rows)
    assert prefix_trie(spark.createDataFrame([], SCHEMA), Scratch(spark, "t12")).count() == 0
    assert prefix_trie(spark.createDataFrame(rows[6:7], SCHEMA), Scratch(spark, "t12")).count() == 0


def test_one_very_long_conversation(spark):
    rows = [(200, i, "user", f"turn {i % 7}", 0, "") for i in range(700)] + [(c, i, "user", f"turn {i % 7}", 0, "") for c in range(201, 215) for i in range(c % 9)]
    check(spark, rows, block=64, ids=4)
