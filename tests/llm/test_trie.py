"""The prefix trie against a plain model that walks every prefix, on random and awkward conversations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from envspark.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, t1 string, pos string"


def plain_sequences(rows, rebuild):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t[2] for t in sorted(ts)] for c, ts in turns.items()}
    if not rebuild:
        return turns
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    return out


def plain_nodes(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, m in members.items():
        ended = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(p))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(ended.encode()).hexdigest()] += 1
    return out


def random_rows(seed):
    r = random.Random(seed)
    says = [("user", "hi"), ("user", "hé"), ("assistant", "yes"), (None, "no"), ("user", None), ("", ""), ("us", "er")]
    rows = []
    for c in [*range(40), 77, -3, -5, 10**12]:
        n = r.choice([1, 2, 3, 9, 17, 30])
        same = r.random() < 0.5
        rows += [(c, r.choice([None, t, t, t, 3]), *(says[t % 3] if same else r.choice(says))) for t in range(n)]
    rows += [(200 + i, t, "user", f"line {t}") for i in range(30) for t in range(2)]  # a large group of copies
    rows += [(300, t, "user", f"long {t % 4}") for t in range(700)]  # one long conversation
    rows += [(301, 0, "user", "same")] * 60 + [(None, 1, "user", "lost"), (5, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild,chunk", [(True, 4096), (True, 3), (False, 3)])
def test_equals_the_plain_model(spark, monkeypatch, rebuild, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = random_rows(chunk)
    df = spark.createDataFrame([(*x, 1, "t", "p") for x in rows], SCHEMA).repartition(4)
    numbered = trie.numbered(df)
    got = trie.trie(trie.rebuilt(numbered) if rebuild else trie.as_they_are(numbered))
    assert Counter(map(tuple, got.collect())) == plain_nodes(plain_sequences(rows, rebuild))


def test_conversations_without_turns_left_are_members_of_the_root(spark):
    rows = [(7, 0, "user", "only")]  # its first turns would come from 5, which is not there
    assert zlib.crc32(b"7") % 9 > 0
    got = trie.trie(trie.rebuilt(trie.numbered(spark.createDataFrame([(*x, 1, "t", "p") for x in rows], SCHEMA)))).collect()
    assert [tuple(g) for g in got] == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.trie(trie.rebuilt(trie.numbered(none))).count() == 0


def test_one_rollup_makes_the_prefixes(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a", 1, "t", "p")], SCHEMA)
    parts = trie.blocks(trie.as_they_are(trie.numbered(rows)))
    plan = trie.rolled_up(parts, conv_id="min(conv_id)")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
