"""Ranked lexical search against a plain model, over one and several blocks of items, on awkward rows."""

import math
import random
import re
from collections import Counter

import pytest

from envspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, n int, hash string, score double, item_id int"
ITEMS = "item_id bigint, text string, doc_id int"


def plain(docs, items, k):
    """The scores as the rules state them, document by document."""
    split = lambda t: TERM.findall((t or "").translate(FOLD))
    held = [(i, split(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    docs_n, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = Counter()
    for item, text in items:
        found = []
        for doc, tf, n in held:
            m = 100 - 50 + (50 * n * docs_n) // length
            score = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
                        for t in set(split(text)) if t in tf)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(found)[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def tables(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "h", 0.5, 2) for i, t in docs], SCHEMA).repartition(5),
            spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS))


@pytest.mark.parametrize("block_items,k", [(2000, 50), (2, 5)])
def test_equals_the_plain_model(spark, monkeypatch, block_items, k):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(lexical, "CELLS", 16)
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "日本", "x1", "the", "zeta_q", "a-b", "KK"]
    say = lambda n: r.choice([" ", ", ", "\0", "\n"]).join(r.choice(words) for _ in range(n))
    docs = [(i, say(r.randint(1, 12))) for i in range(150)]
    docs += [(1000 + i, "alpha beta the") for i in range(80)]  # a large group of copies
    docs += [(None, "alpha beta the"), (None, "gamma"), (7, None), (8, ""), (9, " !?"), (3, docs[3][1]), (3, docs[3][1]), (10, "the " * 20_000)]
    items = [(0, "alpha beta"), (1, "the THE gamma x1"), (None, "été 日本"), (4, None), (5, "..."), (6, "unseen words"), (1, "the THE gamma x1"), (9, "a b q kK")]
    got = lexical.search(*tables(spark, docs, items), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(docs, items, k)


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, "alpha"), (2, None)], [(0, "alpha")])
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("doc_id = 2"), items).count() == 0


def test_length_part_is_exact_for_large_numbers(spark):
    n, docs, length = 987_654_321, 999_999_999_999, 7_000_000_000_003
    got = spark.range(1).select(lexical.length_part(lexical.F.lit(n), docs, length)).first()[0]
    assert got == 100 - 50 + (50 * n * docs) // length
