"""Token counts against the library itself, by both ways of the join, on given tables and on awkward rows."""

import random
from collections import Counter

import pytest
import sentencepiece
from conftest import SMALL

from envspark.llm import tokencounts
from envspark.llm.common import documents

SCHEMA = "doc_id bigint, text string, unit string, row int, times int, n_tokens string"
TEXTS = ["", None, " ", "   ", "▁", "a b", "a  b   c", " lead", "trail ", "two\n\nlines \n x", "x" * 20_000, "日本語" * 300, "12 345a6",
         "<s> </s> <unk> <0x0A>", "a\0b", "🙂é\tß\r\n", "the the the of " * 5000, "the the the of " * 5000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokencounts.MODEL)


def test_random_texts_are_cut_where_no_piece_crosses(library):
    p, r = tokencounts.pieces(), random.Random(4)
    signs = " ▁  abthe\n\t19é日🙂<s></s>\r\0%({;'"
    for _ in range(2000):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 40)))
        assert "".join(p.units(t)) == ((p.prefix + t.replace("▁", " ")) if t else "")
        assert sum(p.count(p.units(t))) == len(library.encode(t)), t


@pytest.mark.parametrize("frequent", [0, 3, 100_000])
def test_counts_equal_the_library(spark, library, frequent):
    rows = [(None if i == 5 else i, t, "u", 1, 2, "n") for i, t in enumerate(TEXTS)]
    odd = spark.createDataFrame([*rows, rows[5], rows[16]], SCHEMA)
    for docs in (odd, documents(spark, SMALL)):
        got = tokencounts.token_counts(docs, frequent=frequent).collect()
        want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect()]
        assert Counter((g.doc_id, g.n_bytes, g.n_tokens) for g in got) == Counter(want)


def test_query_and_empty_table(spark, library):
    out = tokencounts.op13_tokencounts(spark, SMALL)
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in out.collect())
    none = spark.createDataFrame([], SCHEMA)
    assert tokencounts.token_counts(none).count() == 0 and tokencounts.token_counts(none, frequent=0).count() == 0
