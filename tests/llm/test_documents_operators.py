"""The document operators against plain models, on given tables and on awkward rows."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import MEDIUM, SMALL
from tokenizers import Tokenizer

from envspark.llm import bpe, lcp, licenses, packing, quality, secrets, simhash, toxicity
from envspark.llm.common import documents, labels

SCHEMA = "doc_id bigint, text string, score string, start string, label int, part string, n_chars int, key string, row int"
LONG = "The mit license. token = 'abcdef123456' you idiot! " * 4000
TEXTS = ["", None, " ", "a", "A b", "mit license mit license", "General  Public\nLicense", "a" * 5000, "é ß 日本 🙂 <|endoftext|>x",
         LONG, LONG, "the idiot is you", "password: hunter2hunter2", "\t\n\x0b x\x1cy", "one two three four five"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "s", "x", 1, "p", 7, "k", 3) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9], rows[5]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def given(spark):
    return {r.doc_id: r.text or "" for r in documents(spark, SMALL).select("doc_id", "text").collect()}


# ---- op10 ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library_and_round_trips(spark, odd, none):
    hf = Tokenizer.from_file(bpe.TOKENIZER)
    for docs in (documents(spark, SMALL), odd):
        got = bpe.digests(docs).collect()
        assert len(got) == docs.count()
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = hf.encode(r.text or "", add_special_tokens=False).ids
            back = hf.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(back.encode()).hexdigest()))
        assert Counter(map(tuple, got)) == Counter(want)
    both = bpe.decode(bpe.encode(odd)).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in both)
    assert bpe.digests(none).count() == 0


def test_bpe_random_texts():
    hf, c, rng = Tokenizer.from_file(bpe.TOKENIZER), bpe.codec(), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", "'", "_", "a", "the", "é", "²", "½", "日本", "🙂", "\xa0", "\x1c", "՘", "123", "<|endoftext|>", "<|end"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert c.ids(t).tolist() == hf.encode(t, add_special_tokens=False).ids, t


# ---- op4 -----------------------------------------------------------------------------------------------------------


def test_packing_places_every_id_once(spark, odd, none):
    hf = Tokenizer.from_file(bpe.TOKENIZER)
    for docs in (documents(spark, SMALL), odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        ids = {r.doc_id: np.array([*hf.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack_documents(docs).collect():
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        assert set(pieces) == set(ids)
        for doc_id, rows in pieces.items():
            at = 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids[doc_id])
                assert r.ids_crc32 == zlib.crc32(ids[doc_id][at:at + r.length].tobytes())
                at += r.length
            assert at == len(ids[doc_id])
        padded = 0
        for rows in sequences.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= packing.CAPACITY
            padded += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
        assert padded <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack_documents(none).count() == 0
    assert packing.pack_documents(odd).where("start = 0").count() == odd.count()


def test_differencing_is_even_and_counts_rise():
    rng = random.Random(2)
    lengths = [rng.randint(1, 512) for _ in range(800)]
    part = packing.differencing(lengths, 100)
    sums = np.bincount(part, lengths, 100)
    assert sums.sum() == sum(lengths) and sums.max() - sums.min() < 40
    part, k = packing.pack([1500, 1500, 1000], 2048)
    assert k == 3 and np.bincount(part, [1500, 1500, 1000]).max() <= 2048


# ---- op5 -----------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    """The base kinds as stated, without prefilters."""
    a = re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in
                   ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
                   + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


def test_secrets_keep_base_spans(spark, odd, none):
    docs = documents(spark, MEDIUM).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    for r in secrets.secret_spans(docs.dropDuplicates(["doc_id"])).collect():
        text = next(t for (i, t) in texts if i == r.doc_id)
        base = plain_secrets(text)
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        spans = r.spans.split(",") if r.spans else []
        if sum(i == r.doc_id for i, _ in texts) == 1:
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert set(joined.split(",") if joined else []) <= set(spans)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
    assert secrets.secret_spans(odd).count() == odd.count() and secrets.secret_spans(none).count() == 0


@pytest.mark.parametrize("text, secret", [
    ('x = "aGVsbG8xMjM0"\ny = x + "ZZ99"\nclient_secret = y', "aGVsbG8xMjM0"),
    ("db:\n  password: Tr0ub4dor&3x9\n", "Tr0ub4dor&3x9"),
    ('{"privateKey": "abc123DEF456", "name": "bob"}', "abc123DEF456"),
    ("postgres://user:s3cr3tPw9@host/db", "s3cr3tPw9"),
    ('auth_token = "abc" +\n  "DEF123456"', "DEF123456"),
])
def test_secrets_by_assignment(text, secret):
    spans = secrets.scan(text)
    assert any(k == 3 and text[a:b] == secret for a, k, b, _ in spans)
    assert secret not in secrets.redact(text, spans)


def test_secret_placeholders_and_propagation_stay_bounded():
    assert secrets.scan('password = "changeme"')[0][1] == 0 and len(secrets.scan('password = "changeme"')) == 1
    assert not secrets.scan('secret_file = "/etc/abc123DEF"')
    assert len(secrets.scan("x = 'ab12CD34'\n" + "x = x + x\n" * 200 + "secret_value = x")) < 10


def test_secrets_of_any_length_and_by_key():
    long = base64.b64encode(hashlib.sha512(b"key").digest() * 80).decode()
    for text in (f'private_key = "{long}"', f'a = "{long[:3000]}" + "{long[3000:]}"\nclient_secret = a', f"private_key: {long}\n"):
        left = secrets.redact(text, secrets.scan(text))
        assert len(left) < 60 and long[:20] not in left and long[-20:] not in left
    text = f'a = "Xy12Zw34Qv56"\na = "{long}"\nclient_secret = a'
    assert [text[a:b] for a, k, b, _ in secrets.scan(text) if k == 3] == [long]
    text = 'a = "Xy12Zw34Qv56"\na = ""\nclient_secret = a'
    assert not [s for s in secrets.scan(text) if s[0] < 18]
    for text in ('config["db_password"] = "Tr0ub4dor&3x9"', "os.environ['API_KEY'] = 'Tr0ub4dor&3x9'", '$c["a"]["secret"]="Tr0ub4dor&3x9";'):
        assert [text[a:b] for a, k, b, _ in secrets.scan(text) if k == 3] == ["Tr0ub4dor&3x9"]
    assert not secrets.scan('if config["db_password"] == "Tr0ub4dor&3x9": pass')
    many = "s = 'aB3'\n" + "".join(f"s = s + 'k{i}'\n" for i in range(5000)) + "client_secret = s\nauth_token = s\n"
    assert sum(k == 3 for _, k, _, _ in secrets.scan(many)) == 5001
    assert not secrets.scan('a = "place"\nb = "holder"\nclient_secret = a + b + "1X2y3Z4w"')


# ---- op7 -----------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fingerprint -> smallest fingerprint of its component, from all pairs."""
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2 and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {f: top(f) for f in fps}


def test_simhash_equals_all_pairs(spark, odd, none):
    for docs in (documents(spark, SMALL), odd):
        rows = [(r.doc_id, plain_fingerprint(r.text or "")) for r in docs.select("doc_id", "text").collect()]
        roots = plain_components({f for _, f in rows})
        least = {}
        for i, f in rows:
            if i is not None:
                least[roots[f]] = min(i, least.get(roots[f], i))
        want = Counter((i, f"{f:016x}", least.get(roots[f])) for i, f in rows)
        assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(root) for root in set(roots.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_large_buckets_lose_no_link(spark):
    rng, fps = random.Random(3), set()
    centre = rng.getrandbits(64)
    while len(fps) < 500:
        f = centre
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    order = sorted(fps)
    roots = plain_components(order)
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(order)], "doc_id bigint, fp bigint")
    want = {signed(f): min(i for i, g in enumerate(order) if roots[g] == roots[f]) for f in order}
    for bucket in (2, 10_000):
        assert {r.fp: r.component_id for r in simhash.grouped(df, bucket).collect()} == want


# ---- op8 -----------------------------------------------------------------------------------------------------------


def test_lcp_edits_and_neighbours(spark, none):
    rows = sorted(given(spark).items(), reverse=True)
    got = {r.doc_id: r for r in lcp.edited_likeness(documents(spark, SMALL)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        own, new, other = (lcp.fingerprints_of([x])[0] for x in (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, new)
        assert (r.near_edited, r.near_next) == (lcp.likeness(own, new), lcp.likeness(own, other))
    assert lcp.edited_likeness(none).count() == 0


def test_lcp_awkward_rows(spark, odd):
    rows = lcp.edited_likeness(odd).collect()
    assert len(rows) == odd.count()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    alone = lcp.edited_likeness(spark.createDataFrame([(7, "abc")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0
    assert lcp.likeness(lcp.EMPTY, lcp.EMPTY) == 1.0 and lcp.likeness(lcp.EMPTY, lcp.fingerprints_of(["x"])[0]) == 0.0


def test_lcp_shares_signatures_at_any_offset(spark):
    text = max(given(spark).values(), key=len)
    own, moved, other = lcp.fingerprints_of([text, "some other words before " + text, text[::-1]])
    assert lcp.likeness(own, moved) > 0.8 > 0.1 > lcp.likeness(own, other)


# ---- op2 -----------------------------------------------------------------------------------------------------------


def test_license_base_places(spark, odd, none):
    for docs in (documents(spark, MEDIUM), odd):
        want = []
        for r in docs.select("doc_id", "text").collect():
            lower = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
            words = re.findall(licenses.WORD, lower)
            places = [(i, label) for p, label in licenses.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
            starts = [i for i, _ in places]
            want.append((r.doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None),
                         ",".join(sorted({label for _, label in places}))))
        rows = licenses.license_scan(docs).collect()
        assert Counter(tuple(r)[:6] for r in rows) == Counter(want)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert licenses.license_scan(none).count() == 0


def test_license_notices(spark):
    notices = [(i, f"# {notice.upper()}\n", label) for i, (label, notice, _) in enumerate(licenses.TEMPLATES)]
    filler = [(100 + i, f"words without notice {i}") for i in range(200)]
    docs = spark.createDataFrame([n[:2] for n in notices] + filler, "doc_id bigint, text string")
    found = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(docs).collect()}
    assert all(label in found[i] for i, _, label in notices)


def test_license_whole_key_phrases(spark):
    mit = next(n for label, n, _ in licenses.TEMPLATES if label == "mit-permission")
    cases = [("this work is licensed under the gnu general public license version 2", "gpl-3.0"),
             ("licensed under the apache license version 1 1", "apache-2.0"),
             (mit.replace("free of charge", "at no charge"), "mit-permission"),
             ("redistribution and use in object and binary forms with or without modification are permitted provided that the "
              "following conditions are met", "bsd"),
             ("permission to use copy modify and or distribute this software for any purpose with or without fee is always "
              "granted", "isc")]
    common = "this is the free source version of a public work and 0 to 3 are in use for or with it by"  # in every filler
    filler = [(100 + i, f"{common} {i}x") for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)] + filler, "doc_id bigint, text string")
    found = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(docs).collect()}
    assert all(label not in found[i] for i, (_, label) in enumerate(cases))
    whole = [(i, n) for i, (_, n, _) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame(whole + filler, "doc_id bigint, text string")
    found = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(docs).collect()}
    assert all(licenses.TEMPLATES[i][0] in found[i] for i, _ in whole)


def test_license_many_notices_in_a_file(spark):
    notices = [n for _, n, _ in licenses.TEMPLATES]
    some = [n for label, n, _ in licenses.TEMPLATES if label in ("mit-permission", "epl", "bsd", "apache-2.0")]
    docs = spark.createDataFrame([(0, "\n\n".join(notices)), (1, ". ".join(some)), (2, " words ".join(notices) * 300)]
                                 + [(100 + i, f"plain words {i} mit") for i in range(200)], "doc_id bigint, text string")
    found = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(docs).collect()}
    assert found[0] >= {label for label, *_ in licenses.TEMPLATES} and found[2] >= found[0]
    assert found[1] >= {"mit-permission", "epl", "bsd", "apache-2.0"}


# ---- op3 -----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark, odd, none):
    marks = labels(spark, MEDIUM)
    got = {r.doc_id: r for r in toxicity.scored(documents(spark, MEDIUM), marks).collect()}
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    assert sum(t == 0 and p == 1 for t, p in held) <= 2
    scored = toxicity.scored(odd, marks)
    assert scored.count() == odd.count() and scored.where("score is null or predicted is null").count() == 0
    assert toxicity.scored(none, marks.limit(0)).count() == 0
    assert toxicity.without_toxic(odd, marks).columns == odd.columns


def test_toxicity_never_learns_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"blargh{i % 2} word filler") for i in range(400)], "doc_id bigint, text string")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    marks = spark.createDataFrame([(i, 1) for i in held], "doc_id bigint, toxic int")
    assert toxicity.learn(docs, marks) == toxicity.Grammar()


def test_toxicity_scores_patterns_by_context():
    g = toxicity.Grammar()
    alone, targeted, negated, said, piled = (g.score(t) for t in (
        "an idiot here", "you idiot", "you are not an idiot", "he said idiot", "an idiot here. such scum"))
    assert alone == g.score("some words")  # a word alone has no score
    assert g.score("you idiot. you scum") > piled > said > alone and targeted > said and targeted > negated > alone
    assert g.score("trash on the street") == g.score("wood will. burn") == alone and g.score("you will burn") > alone
    assert g.features("an idiot, you")[:2] == [0.0, toxicity.SEED_WEIGHT]


def plain_features(g, text):
    """The classes by their rules, clause by clause, without any automaton."""
    clauses, out = [[]], [0.0] * 6
    for word in toxicity._TOKEN.findall(text.lower()):
        symbol, weight = g.symbol(word)
        if symbol == toxicity.END:
            clauses.append([])
        else:
            clauses[-1].append((symbol, weight))
    insults = sum(s == toxicity.I for c in clauses for s, _ in c)
    seen = 0
    for clause in clauses:
        for k, (symbol, weight) in enumerate(clause):
            before = [s for s, _ in clause[:k]]
            since = before[len(before) - before[::-1].index(toxicity.C):] if toxicity.C in before else before
            negated, reported, target = toxicity.N in since, toxicity.R in since, toxicity.T in before
            if symbol == toxicity.I:
                seen += 1
                if negated or reported:
                    out[2 if negated else 3] += weight
                elif target or any(s == toxicity.T for s, _ in clause[k + 1:]):
                    out[1] += weight
                elif insults > 1:
                    out[0] += weight
            elif symbol == toxicity.K and (target or toxicity.FUT in before):
                out[5 if negated or reported else 4] += weight
    return out


def test_toxicity_grammar_equals_the_plain_rules():
    g, r = toxicity.Grammar(), random.Random(11)
    words = ["idiot", "scum", "trash", "you", "your", "not", "said", "but", "kill", "will", ".", "!", "a", "word", "house"]
    for _ in range(3000):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 14)))
        assert g.features(text) == pytest.approx(plain_features(g, text)), text


def test_toxicity_leaves_out_equal_texts_only(spark):
    docs = spark.createDataFrame([(i, f"extraordinarily other words {i % 50}", 1) for i in range(200)]
                                 + [(5, "a second text of one id", 1)] * 30, "doc_id bigint, text string, toxic int")
    marks = spark.createDataFrame([(i, 0) for i in range(200)], "doc_id bigint, toxic int")
    got = [r.text for r in toxicity.training_rows(docs, marks, "text", 20_000).collect()]
    assert len(got) == len(set(got)) and len(got) in (50, 51)
    grouped = toxicity.witnesses(spark.createDataFrame([(t, 0) for t in got], "text string, toxic int"))
    assert 1 <= grouped.count() <= 2  # one witness of a word, while all of them train the model


# ---- op9 -----------------------------------------------------------------------------------------------------------


def test_quality_against_labels(spark, odd, none):
    got = {r.doc_id: r for r in quality.classified(documents(spark, MEDIUM)).collect()}
    truth = {r.doc_id: r.quality for r in labels(spark, MEDIUM).collect()}
    clean = [got[i].quality for i, q in truth.items() if q == 1]
    junk = [got[i].quality for i, q in truth.items() if q == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.3
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.votes == quality.votes(given_text) for r, given_text in
                                    ((got[d.doc_id], d.text or "") for d in documents(spark, MEDIUM).limit(50).collect()))
    assert quality.classified(odd).count() == odd.count() and quality.classified(none).count() == 0
    assert quality.good_only(odd).columns == odd.columns


def test_quality_em_finds_the_bad_labeller():
    rng, counts = random.Random(4), Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        right = lambda p: str(int(good if rng.random() < p else not good))
        counts[right(0.95) + right(0.9) + right(0.9) + right(0.5)] += 1
    p = quality.expectation_maximisation(counts)
    assert p["1110"] > 0.95 and p["0001"] < 0.05 and abs(p["1111"] - p["1110"]) < 0.05


def test_quality_votes_do_not_change_with_the_length():
    sentence = "one short sentence repeated over and over. "
    assert {quality.votes(sentence * n) for n in (100, 200, 290, 400, 5000)} == {quality.votes(sentence * 50)}
    r = random.Random(2)
    varied = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(9000))
    assert quality.votes(varied)[5] == quality.votes(varied[:3000])[5] == quality.GOOD


@pytest.mark.parametrize("text", ["a = 1\n" + "plain words here " * 65_000, "x = 1 " + '{\\"password\\": \\"hunter2hunter2\\", ' * 30_000,
                                  "password: " + "'" * 500_000, "token" + " " * 1_000_000])
def test_secret_scans_of_long_lines_are_linear(text):
    start = time.perf_counter()
    assert isinstance(secrets.scan(text), list)
    assert time.perf_counter() - start < 4


def test_a_quote_that_nothing_closes_settles_its_line():
    r = random.Random(9)
    for _ in range(4000):
        line = "".join(r.choice("\"'`\\\\ax= ") for _ in range(r.randint(1, 25)))
        for quote, rest in secrets._STRING.items():
            plain = re.compile(quote + (r"(?:[^\\%s]|\\.)*" % quote if quote != "`" else "[^`]*") + quote)
            open_at = [i for i, c in enumerate(line) if c == quote]
            slow = [plain.match(line, i) for i in open_at]
            assert [m and m.end() for m in slow] == [m and m.end() for m in (rest.match(line, i + 1) for i in open_at)]
            assert not any(a is None and b is not None for a, b in zip(slow, slow[1:])), line


def plain_phrases(symbols):
    """One level of the parse by its rule, symbol by symbol: the phrases' (symbol, run length) sequences."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    mix = lambda x: int(lcp._mix(np.array([x], np.uint64))[0])
    names = [s if n == 1 else mix((s + n * 0x9E3779B97F4A7C15) % 2**64) for s, n in runs]
    labels = names
    for _ in range(lcp.ROUNDS):
        tossed = []
        for k, own in enumerate(labels):
            differ = own ^ labels[k - 1] if k else 1
            place = (differ & -differ).bit_length() - 1
            tossed.append(2 * place + (own >> place & 1))
        labels = tossed
    starts = [k for k, x in enumerate(labels) if k == 0 or k < len(labels) - 1 and labels[k - 1] < x >= labels[k + 1]]
    return [names[a:b] for a, b in zip(starts, [*starts[1:], len(names)])]


def test_lcp_parse_equals_the_rule_symbol_by_symbol():
    r = random.Random(6)
    for _ in range(300):
        texts = ["".join(r.choice("aab cdé日") for _ in range(r.randint(1, 60))) for _ in range(3)]
        sym = np.array([ord(c) for t in texts for c in t], np.uint64)
        doc = np.repeat(np.arange(3), [len(t) for t in texts])
        names, docs = lcp.parse(sym, doc)
        want = [p for t in texts for p in plain_phrases([ord(c) for c in t])]
        by_name = {}
        assert len(names) == len(want) and docs.tolist() == [k for k, t in enumerate(texts) for _ in plain_phrases([ord(c) for c in t])]
        for name, phrase in zip(names.tolist(), want):  # equal phrases have equal names, others different ones
            assert by_name.setdefault(tuple(phrase), name) == name
        assert len(set(by_name.values())) == len(by_name)


def test_packing_many_tiny_pieces_takes_little_room():
    import tracemalloc

    tracemalloc.start()
    part, k = packing.pack([1] * 60_000, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(part, minlength=k).max() <= 256 and len(part) == 60_000
    assert peak < 60_000 * 1500  # with every partition at full width it would be 60,000 x 235 x 16 bytes


def test_packing_differencing_balances_like_whole_partitions():
    def plain(lengths, k):
        parts = [[x] + [0] * (k - 1) for x in lengths]
        while len(parts) > 1:
            parts.sort(key=lambda p: p[-1] - p[0])
            a, b, *rest = parts
            parts = [*rest, sorted((x + y for x, y in zip(a, b[::-1])), reverse=True)]
        return parts[0]

    r = random.Random(8)
    for _ in range(200):  # different lengths far apart, so that no two imbalances are equal
        k, lengths = r.choice([1, 2, 3, 7]), [2 ** i + r.randint(0, i) for i in r.sample(range(4, 40), r.randint(1, 12))]
        got = np.bincount(packing.differencing(lengths, k), lengths, k)
        assert sorted(got, reverse=True) == plain(lengths, k)
