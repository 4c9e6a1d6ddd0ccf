"""Filter audit, token counts and whitening against brute force, with their defined cases."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import filter_audit, token_counts, tokens, whitening
from evalspark.llm.queries import tokenizer_file
from tests.llm.test_operators import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, lang string, text string"

# Filter audit.


def fails(rows):
    """Of each row, the filters that it fails."""
    out = []
    for k, (i, _, text) in enumerate(rows):
        text = text or ""
        w = WORD.findall(text)
        found = {"A"} if len(w) < 100 else set()
        found |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        found |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        found |= {"D"} if re.search("[#$%&*|]", text) else set()
        found |= {"E"} if any((t or "") == text and i is not None and j is not None and j < i for m, (j, _, t) in enumerate(rows) if m != k) else set()
        out.append(found)
    return out


def plain_audit(rows, labels):
    failed, marks = fails(rows), {}
    for i, quality, toxic in labels:
        good, bad = marks.get(i, (False, False))
        marks[i] = (good or quality == 1, bad or toxic == 1)
    out = {}
    for part in {r[1] or "" for r in rows}:
        mine = [(f, marks.get(r[0], (False, False)) if r[0] is not None else (False, False)) for f, r in zip(failed, rows, strict=True) if (r[1] or "") == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                sums[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone)]
        for (name, order, step), row in out.items():
            if name == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(None, "en", None), (None, "en", "a copy"), (7, None, "a copy"), (8, "en", "a copy"), (8, "de", "a copy"), (9, "", ""), (10, "de", "É" * 20 + "AB")]
    for k in range(250):
        n = rng.choice([20, 99, 100, 101, 140])
        text = " ".join(words(n, k, rng.choice([80, 400, 10**6])))
        text = text.upper() if k % 7 == 0 else text
        text += " #" if k % 5 == 0 else ""
        rows.append((20 + k, rng.choice(["en", "de", None]), text if k % 11 else rows[-1][2]))
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if r[0] and r[0] % 3] + [(20, 0, 0), (20, 1, 1), (None, 1, 1)]
    return rows, labels


def test_filter_audit_matches_brute_force(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("p")).withColumn("mask", F.lit(1)).withColumn("digest", F.lit("d"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    got = audited(docs, marks)
    assert got == plain_audit(rows, labels) and len(got) == 3 * 600
    assert audited(docs.limit(0), marks) == {}
    assert {v[-2:] [0] for v in audited(docs, marks.limit(0)).values()} == {0}


def test_filter_audit_of_very_long_and_hot_texts(spark):
    rows = [(k, "en", "the same text") for k in range(300)] + [(1000, "en", " ".join(f"w{k}" for k in range(200_000))), (1001, "en", "x" * 500_000)]
    got = audited(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    # E alone is first: all copies but the smallest id go
    assert got["en", "EABCD", 1][:2] == (3, 299) and got["en", "ABCDE", 1][:2] == (1, 301)


def test_removal_polynomial_corners_and_shapley_sums():
    rng = random.Random(4)
    counts = [rng.randrange(50) for _ in range(32)]
    values = filter_audit.corners(filter_audit.removal_polynomial(counts))
    assert values == [sum(n for m, n in enumerate(counts) if m & corner) for corner in range(32)]
    sums = [0] * 5
    for order in permutations(range(5)):
        before = 0
        for k in order:
            sums[k] += values[before | 1 << k] - values[before]
            before |= 1 << k
    assert filter_audit.shapley_sums(filter_audit.removal_polynomial(counts)) == sums


# Token counts.


POOL = [*"aeioustrnAZ019 .,'-\n\t\"!?", "  ", "ß", "é", "İ", "ª", "²", "日", "ж", "😀", " ", "́", "<|", "n't", "'s", "'LL", "\x1c", "\x00", "½", "١", "<|endoftext|>", "<|ENDOFTEXT|>", "\xa0", "’"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    pools = (POOL, POOL[:33])
    return ["".join(rng.choices(pools[k % 2], k=rng.randrange(0, 60))) for k in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_the_library(spark, monkeypatch, name):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "SAMPLE_DOCS", 300)
    t = Tokenizer.from_file(tokenizer_file(name))
    texts = [None, "", " ".join(words(60_000, 1, 10**5)), "x" * 30_000, *odd_texts(3000, 5)]
    rows = [(k // 2 if k > 10 else None, x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("n")).withColumn("n_bytes", F.lit(1))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in rows]
    assert sorted((tuple(r) for r in token_counts.count_tokens(df, tokenizer_file(name)).collect()), key=key) == sorted(expected, key=key)
    assert token_counts.count_tokens(df.limit(0), tokenizer_file(name)).count() == 0


def test_token_counts_of_a_sentencepiece_file(spark):
    import sentencepiece

    name = tokenizer_file("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=name)
    texts = ["", None, "Hello there", "</s> x", "日本"]
    got = [r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), name).orderBy("doc_id").collect()]
    assert got == [len(p.encode(x)) if x else 0 for x in texts]


def test_first_tier_holds_the_commonest_and_any_table_gives_the_same_counts():
    import pyarrow as pa

    name = tokenizer_file("byte_bpe_50k.json")
    texts = pa.array([" ".join(words(3000, k, 500)) for k in range(5)] + odd_texts(500, 8) + ["a common-word " * 50], pa.large_string())
    tables = [token_counts.frequent_lengths(texts, name, most) for most in (1, 50, 100_000)]
    assert [t.held for t in tables[:2]] == [1, 50] and tables[2].held > 500
    plain = tokens.Encoder(name).counts(texts)
    for table in tables:
        assert (tokens.Encoder(name).counts(texts, table) == plain).all()


def test_a_worker_that_starts_anew_gives_the_same_ids(monkeypatch):
    import pyarrow as pa
    from evalspark.llm import pretokens

    name = tokenizer_file("word_bpe_49k.json")
    texts = pa.array([" ".join(words(400, k, 10**6)) for k in range(60)], pa.large_string())
    whole = tokens.Encoder(name).lists(texts)
    monkeypatch.setattr(tokens, "GENERATION", 1000)
    monkeypatch.setattr(pretokens, "CHUNK_BYTES", 5000)
    small = tokens.Encoder(name)
    again = small.lists(texts)
    assert all((a == b).all() for a, b in zip(whole, again, strict=True)) and small.table.held < 2500


# Whitening.


def plain_whitening(vectors):
    x = np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    total = sum(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in fit) / n**3
    return n, deviation, (x - sums / n) @ axes[:, :4] / np.sqrt(values[:4]), values[:4] / total


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((700, 12)) @ np.diag(np.linspace(1, 0.1, 12)) + 3).astype(np.float32)
    v[600:] = v[0]
    rows = [(i if i != 5 else None, [float(c) for c in r]) for i, r in enumerate(v)]
    bad = [(900, None), (901, [None, *rows[0][1][1:]]), (902, [float("nan"), *rows[0][1][1:]]), (903, [float("inf"), *rows[0][1][1:]]), (904, [])]
    df = spark.createDataFrame(rows + bad + [(3, rows[3][1])], "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).withColumn("n", F.lit("n"))
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    n, deviation, white, explained = plain_whitening(v.tolist())
    assert n == 600 and len(got) == 4 * 700 and len(got[3, 1]) == 2
    for k in range(4):
        mine = np.array([got[i, k + 1][0].whitened for i, _ in rows])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-9
        assert all(abs(r.explained - explained[k]) < 1e-12 and r.n == n for i, _ in rows for r in got[i, k + 1])
    assert [int(got[i, 1][0].deviation) for i, _ in rows] == deviation
    errors = {r.identity_error for x in got.values() for r in x}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_of_few_vectors_several_lengths_and_none(spark):
    kind = "vec_id long, embedding array<double>"
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, -0.5]), (2, [0.5, -0.5])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one) == [(i, k, 1, 0, None, 0.0, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.25])], kind)).collect()
    by = {(r.vec_id, r.component): r for r in line}
    assert abs(abs(by[1, 1].whitened) - 1) < 1e-12 and by[1, 2].whitened is None and abs(by[1, 1].explained - 1) < 1e-12 and by[1, 1].identity_error < 1e-12
    assert by[3, 1].n == 1 and by[3, 1].whitened is None and (3, 2) not in by
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0


def test_deviations_are_exact_beyond_64_bits():
    rng = random.Random(6)
    x = np.array([[rng.randrange(-(2**31) + 1, 2**31) for _ in range(5)] for _ in range(20)], dtype=np.int64)
    n, sums = 3 * 10**9, [rng.randrange(-(2**61), 2**61) for _ in range(5)]
    assert whitening._deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
