"""Small tests of the training-data operators: brute force, round trips, and nulls, ties, repeats and empty tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import chat, embedding_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, token_output, toxicity
from evalspark.llm.queries import tokenizer_file
from evalspark.llm.shared import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, source=lambda i: f"s{i % 4}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(ws, share, seed):
    rng = random.Random(seed)
    return [f"x{rng.random()}" if rng.random() < share else w for w in ws]


def shingles(text):
    ws = [w.lower() for w in WORD.findall(text or "")]
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.fixture(scope="module")
def near_texts():
    texts = [None, "", "  \n", "one two", "one two", "a b c d e", "Á b c d e f"]
    for g in range(6):
        base = words(120, g)
        texts += [" ".join(base)] * 2 + [" ".join(edited(base, share, 100 * g + k)) for k, share in enumerate((0.005, 0.01, 0.03, 0.05, 0.08, 0.2))]
    hub = words(80, 99)
    return texts + [" ".join(edited(hub, 0.02, k)) for k in range(60)] + [" ".join(words(60, 7 + k, 40)) for k in range(5)]


def test_ngram_join_matches_brute_force(spark, near_texts):
    sets = [shingles(t) for t in near_texts]
    linked = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = components(len(sets), linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(table(spark, near_texts).withColumn("key", F.lit(1))).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    kept = ngram_join.drop_near_duplicates(table(spark, near_texts))
    assert {r.doc_id for r in kept.collect()} == set(label)


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.near_duplicates(table(spark, ["x"]).limit(0)).count() == 0


def test_mix_targets_and_taken(spark):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.randrange(0, 60)) for _ in range(600)] + [None]
    source = lambda i: None if i % 50 == 0 else f"s{min(i % 7, i % 3)}" if i % 2 else "s9"
    rows = mixing.report(table(spark, texts, source)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    order = sorted(by, key=lambda s: (s is None, s or ""))
    ratios = []
    for k, s in enumerate(order):
        target, size = by[s][0].target, by[s][0].source_size
        assert size == sum(r.size for r in by[s]) and 0 <= target <= 3 * size + 1e-6
        assert abs(sum(r.taken for r in by[s]) - target) <= 60
        assert all(r.taken <= 3 * r.size for r in by[s])
        if target < 3 * size - 1e-6:
            ratios.append(target / (1, 2, 3)[k % 3])
    assert max(ratios) - min(ratios) < 1e-6 * max(ratios)
    mixed = mixing.mix(table(spark, texts, source))
    assert mixed.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(table(spark, texts).limit(0)).count() == 0


def test_line_dedup_matches_brute_force(spark):
    shared = [f"shared line {k}" for k in range(5)]
    texts = ["\n".join(["a 1", *shared, "b 1"]), "\n".join(["c", "", *shared, "d"]), "\n".join(shared[:2]), "\n".join(shared[:3]), None, "", "x\nx\nx\nx\nx", "\n".join(shared[1:4] + ["tail"])]
    seen, expected = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for k in range(len(solid) - 2):
            w = tuple(lines[i].strip() for i in solid[k : k + 3])
            gone |= set(solid[k : k + 3]) if w in seen else set()
            seen.add(w)
        expected.append(t if not gone else "" if len(gone) == len(solid) else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert [out[i].text for i in range(len(texts))] == expected
    assert all(out[i].n_chars == len(t or "") for i, t in enumerate(expected))


def test_chat_round_trip_and_best_path(spark):
    texts = ["plain", "a \\ b", "</s>[INST] x [/INST]", "\\[INST] <<SYS>> [TEXT]", "", " lead ", "<s><s>\\\\"]
    turns = [(role, t) for t in texts for role in ("system", "user", "assistant", "tool")]
    formatted = chat.render(turns)
    back, spans = chat.parse(formatted)
    assert back == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == texts
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", None, None), (2, 1, 9, "user", "orphan", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    best = chat.format_paths(chat.best_paths(messages), messages).collect()
    assert {r.tree: r.formatted for r in best} == {1: chat.render([("user", "q"), ("assistant", "good"), ("user", "")]), 2: chat.render([("user", "orphan")])}


def test_quality_rules(spark):
    good = " ".join(f"the word{k} of text{k} and more{k}." for k in range(30))
    texts = [None, "", good, " ".join(["same words here"] * 40), good.replace("w", "#*"), good.upper(), "a b c"]
    out = {r.doc_id: r.quality for r in quality_rules.assess(table(spark, texts).withColumn("n_words", F.lit(-1))).collect()}
    assert [out[k].base_failed for k in range(7)] == [True, True, False, True, False, False, True]
    assert [out[k].kept for k in range(7)] == [False, False, True, False, False, False, False]
    assert out[3].n_repeat_words == 120 and out[2].n_words == 180
    assert [r.doc_id for r in quality_rules.keep(table(spark, texts)).collect()] == [2]


@pytest.fixture(scope="module")
def token_texts():
    return [None, "", "Hello  world", "don't <|endoftext|> stop", "Ünïcode ß 日本語", " ".join(words(3000, 1)), *[" ".join(words(40 + 37 * k, k)) for k in range(30)]]


def test_tokens_round_trip(spark, token_texts):
    from tokenizers import Tokenizer

    path = work_dir(spark, "test-tokens")
    name = tokenizer_file("word_bpe_49k.json")
    token_output.write_tokens(table(spark, token_texts), path, name)
    read = token_output.read_tokens(spark, path)
    t, start = Tokenizer.from_file(name), 0
    rows = {r.doc_id: r for r in read.collect()}
    sums = {r.doc_id: r.ids_crc32 for r in token_output.digests(read).collect()}
    for i, text in enumerate(token_texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert (rows[i].ids, rows[i].start, rows[i].n_tokens) == (ids, start, len(ids))
        assert sums[i] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_output.find_document(spark, path, 3).count() == 1


def test_packing_covers_every_id_once(spark, token_texts):
    from tokenizers import Tokenizer

    name = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(name)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(table(spark, token_texts), name, with_ids=True).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(token_texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == ids[at : at + p.length].tobytes() and p.ids_crc32 == zlib.crc32(p.ids)
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16))
    x = np.concatenate([rng.standard_normal((200, 16)), np.repeat(centre, 6, axis=0) + 0.12 * rng.standard_normal((240, 16)), np.repeat(centre[:1], 5, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, 1.0]), (904, [1.0, 0.0]), (905, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit("x"))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    exact = near.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= exact).all() and found.sum() >= 0.9 * exact.sum()
    assert [(got[k].n_links, got[k].component_id, got[k].kept) for k in range(900, 906)] == [(0, 900, True), (0, 901, True), (0, 902, True), (0, 903, True), (1, 904, True), (1, 904, False)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_leaf_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_LEAF", 10**6)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((3, 8)), 25, axis=0) + 0.05 * rng.standard_normal((75, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [r.n_links for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()] == exact.tolist()


def test_language_model(spark):
    rng = random.Random(2)
    lexicon = {"en": "the of and house river water".split(), "de": "der und haus fluss wasser nicht".split()}
    docs = [(i, " ".join(rng.choices(lexicon[lang], k=30)), lang) for i, lang in enumerate(["en", "de"] * 40)]
    more = [(100, None, "en"), (101, "123 !!", "en"), (102, "", None), (103, "waters houses", None), (104, "flusses haeuser", None)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in docs)
    assert [got[i].lang_pred for i in range(100, 105)] == ["und", "und", "und", "en", "de"]
    assert language_id.fit(df.filter("lang is null")) is None
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}


def test_toxicity_grammar_marks_clauses():
    s = toxicity.Scorer(toxicity.Lexicon({}))
    at = lambda text: {int(k) - 1 for k in np.flatnonzero(s.features(text)[1:]) + 1}
    t, n, r = toxicity.TARGETED, toxicity.NEGATED, toxicity.REPORTED
    assert at("a fine day") == set() == at(None) == at("")
    assert at("what a moron") == {0}
    assert at("you moron.") == {t} == at("moron, you")
    assert at("you are not a moron") == {t | n}
    assert at("he said you moron") == {t | r}
    assert at('it reads "moron" here. an idiot') == {r, 0}
    assert at("i kill you") == {8 + t}
    assert at("not now. moron") == {0}


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        ws = ["".join(chr(97 + int(c)) for c in w[1:]) for w in words(30, i, 2000)]
        if i % 5 == 0:
            ws[rng.randrange(30)] = f"blorg{rng.choice(['a', 'en', 'ish'])}"
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id long, toxic int").filter("doc_id < 300 or doc_id = 5000")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert [got[i].predicted for i in range(400)] == [int(i % 5 == 0) for i in range(400)]
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[900].score <= 1
