"""Edge cases of the training-data operators: nulls, ties, repeats, empty tables, clashing columns, very long texts; and
plain Python twins of the models and of the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import chat, embedding_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, queries, token_output, tokens, toxicity
from evalspark.llm.queries import tokenizer_file
from evalspark.llm.shared import fresh, work_dir
from tests.llm.test_operators import DOCS, components, edited, shingles, table, words

ROWS = "doc_id long, text string"


def test_fresh_names():
    assert fresh(["_KEY", "_key_", "a"], "_key", "a", "b") == ["_key__", "a_", "b"]


# Chat formatting.


def formatted(spark, rows, most=1):
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").withColumn("key", F.lit(1)).withColumn("said", F.lit(2))
    return {(r.tree, r.rank): r.formatted for r in chat.format_paths(chat.best_paths(messages, most), messages).collect()}


def test_chat_cycles_nulls_repeats_and_ties(spark):
    cycle = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "user", "below", 1.0), (1, 9, None, "user", "alone", 1.0)]
    assert formatted(spark, cycle) == {(1, 1): chat.render([("user", "alone")])}
    no_tree = [(None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "a", 1.0), (5, 1, None, "user", "z", None)]
    assert formatted(spark, no_tree) == {(None, 1): chat.render([("user", "q"), ("assistant", "a")]), (5, 1): chat.render([("user", "z")])}
    repeated = [(1, 1, None, "user", "q", 1.0)] * 2 + [(1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", "c", 1.0)]
    assert formatted(spark, repeated, 2) == {(1, 1): chat.render([("user", "q"), ("assistant", "a")]), (1, 2): chat.render([("user", "q"), ("assistant", "c")])}
    assert formatted(spark, []) == {}


def test_chat_long_thread_and_threads_of_turns(spark):
    rows = [(7, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", 1.0) for i in range(70)]
    assert formatted(spark, rows) == {(7, 1): chat.render([(r[3], r[4]) for r in rows])}
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, None, None), (None, 3, "tool", "x"), (2, None, "user", "n")], "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("t"))
    best = chat.best_paths(chat.thread_links(turns))
    got = {r.tree: chat.parse(r.formatted)[0] for r in chat.format_paths(best, chat.thread_messages(turns)).collect()}
    assert got == {1: [("user", "a"), ("user", "b"), ("", "")], None: [("tool", "x")], 2: [("user", "n")]}
    empty = turns.limit(0)
    assert chat.format_paths(chat.best_paths(chat.thread_links(empty)), chat.thread_messages(empty)).count() == 0


# Line dedup.


def test_line_dedup_of_repeated_ids_and_clashing_columns(spark):
    block = "l1\nl2\nl3"
    rows = [(1, f"u1\nu2\nu3\n{block}\nu4"), (1, f"v1\nv2\nv3\n{block}\nv4"), (2, "same\nrow\nhere"), (2, "same\nrow\nhere"), (None, block), (3, "")]
    df = spark.createDataFrame(rows, ROWS).withColumn("_covered", F.lit("c")).withColumn("_doc", F.lit("d")).withColumn("key", F.lit("k"))
    out = line_dedup.dedup_lines(df).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "_covered", "_doc", "key"} and {(r._covered, r._doc, r.key) for r in out} == {("c", "d", "k")}
    got = sorted((r.doc_id or 0, r.text) for r in out)
    # the null id comes first and keeps the block; both documents of id 1 lose it, and nothing else
    assert got == [(0, block), (1, "u1\nu2\nu3\nu4"), (1, "v1\nv2\nv3\nv4"), (2, "same\nrow\nhere"), (2, "same\nrow\nhere"), (3, "")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line {k}" for k in range(20_000)]
    rows = [(1, "\n".join(lines[:15_000])), (2, "\n".join(lines))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, ROWS), removed="gone").select("doc_id", "text").collect()}
    assert got == {1: rows[0][1], 2: "\n".join(lines[15_000:])}


# N-gram Jaccard join.


def test_ngram_join_keeps_one_row_of_repeats_and_null_ids(spark):
    text = " ".join(words(80, 1))
    near = " ".join(edited(words(80, 1), 0.03, 2))
    rows = [(4, text)] * 3 + [(4, near), (None, text), (9, None), (9, None), (8, "lone words"), (8, "other")]
    df = spark.createDataFrame(rows, ROWS).withColumn("_key", F.lit(1)).withColumn("copies", F.lit(2))
    kept = ngram_join.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in got if (r.text or "") not in (text, near)) == [(8, "lone words"), (8, "other"), (9, "")]
    assert [r.doc_id for r in got if r.text in (text, near)] == [4]
    ids = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect())
    assert ids == [(0, 76, 4)] + [(4, 76, 4)] * 4 + [(8, 1, 8)] * 2 + [(9, 0, 9)] * 2


def test_ngram_join_across_salts_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 5)
    passage = words(90, 3)
    texts = [" ".join(words(8, 50 + k, 30) + edited(passage, 0.01 * (k % 9), k) + words(4, 90 + k, 30)) for k in range(60)]
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = components(len(sets), linked)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(table(spark, texts)).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < len(texts)


def test_suffix_filter_loses_no_similar_pair():
    rng = random.Random(0)
    for _ in range(300):
        x = np.unique(np.array([rng.randrange(10**6) for _ in range(rng.randrange(1, 200))], dtype=np.uint64))
        y = np.unique(np.concatenate((x[[rng.random() > 0.15 for _ in x]], np.array([rng.randrange(10**6) for _ in range(rng.randrange(0, 20))], dtype=np.uint64))))
        common = len(np.intersect1d(x, y))
        assert ngram_join._alike(x, y) == (100 * common >= 75 * (len(x) + len(y) - common)) or not len(y)


# Token output and tokenizers.


def test_token_output_of_nulls_repeats_and_an_empty_table(spark):
    from tokenizers import Tokenizer

    name = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(name)
    rows = [(None, "first"), (5, "b b"), (5, "a"), (5, "a"), (7, None)]
    path = work_dir(spark, "test-edges")
    token_output.write_tokens(spark.createDataFrame(rows, ROWS).withColumn("part", F.lit("x")).withColumn("ids", F.lit(1)), path, name)
    got = [(r.doc_id, r.start, r.ids) for r in token_output.read_tokens(spark, path).orderBy("start").collect()]
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in ("first", "a", "a", "b b", "")]
    starts = [sum(map(len, ids[:k])) for k in range(5)]
    assert got == list(zip([None, 5, 5, 5, 7], starts, ids, strict=True))
    path = work_dir(spark, "test-edges")
    token_output.write_tokens(spark.createDataFrame([], ROWS), path, name)
    assert token_output.digests(token_output.read_tokens(spark, path)).count() == 0


def rows_read(df):
    """(rows found, rows that the scan handed on to the filter)."""
    plan = df._jdf.queryExecution().executedPlan()
    found = plan.executeCollectPublic()
    leaves = plan.collectLeaves()
    return len(found), sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_token_files_carry_indexes_and_bloom_filters_and_prune(spark, monkeypatch):
    import pyarrow.orc as orc

    name = tokenizer_file("word_bpe_49k.json")
    docs = spark.range(0, 24_000, 2).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    # small stripes, and a look at their size every thousand rows
    monkeypatch.setattr(token_output, "ORC", token_output.ORC | {"orc.stripe.size": "8192", "orc.rows.between.memory.checks": "1000"})
    path = work_dir(spark, "test-prune")
    token_output.write_tokens(docs, path, name)
    files = [orc.ORCFile(f.removeprefix("file:").replace("///", "/")) for f in spark.read.orc(path).inputFiles()]
    assert sum(f.nrows for f in files) == 12_000 and all(f.row_index_stride == 1000 for f in files)
    # a reader takes part of the stripes, another one the rest
    assert max(f.nstripes for f in files) > 1
    assert sorted(x for f in files for s in range(f.nstripes) for x in f.read_stripe(s, ["doc_id"]).column("doc_id").to_pylist()) == list(range(0, 24_000, 2))
    # an id that is there costs one row group of one file
    found, read = rows_read(token_output.find_document(spark, path, 4712))
    assert found == 1 and 1 <= read <= 1000
    # statistics admit an odd id within a file's range; only the Bloom filters can tell that it is missing
    assert [rows_read(token_output.find_document(spark, path, k)) for k in (4711, 9001, 15_003)] == [(0, 0)] * 3
    without = {k: v for k, v in token_output.ORC.items() if "bloom" not in k}
    monkeypatch.setattr(token_output, "ORC", without)
    path = work_dir(spark, "test-prune")
    token_output.write_tokens(docs, path, name)
    found, read = rows_read(token_output.find_document(spark, path, 4711))
    assert found == 0 and 1 <= read <= 1000


def test_token_output_of_a_very_long_text_and_of_one_id_alone(spark):
    from tokenizers import Tokenizer

    name = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(name)
    rows = [(3, " ".join(words(120_000, 4, 3000))), *[(5, f"the same id {k % 50}") for k in range(3000)]]
    path = work_dir(spark, "test-edges")
    token_output.write_tokens(spark.createDataFrame(rows, ROWS), path, name)
    got = [(r.start, r.ids) for r in token_output.read_tokens(spark, path).orderBy("start").collect()]
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for _, x in sorted(rows)]
    assert [x for _, x in got] == ids and [s for s, _ in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]


def test_encoder_equals_whole_encoding_of_odd_texts():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    pool = [*"aeioustrnAZ019 .,'-\n\t\"!?", "  ", "ß", "é", "ñ", "日", "ж", "😀", " ", "́", "<|", "n't", "'s", "\x1c", " ", "½", "١"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t, e = Tokenizer.from_file(tokenizer_file(name)), tokens.Encoder(tokenizer_file(name))
        assert e.words is not None
        for _ in range(1500):
            text = "".join(rng.choices(pool, k=rng.randrange(0, 40)))
            assert e.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


# Packing.


def test_packing_steps_are_balanced_and_edges_hold(spark):
    name = tokenizer_file("byte_bpe_50k.json")
    texts = [" ".join(words(rng, k)) for k, rng in enumerate([5, 80, 300, 700, 1500] * 60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, texts[3]), (3, "other"), (900, None)]
    df = spark.createDataFrame(rows, ROWS).withColumn("tier", F.lit("t")).withColumn("length", F.lit("l")).coalesce(1)
    out = packing.pack(df, name).collect()
    assert sum(r.start == 0 for r in out) == len(rows) and sum(r.doc_id is None for r in out) >= 1
    held = defaultdict(int)
    tier = {}
    for r in out:
        held[r.step_group] += r.length
        assert tier.setdefault(r.sequence_id, (r.tier, r.step_group)) == (r.tier, r.step_group)
    assert sorted(held.values())[1:] == [packing.STEP_TOKENS] * (len(held) - 1) and len(held) > 2
    assert packing.pack(df.limit(0), name).count() == 0


# Quality rules.


def test_quality_rules_of_an_empty_table_a_long_text_and_few_repeated_lines(spark):
    sentence = "the word of this text and that other one is here for all to read"
    few = "\n".join([f"{sentence} {k} {' '.join(words(20, k, 5000))}" for k in range(3)] + [f"{sentence} short end"] * 2)
    df = spark.createDataFrame([(1, " ".join(words(150_000, 1, 10**6) + ["the", "of"])), (2, few)], ROWS)
    out = {r.doc_id: r.quality for r in quality_rules.assess(df).collect()}
    assert out[1].n_words == 150_002 and out[1].kept
    assert out[2].n_dup_lines == 1 and "duplicate_lines" not in out[2].failed
    assert quality_rules.keep(df.limit(0)).count() == 0


# Embedding near-dedup.


def test_forest_with_real_splits_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((900, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((900, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.95, (900, 1))
    x = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * side)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert embedding_dedup._fit(embedding_dedup._classes(df)[1], 64, len(x)).depth >= 4
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    exact = ((u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)).sum(axis=1)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert exact.sum() >= 1700 and (found <= exact).all() and found.sum() >= 0.98 * exact.sum()


def test_embedding_near_ties_and_repeated_ids(spark):
    # just above and just below the threshold, closer to it than 2-byte components can tell
    at = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, at(0.9 + 1e-9)), (3, [-v for v in at(-0.9 + 1e-9)]), (4, [0.0, -1.0]), (4, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component_id", F.lit("x"))
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    # (1, 0) and its multiple are vectors of one direction; of the others, 2 links with both
    assert got == Counter({(1, 2, 1): 2, (2, 2, 1): 1, (3, 0, 3): 1, (4, 1, 4): 2})


# Language identification.


def language_twin(docs, train, least=language_id.LEAST_COUNT):
    """The model and its predictions in plain Python."""
    split = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if any(c.isalpha() for c in w)]
    counts = defaultdict(lambda: defaultdict(Counter))
    for text, lang in train:
        for w in split(text):
            counts[0][w][lang] += 1
            for n in (1, 2, 3, 4):
                for k in range(len(w) + 3 - n):
                    counts[n][f"<{w}>"[k : k + n]][lang] += 1
    langs = sorted({lang for per in counts.values() for c in per.values() if sum(c.values()) >= least for lang in c})
    score = {}
    for n, per in counts.items():
        kept = {g: c for g, c in per.items() if sum(c.values()) >= least}
        total = {lang: sum(c[lang] + 0.5 for c in kept.values()) for lang in langs}
        score[n] = {g: [math.log((c[lang] + 0.5) / total[lang]) for lang in langs] for g, c in kept.items()}

    def of(word):
        if word in score[0]:
            return score[0][word]
        for n in (4, 3, 2, 1):
            known = [score[n][g] for g in (f"<{word}>"[k : k + n] for k in range(len(word) + 3 - n)) if g in score[n]]
            if known:
                return [sum(c) / len(known) for c in zip(*known, strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in docs:
        found = split(text)
        if not found:
            out.append(("und", 0.0))
            continue
        mean = [sum(c) / len(found) for c in zip(*map(of, found), strict=True)]
        best = max(range(len(langs)), key=lambda k: (mean[k], -k))
        out.append((langs[best], 1 / sum(math.exp((m - mean[best]) * min(len(found), 20)) for m in mean)))
    return out


def test_language_predictions_match_a_plain_twin(spark):
    rng = random.Random(6)
    stems = {"aa": "kor mel tun sib", "bb": "xyl qua zed wop", "cc": "kor zed mel wop"}
    make = lambda lang, k: " ".join(rng.choice(stems[lang].split()) + rng.choice(["a", "en", "is", f"z{k}", "é"]) for _ in range(rng.randrange(1, 25)))
    rows = [(k, make(lang, k % 17), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(500, None, "aa"), (501, "½ ² Ⅷ 12 _", "bb"), (502, "x²", "cc"), (503, "日本", None), (7, rows[7][1], "bb"), (None, "kora", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("s"))
    got = language_id.predict(df, language_id.fit(df)).collect()
    texts = [r[1] for r in rows + odd]
    want = language_twin(texts, [(t, lang) for _, t, lang in rows + odd if lang])
    assert [r.doc_id for r in got] == [r[0] for r in rows + odd]
    for r, (lang, score) in zip(got, want, strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9
    assert language_id.fit(df.limit(0)) is None and language_id.predict(df.limit(0), None).count() == 0


# Toxicity.


def clause_twin(text, lexicon):
    """Features of a text, read clause by clause without transducers."""
    found = [(w, *lexicon.look_up(w)) for w in toxicity._TOKENS.findall(text.lower())]
    sums, quoted = [0.0] * 16, []
    inside = False
    for _, symbol, _ in found:
        inside ^= symbol == toxicity.QUOTE
        quoted.append(inside)
    begin = 0
    for end in [k for k, (_, symbol, _) in enumerate(found) if symbol == toxicity.END] + [len(found)]:
        best = [0.0] * 16
        for k in range(begin, end):
            _, symbol, weight = found[k]
            if symbol in (toxicity.INSULT, toxicity.THREAT):
                near = lambda kind, reach, ahead: any(found[j][1] == kind for j in [*range(max(begin, k - reach), k), *(range(k + 1, min(end, k + 1 + reach)) if ahead else ())])  # noqa: B023, E731
                marks = toxicity.TARGETED * near(toxicity.TARGET, toxicity.TARGET_REACH, True) + toxicity.NEGATED * near(toxicity.NEGATION, toxicity.NEGATION_REACH, False)
                said = quoted[k] or any(found[j][1] == toxicity.REPORT for j in range(begin, k))
                at = marks + toxicity.REPORTED * said + 8 * (symbol == toxicity.THREAT)
                best[at] = max(best[at], weight)
        sums = [a + b for a, b in zip(sums, best, strict=True)]
        begin = end + 1
    return [1.0, *(math.log1p(s) for s in sums)]


def test_toxicity_features_match_a_plain_twin():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({"blorg": 1.7, "fnar*": 2.2})
    pool = "the day of moron idiot kill you he they not never said wrote \" . , ! ; : blorg fnarish fnarly word other text".split() + ["\n"]
    scorer = toxicity.Scorer(lexicon)
    for _ in range(600):
        text = " ".join(rng.choices(pool, k=rng.randrange(0, 40)))
        assert np.allclose(scorer.features(text), clause_twin(text, lexicon)), text


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you moron"), (1, "you moron"), (None, "fine"), (2, "word " * 200_000 + "you moron")], ROWS).withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert got[0].score == got[1].score == got[3].score > got[2].score and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).count() == 4


# Mixing.


def test_mix_with_clashing_columns_and_wordless_sources(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 3}") for k in range(90)] + [(200, "", "empty"), (201, None, None), (None, "w w", "s0"), (5, "w w w", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("_cut", "_copy", "_base", "_source", "target", "h"):
        df = df.withColumn(c, F.lit(c))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert {(r._cut, r._copy, r._base, r._source) for r in got} == {("_cut", "_copy", "_base", "_source")}
    taken = sum(r.taken for r in mixing.report(df).collect())
    assert sum(len((r.text or "").split()) for r in got) == taken
    assert sum(r.source == "empty" for r in got) == 1 and sum(r.source is None for r in got) == 1


# The pipeline.


def pipeline_twin(path):
    """(doc_id, text, copies) after the first four stages, by the operators' SQL."""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE d0 AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    on = lambda sql, name: re.sub(r"\bdocuments\b", name, sql)
    db.execute(f"CREATE TABLE d1 AS SELECT * FROM d0 WHERE doc_id IN (SELECT doc_id FROM ({on(queries._OP6, 'd0')}) WHERE kept)")
    db.execute(f"CREATE TABLE d2 AS {on(queries._OP2, 'd1')}")
    db.execute(f"CREATE TABLE d3 AS SELECT * FROM d2 WHERE doc_id IN (SELECT doc_id FROM ({on(queries._OP3, 'd2')}) WHERE component_id = doc_id)")
    return db.execute(f"WITH {queries.mixing_sql('d3')} SELECT d3.doc_id, d3.text, taken.copies FROM d3 JOIN taken USING (doc_id)").fetchall()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda n, seed: " ".join("the of " + w if k % 9 == 0 else w for k, w in enumerate(words(n, seed, 3000)))
    shared = "\n".join(prose(12, 700 + k) for k in range(4))
    texts = [None, "", "too short", "same words here " * 40]
    for k in range(40):
        text = prose(rng.randrange(60, 200), k)
        texts += [text] + [text] * (k % 5 == 0) + [" ".join(edited(text.split(), 0.01, k))] * (k % 4 == 0)
        if k % 3 == 0:
            texts.append(f"{prose(80, 300 + k)}\n{shared}\n{prose(60, 400 + k)}")
    path = str(tmp_path_factory.mktemp("corpus"))
    table(spark, texts, lambda i: None if i % 11 == 0 else f"s{i % 3}").write.parquet(f"file://{path}/documents.parquet")
    return path


def test_pipeline_matches_a_twin(spark, corpus):
    from tokenizers import Tokenizer

    expected = pipeline_twin(corpus)
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, corpus).collect()
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)
    assert sum(r.start == 0 for r in pieces) == sum(copies for *_, copies in expected) > 40
    crc = defaultdict(int)
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(r.ids)
        crc[r.doc_id] += len(r.ids)
    for doc_id, text, copies in expected:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert crc.pop(doc_id, 0) == 4 * len(ids) * copies
        spans = sorted((s, n) for (d, s, n, _), c in got.items() if d == doc_id for _ in range(c))
        assert not copies or (spans[0][0] == 0 and max(s + n for s, n in spans) == len(ids))
    assert not crc


def test_pipeline_of_odd_rows_and_an_empty_table(spark, tmp_path):
    text = " ".join(["the of and a"] + words(90, 4))
    rows = [(1, text, "en", "s", 10)] * 3 + [(1, text + " end", "en", "s", 10), (None, text, None, None, None), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_cut", "_key", "_covered", "quality", "copies"):
        df = df.withColumn(c, F.lit(c))
    df.write.parquet(f"file://{tmp_path}/odd/documents.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in out} == {1} and sum(r.start == 0 for r in out) == 1
    df.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
