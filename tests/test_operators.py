"""The library's operators against plain Python and hand-computed values."""

import json
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evalspark.functions import evaluation as E
from evalspark.functions import instructions as I
from evalspark.functions import process as P
from evalspark.functions import structured as S
from evalspark.functions import text as T
from evalspark.functions import text_udf as U
from evalspark.operators import samples
from evalspark.operators import cube, intervals, joins, metrics
from evalspark.operators import diarization as D
from evalspark.operators import error_rates as R
from evalspark.operators import labelling as L
from evalspark.operators import overlap as O
from evalspark.plans import queries as plans
from evalspark.session import scratch, table
from evalspark.sources import events as log
from evalspark.sources import manifests

SMALL = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_match_a_plain_table():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdé") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert U.edits(a, b) == levenshtein(a, b)
    wide = [str(k) for k in range(70_000)]
    assert U.edits(wide, wide[1:] + ["x"]) == 2


def test_wer_of_whole_conversations_matches_brute_force(spark):
    said = defaultdict(lambda: ([], []))
    for r in table(spark, SMALL, "conversations").orderBy("conv_id", "turn").collect():
        if r.role in ("user", "assistant"):
            said[r.conv_id][r.role == "assistant"].extend((r.text or "").split())
    got = plans.queries()["wer_whole"](spark, SMALL).first()
    assert got.errors == sum(levenshtein(u, a) for u, a in said.values()) and got.reference_words == sum(len(u) for u, _ in said.values())


def test_first_options_match_the_rules_on_plain_cases(spark):
    cases = {"The answer is (B).": "B", "答案：C": "C", "I choose D, not A": "A", "boxed{C}": "C", "so it is b": "B", "故选 C": "C", "只有D是对": "D", "zzz": "none"}
    got = {t: value(spark, P.first_option(F.lit(t), default="none")) for t in cases}
    assert {t: g for t, g in got.items() if t != "I choose D, not A"} == {t: o for t, o in cases.items() if t != "I choose D, not A"}
    assert got["I choose D, not A"] in "AD"


def bleu_twin(pairs):
    match, total, h_len, r_len = [0] * 4, [0] * 4, 0, 0
    for h, r in pairs:
        h_len, r_len = h_len + len(h), r_len + len(r)
        for n in range(1, 5):
            hg, rg = (Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1)) for x in (h, r))
            match[n - 1] += sum((hg & rg).values())
            total[n - 1] += sum(hg.values())
    if not any(match):
        return 0.0
    smooth, logs = 1.0, []
    for m, t in zip(match, total, strict=True):
        if not t:
            logs.append(-9999999999.0)
            continue
        if not m:
            smooth *= 2
        logs.append(math.log(100 * m / t if m else 100 / (smooth * t)))
    return (math.exp(1 - r_len / h_len) if h_len < r_len else 1.0) * math.exp(sum(logs) / 4)


def test_bleu_with_misses_and_short_texts_matches_a_twin(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))], [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]) for _ in range(40)]
    df = spark.createDataFrame([(k, h, r) for k, (h, r) in enumerate(pairs)], "k int, h array<string>, r array<string>").select("k", U.word_gram_counts("h", "r").alias("c"))
    one = {r.k: r.b for r in df.select("k", "c.*").select("k", O.bleu().alias("b")).collect()}
    assert all(one[k] == pytest.approx(bleu_twin([p]), abs=1e-6) for k, p in enumerate(pairs))
    assert df.agg(*O.summed("c")).select(O.bleu().alias("b")).first().b == pytest.approx(bleu_twin(pairs), abs=1e-6)


def test_cider_matches_a_twin(spark):
    rng = random.Random(4)
    ids = range(8)
    hyp = {i: [rng.choice("abcdef") for _ in range(rng.randrange(2, 9))] for i in ids}
    refs = {i: [[rng.choice("abcdef") for _ in range(rng.randrange(2, 9))] for _ in range(1 + i % 3)] for i in ids}
    grams = lambda t: Counter(tuple(t[k : k + n]) for n in range(1, 5) for k in range(len(t) - n + 1))
    df = Counter(g for i in ids for g in set().union(*(grams(r) for r in refs[i])))

    def vector(t):
        return {g: c * (math.log(len(ids)) - math.log(max(1, df[g]))) for g, c in grams(t).items()}, sum(c for g, c in grams(t).items() if len(g) == 2)

    def similar(h, r):
        (hv, hl), (rv, rl) = vector(h), vector(r)
        out = 0.0
        for n in range(1, 5):
            norm = [math.sqrt(sum(w * w for g, w in v.items() if len(g) == n)) for v in (hv, rv)]
            dot = sum(min(w, rv[g]) * rv[g] for g, w in hv.items() if len(g) == n and g in rv)
            out += (dot / (norm[0] * norm[1]) if norm[0] and norm[1] else dot) * math.exp(-((hl - rl) ** 2) / 72)
        return out / 4

    h = spark.createDataFrame([(i, t) for i, t in hyp.items()], "id int, tokens array<string>")
    r = spark.createDataFrame([(i, t) for i, ts in refs.items() for t in ts], "id int, tokens array<string>")
    got = {x.id: x.cider for x in O.cider(h, r).collect()}
    assert all(got[i] == pytest.approx(10 * sum(similar(hyp[i], t) for t in refs[i]) / len(refs[i]), abs=1e-9) for i in ids)


def test_normalisers_and_skips(spark):
    cases = {"Mr. Smith won't pay $1,000!": "mister smith will not pay $1000 ", "[laughs] um it's 5% (sure)": " it is 5% ", "Café naïve": "cafe naive", "I'd been there.": "i had been there "}
    assert {t: value(spark, R.normalize_english(F.lit(t))).split() for t in cases} == {t: o.split() for t, o in cases.items()}
    assert value(spark, R.translation_tokens(F.lit('He said: "1,5-2.0 a.b" ok.'))) == ["He", "said", ":", '"', "1,5", "-", "2.0", "a", ".", "b", '"', "ok", "."]
    assert value(spark, R.translation_tokens(F.lit("中文 ok"), chinese=True)) == ["中", "文", "ok"]
    assert value(spark, R.skip_reason(F.lit("嗯啊。"), "zh")) == "filler_only" and value(spark, R.skip_reason(F.lit("x x"), "zh")) == "placeholder_ref"
    assert value(spark, R.bare_tokens(F.lit("你好，世界"), "zh")) == list("你好世界")
    assert value(spark, E.canonical(F.lit("  Ａ  b "))) == "a b" and value(spark, E.canonical(F.lit(2.0))) == "2"


def test_structured_items_and_calls():
    assert S.items({"a": {"b": [1, {"c": None}]}, "d": True}) == ["a.b[0]=1", "a.b[1].c=", "d=true"]
    assert S.items("X") == ["$=x"] and S.parsed("so [1, 2] it is") == [1, 2] and S.parsed("") is None
    two = '<tool_call>{"name": "a", "x": 1}</tool_call><tool_call>{"name": "b"}</tool_call>'
    assert S.calls(two) == (["a", "b"], ["[0].x=1"]) and S.calls("none") is None


def test_loose_and_strict_reading(spark):
    t = F.lit("*Well,*\nno marks here")
    assert value(spark, I.strictly(t, I.no_comma)) is False and value(spark, I.loosely(t, I.no_comma)) is True
    assert value(spark, I.strictly(F.lit(" "), I.no_comma)) is False
    assert value(spark, I.keyword_frequency(F.lit("a A a"), "a", 3, less=True)) is False


def test_percentiles_and_ranks_over_many_parts(spark):
    rng = random.Random(7)
    rows = [("a" if k % 3 else None, rng.choice([None, round(rng.random(), 2), rng.random()]), k % 2) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, y int")
    got = {r.k: (r.v_p50, r.v_p90) for r in metrics.exact_percentiles(df, ["k"], "v", (0.5, 0.9)).collect()}
    for key in ("a", None):
        s = sorted(v for k, v, _ in rows if k == key and v is not None)
        at = [q * (len(s) - 1) for q in (0.5, 0.9)]
        assert got[key] == pytest.approx(tuple(s[int(p)] + (p - int(p)) * (s[min(int(p) + 1, len(s) - 1)] - s[int(p)]) for p in at))
    known = [(v, y) for _, v, y in rows if v is not None]
    wins = sum((p > n) + 0.5 * (p == n) for p, y in known if y for n, z in known if not z)
    pos = sum(y for _, y in known)
    assert metrics.auc(df, "v", "y").first().auc == pytest.approx(wins / (pos * (len(known) - pos)))


def test_cube_over_all_default_sets_matches_a_twin(spark):
    rng = random.Random(8)
    fields = sorted({k for s in cube.default_sets() for k in s})
    rows = []
    for k in range(60):
        row = {f: rng.choice([None, "", "u", "v"]) for f in fields} | {"acc": rng.choice([None, 0.0, 1.0]), "der": 0.5, "der_error_duration": float(k % 4), "der_reference_duration": 5.0}
        rows.append(row | {"use_bucket": rng.choice(["formal_subscores", "stress_test"])})
    schema = ", ".join(f"`{f}` {'double' if f in ('acc', 'der', 'der_error_duration', 'der_reference_duration') else 'string'}" for f in rows[0])
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    want = {}

    def put(slice_, label, some):
        want[slice_, label, "sample_count"] = len(some)
        known = [r["acc"] for r in some if r["acc"] is not None]
        if known:
            want[slice_, label, "acc"], want[slice_, label, "acc/sample_count"] = sum(known) / len(known), len(known)
        want[slice_, label, "der"] = sum(r["der_error_duration"] for r in some) / (5.0 * len(some))
        want[slice_, label, "der/reference_duration_seconds"], want[slice_, label, "der/sample_count"] = 5.0 * len(some), len(some)
        if len(some) < 5:
            want[slice_, label, "small_sample"] = 1

    put("overall", "", rows)
    put("formal/overall", "", [r for r in rows if r["use_bucket"] == "formal_subscores"])
    for s in cube.default_sets():
        groups = defaultdict(list)
        for r in rows:
            if all(r[k] not in (None, "") for k in s):
                groups["|".join(r[k] for k in s)].append(r)
        for label, some in groups.items():
            put("+".join(s), label, some)
    got = {(r.slice, r.label, r.metric): r.value for r in cube.mesh(df, names=["acc"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert cube.detect_metrics(df) == ["acc", "der"]


def test_report_tree_and_its_checks(spark):
    rows = spark.createDataFrame([("c1", "s", 1.0, 0), ("c1", "s", 0.0, 0), ("c2", "t", 1.0, 1)], "capability string, scenario__primary string, acc double, failure int")
    tree = cube.report_json(cube.nested_report(cube.mesh(rows, names=["acc"])))
    assert tree["overall"]["acc"] == pytest.approx(2 / 3) and tree["by_scenario"]["s"]["by_capability"]["c1"]["acc__sample_count"] == 2 and tree["by_capability"]["c2"]["failure_rate"] == 1
    assert cube.summary_errors(tree, 3, ("acc", "wer%")) == ["missing wer%", f"failure_rate is {1 / 3}"]


def test_lookups_tell_misses_and_ambiguity(spark):
    catalog = spark.createDataFrame([("r1", "a", "x"), ("r2", "b", "y"), ("r3", "b", "z")], "record_id string, k string, v string")
    samples = spark.createDataFrame([(1, "r2", "a"), (2, None, "a"), (3, None, "b"), (4, None, "c"), (5, "zz", "a"), (6, "", None)], "i int, record_id string, k string")
    got = {r.i: (r.v, r.found) for r in joins.lookup(samples, catalog, "record_id", ["k"], ["v"]).collect()}
    assert got == {1: ("y", "id"), 2: ("x", "keys"), 3: (None, "ambiguous"), 4: (None, "missing"), 5: (None, "missing"), 6: (None, "incomplete")}


def test_diarization_error_by_hand_and_mapping():
    seg = lambda *s: [{"start": a, "end": b, "speaker": w} for a, b, w in s]
    assert D.error_durations(seg((0, 2, "a"), (2, 4, "b")), seg((0, 2, "x"), (2, 4, "y"))) == (0, 4)
    assert D.error_durations(seg((0, 2, "a"), (2, 4, "b")), seg((0, 3, "x"), (3, 4, "y"))) == (1, 4)
    assert D.error_durations(seg((0, 2, "a")), []) == (2, 2)
    rng = random.Random(2)
    for _ in range(50):
        p, r = [f"p{k}" for k in range(rng.randrange(1, 5))], [f"r{k}" for k in range(rng.randrange(1, 5))]
        gain = {(x, y): rng.random() for x in p for y in r}
        m = D.best_mapping(p, r, gain)
        padded = r + [""] * max(0, len(p) - len(r))
        assert sum(gain.get(x, 0) for x in m.items()) == pytest.approx(max(sum(gain.get(x, 0) for x in zip(p, q, strict=True)) for q in permutations(padded, len(p))))


def test_attribution_by_hand():
    u = lambda *rows: [{"id": i, "speaker": s, "text": t} for i, s, t in rows]
    ref = u(("0", "a", "one two"), ("1", "b", "three four"))
    assert D.attribution(ref, u(("0", "x", "one two"), ("1", "y", "three five"))) == (0.25, 1.0)
    assert D.attribution(ref, u(("0", "x", "one two"), ("1", "x", "three four")))[1] == 0.5
    assert D.attribution(ref, []) == (1.0, 0.0)


def test_segments_of_answers(spark):
    text = '```json\n{"segments": [{"start_time": 0, "end_time": 2, "speaker_id": "A "}, {"start": 2.0005, "end": 9, "speaker": "a"}, {"start": 5, "end": 5, "speaker": "b"}]}\n```'
    df = spark.createDataFrame([(text,)], "t string").select(D.merged(D.segments(F.col("t"), F.lit(8.0))).alias("s"))
    assert [tuple(s) for s in df.first().s] == [(0.0, 8.0, "a")]
    u = spark.createDataFrame([('[{"speaker_1","text":"hi there"},{"speaker":"B","transcript":"yo"}',)], "t string").select(D.utterances(F.col("t")).alias("u")).first().u
    assert [tuple(x) for x in u] == [("0", "speaker_1", "hi there"), ("1", "b", "yo")]


def test_runs_in_one_row_each(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", None), (1, 2, "v", "c"), (1, 3, "u", "d")], "k int, i int, r string, t string")
    got = [(x.run, x.r, x.n, x.t) for x in intervals.grouped_runs(df, ["k"], ["i"], "r", "t").orderBy("run").collect()]
    assert got == [(1, "u", 2, "a\n"), (2, "v", 1, "c"), (3, "u", 1, "d")]


def test_manifests_check_their_content(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    found = manifests.write_prepared(rows, f"file://{tmp_path}/p") or manifests.content_digest(rows)
    assert manifests.read_prepared(spark, f"file://{tmp_path}/p", "i int, t string", found).count() == 2
    with pytest.raises(ValueError):
        manifests.read_prepared(spark, f"file://{tmp_path}/p", "i int, t string", found | {"rows": 3})
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.jsonl").write_text(json.dumps({"a": 1}) + "\n")
    (tmp_path / "d" / "y.txt").write_text("no\n")
    assert manifests.result_files(spark, f"file://{tmp_path}/d").count() == 1
    with pytest.raises(ValueError):
        manifests.read_jsonl(spark, f"file://{tmp_path}/d/e", "a int, b int", {"a": "b"})
    grid = 'xmin = 0 \nxmax = 1.5 \ntext = "hello" \nxmin = 1.5 \nxmax = 2 \ntext = " "'
    assert [tuple(s) for s in value(spark, manifests.textgrid(F.lit(grid)))] == [(0.0, 1.5, "hello")]


def test_slices_and_numbers_reject_negative_bounds(spark):
    with pytest.raises(ValueError):
        log.row_slice(spark.range(3), ["id"], -1)
    assert log.numbered(spark.createDataFrame([(float(k % 5), k) for k in range(40)], "v double, w int"), ["v", "w"]).agg(F.count_distinct("id"), F.max("id")).first() == (40, 39)


def test_labelling_edges(spark):
    assert L.audit_sample(spark.range(9), "id", 0).count() == 0 and L.audit_sample(spark.range(9), "id", 0.05).count() == 1 and L.audit_sample(spark.range(9), "id", 2).count() == 9
    df = spark.createDataFrame([(1,), (None,)], "n int")
    assert [r.v for r in df.select(L.condition("n >= 1").alias("v")).collect()] == [True, False]
    assert value(spark, samples.majority(F.array(F.lit("Yes"), F.lit("no")))) == "no"


def test_text_edges(spark):
    assert value(spark, T.caption(F.lit("One two. Three."))) == "One two."
    assert scratch(spark, "x") != scratch(spark, "x")
