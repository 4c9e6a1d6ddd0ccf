"""Order, runs, samples and lines over ranges; exact assignment of speakers; assets; schemas."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from evalspark.functions.assignment import assignment
from evalspark.operators import diarization, ordering, schemas
from evalspark.plans import score_queries
from evalspark.session import scratch
from evalspark.sources import manifests


def test_numbers_and_scans_of_one_key_with_all_rows(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 9 else None, float(rng.randrange(300)), k, rng.choice(["x", "y", None])) for k in range(1200)]
    df = spark.createDataFrame(rows, "key string, start double, id_ long, value string").withColumn("end", F.col("start") + 1 + F.col("id_") % 3)
    got = ordering.numbered(df, ["start", "id_"], 5, parts=7).collect()
    expected = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [r.id_ for r in sorted(got, key=lambda r: r.id)] == [r[2] for r in expected] and sorted(r.id for r in got) == list(range(5, 1205))
    # a key's rows are in several ranges, so several tasks scan them
    assert ordering.ranged(df, ["key", "start"], 7).filter("key = 'hot'").select("_part").distinct().count() > 3
    runs = {(r.key, r.run): (r.value, r.length) for r in ordering.runs(df, ["key"], ["start", "id_"], "value", parts=7).collect()}
    plain = {}
    for key in ("hot", None):
        mine = [r[3] for r in expected if r[0] == key]
        for n, (v, g) in enumerate(itertools.groupby(mine), 1):
            plain[key, n] = (v, len(list(g)))
    assert runs == plain
    merged = sorted(((r.key or "", r.start, r.end, r.n) for r in ordering.gap_merge(df, ["key"], "start", "end", 0.5, parts=7).collect()))
    islands = []
    for key in ("hot", None):
        for r in sorted(((r[1], r[1] + 1 + r[2] % 3) for r in rows if r[0] == key)):
            if islands and islands[-1][0] == (key or "") and r[0] <= islands[-1][2] + 0.5:
                last = islands[-1]
                islands[-1] = (last[0], last[1], max(last[2], r[1]), last[3] + 1)
            else:
                islands.append((key or "", r[0], r[1], 1))
    assert merged == sorted(islands)
    assert ordering.runs(df.limit(0), ["key"], ["start"], "value").count() == ordering.numbered(df.limit(0), ["start"]).count() == 0


def test_exact_samples(spark, monkeypatch):
    monkeypatch.setattr(ordering, "EDGE_ROWS", 2)
    rows = [(k // 3,) for k in range(3000)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "id long")
    hashed = sorted((r.h, r.id or 0) for r in df.select(ordering.sample_hash(F.col("id"), 9).alias("h"), "id").collect())
    for n in (0, 1, 2, 500, 3002, 3003):
        got = sorted(r.id or 0 for r in ordering.exact_sample(df, "id", n, 9).collect())
        assert got == sorted(i for _, i in hashed[:n])
    assert ordering.exact_sample(df, "id", 9999, 9).count() == 3003
    with pytest.raises(ValueError):
        ordering.exact_sample(df, "id", 3004, 9, strict=True)
    plan = ordering.exact_sample(df, "id", 500, 9)._jdf.queryExecution().executedPlan().toString()
    assert "RangePartitioning" not in plan


def test_lines_of_files_that_are_split(spark, tmp_path):
    texts = {n: [f"{n} line {k} {'x' * (k % 50)}" for k in range(4000)] for n in ("a", "b")}
    for n, t in texts.items():
        (tmp_path / f"{n}.txt").write_text("\n".join(t) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = ordering.lines(spark, str(tmp_path))
        found = {n: [r.value for r in sorted((r for r in got.collect() if r.file.endswith(f"{n}.txt")), key=lambda r: r.line)] for n in "ab"}
        assert found == texts and got.agg(F.max("line")).first()[0] == 3999
        recorded = got.filter("line < 3990").withColumn("seen", F.length("value")).drop("value")
        both = ordering.attach_by_position(got, recorded, ["file"])
        assert both.filter("seen is null").count() == 20 and both.filter("seen <> length(value)").count() == 0
        with pytest.raises(ValueError):
            ordering.attach_by_position(got.filter("line < 5"), recorded, ["file"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_assignment_is_the_first_of_the_cheapest():
    rng = random.Random(1)
    for k in range(400):
        n, m = rng.randrange(1, 6), rng.randrange(5, 8)
        cost = [[rng.choice([0, 1, 2, -1.5]) if k % 2 else rng.random() for _ in range(m)] for _ in range(n)]
        first = min(itertools.permutations(range(m), n), key=lambda p: (round(sum(cost[i][j] for i, j in enumerate(p)), 9), p))  # noqa: B023
        assert assignment(cost) == list(first)
    cost = [[((7 * i + 3 * j) % 41) + (0 if j == (5 * i) % 40 else 50) for j in range(40)] for i in range(40)]
    assert assignment(cost) == [(5 * i) % 40 for i in range(40)] or sum(cost[i][j] for i, j in enumerate(assignment(cost))) <= sum(cost[i][(5 * i + i // 8) % 40] for i in range(40))
    assert assignment([]) == []


def plain_errors(reference, predicted):
    """Seconds of difference under the best of all permutations, by tenths of a second."""
    ps, rs = sorted({s["speaker"] for s in predicted}), sorted({s["speaker"] for s in reference})
    at = lambda side, t: tuple(sorted(s["speaker"] for s in side if s["start"] <= t < s["end"]))
    end = max([s["end"] for s in reference + predicted], default=0)
    ticks = [(k + 0.5) / 2 for k in range(int(2 * end))]
    both = [(at(reference, t), at(predicted, t)) for t in ticks]
    gain = {}
    for r, p in both:
        if len(r) == len(p) == 1:
            gain[p[0], r[0]] = gain.get((p[0], r[0]), 0) + 0.5
    padded = rs + [""] * max(0, len(ps) - len(rs))
    best = max(itertools.permutations(padded, len(ps)), key=lambda m: sum(gain.get(x, 0) for x in zip(ps, m, strict=True)))
    name = dict(zip(ps, best, strict=True))
    return 0.5 * sum(tuple(sorted(name.get(x, x) for x in p)) != r for r, p in both), 0.5 * sum(bool(r) for r, _ in both)


def test_speaker_errors_of_differing_sides_and_of_many_speakers(spark):
    rows = score_queries._turns(spark, "/root/testdata/sf0.001").collect()
    got = {r.conv_id: (r.error, r.reference) for r in score_queries.der_pairs(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        assert got[r.conv_id] == pytest.approx(plain_errors([s.asDict() for s in r.r], [s.asDict() for s in r.p]))
    assert sum(e for e, _ in got.values()) > 0
    # twelve speakers a side, each heard under another name but for the last two, who are swapped half of the time
    ref = [{"start": k, "end": k + 1, "speaker": f"r{k % 12:02}"} for k in range(48)]
    pred = [{"start": k, "end": k + 1, "speaker": f"p{(5 * (k % 12)) % 12:02}"} for k in range(48)]
    assert diarization.error_durations(ref, pred) == (0, 48)
    assert diarization.error_durations(ref, [{**p, "speaker": "p00"} for p in pred]) == (44, 48)
    assert diarization.error_durations(ref, [{**p, "speaker": f"q{k}"} for k, p in enumerate(pred)], diarization.greedy_mapping) == (0, 48)
    scores = score_queries.cpwer_pairs(spark, "/root/testdata/sf0.001").collect()
    for r in rows[:30]:
        u, v = [s.asDict() for s in r.ru], [s.asDict() for s in r.pu]
        refs, preds = sorted({x["speaker"] for x in u}), sorted({x["speaker"] for x in v})
        size = max(len(refs), len(preds))
        said = lambda side, who: [w for x in side if x["speaker"] == who for w in x["text"].lower().split()]
        costs = []
        for m in itertools.permutations(refs + [""] * (size - len(refs))):
            total = 0.0
            for p, q in zip(preds + [None] * (size - len(preds)), m, strict=True):
                want, heard = said(u, q) if q else [], said(v, p) if p else []
                total += float(bool(heard)) if not want else diarization.edits(want, heard) / len(want) if heard else 1.0
            costs.append(total / size)
        assert next(s.cpwer for s in scores if s.conv_id == r.conv_id) == pytest.approx(min(costs), abs=1e-6)


def test_assets_that_change_are_found(spark):
    at = scratch(spark, "test-assets")
    files = spark.createDataFrame([(f"a{k}", bytearray(b"x" * (k + 1))) for k in range(6)], "asset string, content binary")
    manifests.write_assets(files, f"{at}/files")
    rows = spark.createDataFrame([(k, f"a{k}") for k in range(6)], "id long, asset string")
    manifests.prepare(rows, f"{at}/d", "asset", f"{at}/files")
    read = lambda: manifests.read_with_assets(spark, f"{at}/d", "id long, asset string", "asset")
    assert sorted((r.id, r.size_bytes) for r in read().collect()) == [(k, k + 1) for k in range(6)]
    root = at.removeprefix("file://")
    for name, change, fault in (("a3", b"y" * 4, "changed a3"), ("a9", b"z", "extra a9")):
        before = open(f"{root}/files/{name}", "rb").read() if name != "a9" else None
        open(f"{root}/files/{name}", "wb").write(change)
        with pytest.raises(ValueError, match=fault):
            read()
        if before is not None:
            open(f"{root}/files/{name}", "wb").write(before)
    import os

    os.remove(f"{root}/files/a9")
    os.rename(f"{root}/files/a5", f"{root}/files/.a5")
    with pytest.raises(ValueError, match="missing a5"):
        read()
    with pytest.raises(ValueError, match="no complete"):
        manifests.read_with_assets(spark, f"{at}/none", "id long", "asset")
    with pytest.raises(ValueError, match="missing assets"):
        manifests.prepare(rows.withColumn("asset", F.lit("b")), f"{at}/e", "asset", f"{at}/files")


TAXONOMY = {"tasks": ["asr"], "capabilities": {"asr": ["transcription"]}, "scenarios": ["home"], "splits": ["test"], "use_buckets": ["stress_test"], "metrics": ["wer"], "conditions": {"acoustic": ["noisy"]}, "metric_aliases": {"word-error": "wer"}}


def test_records_of_many_shapes(spark, tmp_path):
    records = [
        {"id": 1, "sample_id": "s", "dataset": "d", "task": "t:asr", "capability": "transcription", "scenario": "home", "condition": {"acoustic": ["noisy"]}, "metrics": ["word-error"], "split": "TEST", "reference": {"same_speaker": True}, "WavPath": "w.wav", "use_bucket": "stress_test"},
        {"id": 2, "tags": {"task_tags": "x:asr", "capability_tags": ["c:transcription"]}, "source": {"original_id": 7, "benchmark_id": "b"}, "condition": {"odd": 1, "acoustic": "loud"}, "input": {"audios": [{"uri": "/a"}, {"uri": "${DIR}/b"}]}, "target": {"turns": [1]}},
        {"id": 3, "reference": {"json": {"a": 1}}, "metrics": "cer|wer"},
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, records)) + "\n\nno json\n")
    scan = lambda **k: schemas.unified_scan(spark, str(tmp_path / "m.jsonl"), TAXONOMY, environment={"DIR": "/home/$x"}, **k)
    one, two, three, four = scan().orderBy("line").collect()
    assert (one.sample_id, one.dataset_id, one.task, one.split, one.metrics, one.answer_type, one.reference_text, one.condition) == ("s", "d", "asr", "test", ["wer"], "classification", "True", {"acoustic": "noisy"})
    assert one.audio.endswith("/w.wav") and one.audio != "w.wav" and one.schema_errors is None and one.origin["task"] == "$.task"
    assert (two.sample_id, two.dataset_id, two.task, two.capability, two.answer_type, two.audio, two.audio_b, two.line) == ("7", "b", "asr", "transcription", "dialogue", "/a", "/home/$x/b", 1)
    assert sorted(two.schema_errors) == sorted(["missing required field: scenario", "missing required field: split", "missing required field: metrics", "unknown use_bucket: diagnostic_evidence", "unknown condition group: odd", "unknown condition acoustic: loud"])
    assert three.answer_type == "structured_json" and three.sample_id == "sample-unknown" and "unknown metric: cer" in three.schema_errors and "missing audio input" in three.schema_errors
    assert four.schema_errors == ["not JSON"] and four.line == 4
    with pytest.raises(ValueError, match="failed schema validation"):
        scan(strict=True)


def test_cells_are_clipped_at_their_real_length(spark):
    from evalspark.operators import joins

    texts = ["x" * 32_767, "y" * 32_768, "a\x00b\x1fc\n" * 100_000]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(joins.clipped_cell(F.col("t")).alias("c")).collect()]
    assert got[0] == texts[0] and got[1] == "y" * 32_753 + "...[truncated]" and len(got[2]) == 32_767
