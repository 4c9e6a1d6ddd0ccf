"""Operator 5, toxicity by a weighted finite-state pattern grammar.

Words and marks of a text become symbols: insult, threat, target, negation, report, quote, clause end, other. Four
transducers read them and are composed into one: the insult and threat transducer passes words through by class, the
target transducer marks hits near an addressed person or group, the negation transducer marks hits shortly after a
negation, the reported-speech transducer marks hits inside quotes or after a verb of saying. The composition reads a
clause at a time, and a target that follows its hit is marked by the same transducer run from the clause's end, so
what is scored is a clause's pattern (say, an insult with a target, not negated), never a word alone. Each pattern has a weight and each hit the weight of its word; a text's score is the logistic function of the
weighted sum over its clauses, so length without hits changes nothing.

Words of insult are seeds (fixed values below) and whatever words and stems the labels show: forms that occur in toxic
documents far more often than in others, in several different contexts, so that copies of one text teach nothing.
Pattern weights are fitted around priors. Both use bounded samples of labelled rows (TRAIN_TOXIC, TRAIN_CLEAN whole
texts, by hash); the grammar is small and broadcast, and texts are scored where they are, without a shuffle.

Defined cases: a null, empty or wordless text gets the score of no hits; without labels the seeds and priors stand;
rows that repeat an id are scored each, and repeated labels of an id count once (toxic if any says so); a label whose
document is missing is not used; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import discard, materialise

#: Bounds of the training samples, in documents.
TRAIN_TOXIC, TRAIN_CLEAN = 3_000, 6_000
#: Documents and contexts that a form must occur in.
LEAST_CONTEXTS = 5
LEAST_LOG_ODDS = 3.0
#: Evidence that a form is no chance find among millions: documents times divergence from the share of toxic ones.
LEAST_EVIDENCE = 16.0
#: A stem that clean documents hold as well needs these odds; else its longer forms stand for it.
STEM_LOG_ODDS = 5.5
STEM_LENGTHS = (4, 5, 6, 7)

# Seed words of the symbol classes in English, German, French and Spanish.
INSULTS = "idiot moron loser scum trash stupid pathetic worthless imbecile bastard vermin arschloch dummkopf abschaum salaud connard ordure escoria imbécil".split()
THREATS = "kill murder hurt destroy shoot stab strangle burn umbringen töten erschießen tuer frapper matar golpear".split()
TARGETS = "you your yours he she him her they them their these those du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos ellas".split()
NEGATIONS = "not no never nobody neither nor don't isn't aren't won't nicht kein keine keiner nie niemals ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says say told tells called wrote claimed reported sagte sagt schrieb nannte behauptete dit disait écrit dijo dice escribió llamó".split()
CLAUSE_ENDS = ".!?;:\n"
QUOTES = "\"“”„«»"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
_TOKENS = re.compile(rf"[^\W\d_]+(?:['’][^\W\d_]+)*|[{re.escape(CLAUSE_ENDS + QUOTES)}]")
#: A hit's symbol has a base and three marks: 1 targeted, 2 negated, 4 reported.
TARGETED, NEGATED, REPORTED = 1, 2, 4
#: Prior weights of the patterns: base (insult, threat) by marks.
PRIOR_INSULT = (3.0, 4.0, 1.0, 1.5, 1.0, 1.5, 0.5, 0.5)
PRIOR_THREAT = (0.5, 2.0, 0.0, 0.5, 0.3, 0.7, 0.0, 0.2)
PRIOR = np.array([-3.0, *PRIOR_INSULT, *PRIOR_THREAT])
#: How far hits reach: words after a negation, and before or after a target.
NEGATION_REACH, TARGET_REACH = 3, 6


class Transducer:
    """A deterministic transducer: step(state, symbol) gives the next state and the symbol written."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds what `first` writes to `second`."""

    def step(state, symbol):
        a, written = first.step(state[0], symbol)
        b, out = second.step(state[1], written)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def compile_table(t: Transducer, symbols: list) -> tuple[dict, object]:
    """Every reachable (state, symbol) with its next state and output, and the start: composition done once."""
    table, todo, seen = {}, [t.start], {t.start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            after, out = table[state, symbol] = t.step(state, symbol)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return table, t.start


def _hits(state, symbol):
    """Insults and threats become hits (class, marks); other symbols pass."""
    return state, ((symbol, 0) if symbol in (INSULT, THREAT) else symbol)


def _marker(trigger: int, reach: int, mark: int) -> Transducer:
    """Marks hits up to `reach` symbols after the trigger, within the clause."""

    def step(left, symbol):
        if symbol == trigger:
            return reach, symbol
        if symbol == END:
            return 0, symbol
        if isinstance(symbol, tuple) and left:
            symbol = (symbol[0], symbol[1] | mark)
        return max(0, left - 1), symbol

    return Transducer(0, step)


def _reported(state, symbol):
    """Marks hits inside quotes (which reach over clause ends) and, in a clause, after a verb of saying."""
    quoted, said = state
    if symbol == QUOTE:
        return (not quoted, said), symbol
    if symbol == REPORT:
        return (quoted, True), symbol
    if symbol == END:
        return (quoted, False), symbol
    if isinstance(symbol, tuple) and (quoted or said):
        symbol = (symbol[0], symbol[1] | REPORTED)
    return state, symbol


def grammar() -> tuple[dict, object]:
    """The composed grammar as one table."""
    t = Transducer(None, _hits)
    for part in (_marker(TARGET, TARGET_REACH, TARGETED), _marker(NEGATION, NEGATION_REACH, NEGATED), Transducer((False, False), _reported)):
        t = compose(t, part)
    return compile_table(t, list(range(8)))


class Lexicon:
    """Symbols and weights of words; learned forms are words, or stems ending in `*`."""

    def __init__(self, learned: dict[str, float]):
        self.words: dict[str, tuple[int, float]] = {}
        for symbol, names in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
            self.words |= {w: (symbol, 1.0) for w in names}
        self.words |= {c: (END, 0.0) for c in CLAUSE_ENDS} | {c: (QUOTE, 0.0) for c in QUOTES}
        # a seed weighs like a typical learned form
        usual = float(np.median([*learned.values()])) if learned else 1.0
        self.words |= {w: (INSULT, usual) for w in INSULTS}
        self.words |= {w: (INSULT, v) for w, v in learned.items() if not w.endswith("*")}
        self.stems = {w[:-1]: v for w, v in learned.items() if w.endswith("*")}

    def look_up(self, word: str) -> tuple[int, float]:
        stem = max((self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS), default=0.0)
        symbol, weight = self.words.get(word, (INSULT if stem else OTHER, 0.0))
        return (symbol, max(weight, stem)) if symbol == INSULT else (symbol, weight)


class Scorer:
    """Features of texts by the grammar, with a cache of words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.cache = lexicon, {}
        self.table, self.start = grammar()
        self.back, self.back_start = compile_table(compose(Transducer(None, _hits), _marker(TARGET, TARGET_REACH, TARGETED)), list(range(8)))

    def features(self, text: str | None) -> np.ndarray:
        """1 and, for each pattern, the log of one plus the summed weights of the clauses' best hits."""
        out = np.zeros(len(PRIOR))
        out[0] = 1.0
        tokens = _TOKENS.findall((text or "").lower())
        cache = self.cache
        found = list(map(cache.get, tokens))
        if None in found:
            if len(cache) > 400_000:
                cache.clear()
            for w in set(tokens):
                if w not in cache:
                    cache[w] = self.lexicon.look_up(w)
            found = list(map(cache.get, tokens))
        places = [k for k, (symbol, _) in enumerate(found) if symbol in (INSULT, THREAT)]
        if not places:
            return out
        # a target after the hit counts as one before it
        ahead = self._targets_ahead(found)
        state, best = self.start, {}
        for k, (symbol, weight) in enumerate(found):
            state, written = self.table[state, symbol]
            if isinstance(written, tuple):
                base, marks = written
                if k in ahead:
                    marks |= TARGETED
                at = 1 + marks + 8 * (base == THREAT)
                best[at] = max(best.get(at, 0.0), weight)
            elif symbol == END and best:
                for at, w in best.items():
                    out[at] += w
                best = {}
        for at, w in best.items():
            out[at] += w
        out[1:] = np.log1p(out[1:])
        return out

    def _targets_ahead(self, found: list) -> set[int]:
        """Hits that a target follows within reach in their clause: the target transducer, from the end."""
        out, state = set(), self.back_start
        for k in range(len(found) - 1, -1, -1):
            state, written = self.back[state, found[k][0]]
            if isinstance(written, tuple) and written[1] & TARGETED:
                out.add(k)
        return out


def _forms(tokens: list[str]) -> Iterator[tuple[str, str]]:
    """(form, context) of the words of a text: the word and its stems, with the words beside it."""
    for k, w in enumerate(tokens):
        if w[0].isalpha() and len(w) > 2:
            beside = f"{tokens[k - 1] if k else ''} {tokens[k + 1] if k + 1 < len(tokens) else ''}"
            yield w, beside
            for n in STEM_LENGTHS:
                if len(w) >= n:
                    yield f"{w[:n]}*", beside


def _sampled(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(text, toxic) of bounded samples of both labels, equal texts once."""
    labels = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in labels.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda most, k: min(1.0, most / max(n.get(k, 0), 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.filter(draw < F.when(F.col("toxic") > 0, share(TRAIN_TOXIC, True)).otherwise(share(TRAIN_CLEAN, False)))
    # ids of a bounded sample: some thousands
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.select("text", (F.col("toxic") > 0).alias("toxic")).dropDuplicates(["text"])


def _learned(sample: DataFrame) -> dict[str, float]:
    """Forms of insult and their weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update({form for form, _ in _forms(_TOKENS.findall(text.lower()))})
        rows = [(f, n, seen[False].get(f, 0)) for f, n in seen[True].items()]
        rows += [(f, 0, n) for f, n in seen[False].items() if f not in seen[True]]
        for k in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 50_000], strict=True)], names=["form", "bad", "good"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return {}
    counts = sample.mapInArrow(count, "form string, bad long, good long").groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / n[True]) - F.log((F.col("good") + 0.5) / n[False])
    likely = counts.withColumn("odds", odds).filter((F.col("bad") >= LEAST_CONTEXTS) & (F.col("odds") >= LEAST_LOG_ODDS))
    share = n[True] / (n[True] + n[False])
    forms = {r["form"]: (r["odds"], r["bad"], r["good"]) for r in likely.collect()}
    known = sample.sparkSession.sparkContext.broadcast(set(forms))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(f, c) for text in batch.column("text").to_pylist() for f, c in _forms(_TOKENS.findall(text.lower())) if f in known.value}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["form", "context"])

    around = sample.filter("toxic").select("text").mapInArrow(contexts, "form string, context string")
    enough = around.groupBy("form").agg(F.countDistinct("context").alias("n")).filter(F.col("n") >= LEAST_CONTEXTS).collect()
    n_contexts = {r["form"]: r["n"] for r in enough}
    out: dict[str, float] = {}
    for form in sorted(n_contexts, key=lambda f: (not f.endswith("*"), len(f), f)):
        # what copies repeat has few contexts for its documents; a form under an accepted stem adds nothing
        odds_of, bad, good = forms[form]
        distinct = min(bad, n_contexts[form])
        part = distinct / (distinct + good)
        evidence = distinct * np.log(part / share) + (good * np.log((1 - part) / (1 - share)) if good else 0.0)
        pure = not good or odds_of >= STEM_LOG_ODDS or not form.endswith("*")
        if pure and distinct >= 0.3 * bad and evidence >= LEAST_EVIDENCE and not any(f"{form[:k]}*" in out for k in STEM_LENGTHS if f"{form[:k]}*" != form):
            out[form] = min(odds_of / LEAST_LOG_ODDS, 2.5)
    return out


def _weights(x: np.ndarray, y: np.ndarray, spread: float = 2.0) -> np.ndarray:
    """Pattern weights by logistic regression with a normal prior around PRIOR (Newton steps)."""
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - PRIOR) / spread**2
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and pattern weights from labels (doc_id, toxic) of docs (doc_id, text); both may be learned from."""
    sample = materialise(_sampled(labels, docs), "toxicity-sample")
    lexicon = Lexicon(_learned(sample))
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            x = [scorer.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "y"])

    # a bounded sample of short vectors
    rows = sample.mapInArrow(features, "x array<double>, y boolean").toArrow()
    discard(sample)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, len(PRIOR))
    return lexicon, _weights(x, np.array(rows.column("y").to_pylist(), dtype=float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        scorer = Scorer(lexicon)
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(PRIOR))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(scored, "doc_id long, score double, predicted int")
