"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text becomes a string of word classes: insult (words or word beginnings that labelled training texts show to be marks of toxic texts), threat, target
(second person), negation, reported speech, clause end, other. Three transducers read it in composition: reported speech turns the insults
and threats after a verb of saying into quoted ones, negation turns those within NEAR words after it into denied ones, and target joins one with a
second person up to NEAR words before or after it. An arc that reads an insult has the weight of its mark, the shrunk log odds of the texts with it. What comes out,
clauses and weights by kind, are a text's features; a logistic regression on the training texts weighs the kinds of clause, so lone words, denied and quoted
ones get weights of their own. Features don't depend on a text's language, source or id.

The classes start from short lists and are extended by what the training texts show: a word near which marks are toxic less often than elsewhere denies (up to NEAR words
before) or reports (further before, in the clause), one near which they are more often aims, and one near which a second person is toxic without any mark threatens.

Learned from at most about SAMPLE labelled texts, chosen by the hash of their ids, which bounds the marks (each is in 4 of them or more). Null and empty texts have no
clause and get the score of the bias. Rows with equal ids are scored each by its text; labels of null doc_id or null toxic are not learned from. Without any label nothing is toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.common import prepare, shared_dir, small_side, table, text_or_empty, written
from codexlake.llm.language import fold

SAMPLE, FOLDS, HELD_FOLD = 40_000, 5, 0
STEMS = (4, 5, 6, 8)
NEAR = 4
#: A mark's likelihood ratio statistic, the least part of the texts with it that are toxic, and the texts by which its log odds are shrunk.
LEAST_RATIO, LEAST_PART, SHRUNK = 15.0, 0.5, 4.0
#: The statistic of a word that changes what is near it.
CONTEXT_RATIO = 25.0

WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]")
END = set(".!?;:\n")
TARGET = frozenset("you your yours yourself dich dir dein deine ihr euch tu toi ton tes vous votre usted tú tuyo vosotros".split())
NEGATION = frozenset("not no never isn't don't nicht kein keine niemals nie pas jamais aucun nunca jamás ningún".split())
REPORT = frozenset("said says say called calls wrote quoted claimed sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó".split())
THREAT = frozenset("kill hurt destroy murder stab shoot beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())
INSULT_MARK, THREAT_MARK, TARGET_MARK, NEGATION_MARK, REPORT_MARK, END_MARK, OTHER = "I", "T", "Y", "N", "R", "|", "x"

KINDS = ("plain", "denied", "quoted", "aimed", "threat", "threat aimed")


class Transducer:
    """A deterministic transducer: step(state, symbol) gives the next state and what is written, at most one symbol."""

    def __init__(self, start: object, step) -> None:
        self.start, self.step = start, step

    def compose(self, after: Transducer) -> Transducer:
        """The transducer that feeds this one's output to ``after``."""

        def step(state: tuple, symbol: str) -> tuple:
            a, mid = self.step(state[0], symbol)
            b, out = after.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, after.start), step)

    def table(self, symbols: str) -> tuple[dict, object]:
        """Its arcs from every state that can be reached: (state number, symbol) to (state number, output)."""
        number, todo, arcs = {self.start: 0}, [self.start], {}
        while todo:
            s = todo.pop()
            for x in symbols:
                to, out = self.step(s, x)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                arcs[number[s], x] = (number[to], out)
        return arcs, 0


def _report(inside: int, x: str) -> tuple[int, str]:
    if x == END_MARK:
        return 0, x
    if x == REPORT_MARK:
        return 1, OTHER
    return inside, {INSULT_MARK: "q", THREAT_MARK: "q"}.get(x, x) if inside else x


def _negation(left: int, x: str) -> tuple[int, str]:
    if x == NEGATION_MARK:
        return NEAR, OTHER
    if x == END_MARK:
        return 0, x
    return max(0, left - 1), "d" if left and x in (INSULT_MARK, THREAT_MARK) else x


def _target(state: tuple[int, int, str], x: str) -> tuple[tuple[int, int, str], str]:
    """state: words since a second person and since an open insult or threat, up to NEAR, and which that was."""
    you, open_, which = state
    you, open_ = min(NEAR + 1, you + 1), min(NEAR + 1, open_ + 1)
    if open_ > NEAR:
        which = ""
    if x == END_MARK:
        return (NEAR + 1, NEAR + 1, ""), x
    if x == TARGET_MARK:
        out = {INSULT_MARK: "a", THREAT_MARK: "b"}.get(which, OTHER)
        return (0, NEAR + 1, ""), out
    if x in (INSULT_MARK, THREAT_MARK):
        if you <= NEAR:
            return (you, NEAR + 1, ""), "A" if x == INSULT_MARK else "B"
        return (you, 0, x), x
    return (you, open_, which), x


SYMBOLS = INSULT_MARK + THREAT_MARK + TARGET_MARK + NEGATION_MARK + REPORT_MARK + END_MARK + OTHER
GRAMMAR = Transducer(0, _report).compose(Transducer(0, _negation)).compose(Transducer((NEAR + 1, NEAR + 1, ""), _target))
ARCS, _ = GRAMMAR.table(SYMBOLS)
#: What an output adds to a clause's kinds; a second person after an insult turns the plain match into an aimed one.
EFFECT = {"I": {"plain": 1}, "T": {"threat": 1}, "d": {"denied": 1}, "q": {"quoted": 1}, "A": {"aimed": 1}, "B": {"threat aimed": 1}, "a": {"plain": -1, "aimed": 1}, "b": {"threat": -1, "threat aimed": 1}}


@dataclass(frozen=True)
class Grammar:
    """What is learned: weights of marks, and words by class besides the lists."""

    marks: dict[str, float] = field(default_factory=dict)
    classes: dict[str, str] = field(default_factory=dict)


NO_MATCH = [0.0] * (2 * len(KINDS) + 2)


def clause_counts(classes: str, weights: list[float]) -> list[float]:
    """For each of KINDS, the clauses that hold it and the weight of its marks; then the matched clauses, and their part of all. A clause's end leads back to the first
    state, so clauses without an insult or threat, which write nothing that counts, aren't read. weights: of the classes' words."""
    clauses, weight = Counter(), Counter()
    matched, begin, n = 0, 0, 1
    while begin <= len(classes):
        end = classes.find(END_MARK, begin)
        end = len(classes) if end < 0 else end
        n += end < len(classes)
        part = classes[begin:end]
        if INSULT_MARK in part or THREAT_MARK in part:
            state, open_ = 0, 0.0
            clause: Counter = Counter()
            for k, x in enumerate(part):
                state, out = ARCS[state, x]
                if x in (INSULT_MARK, THREAT_MARK):
                    open_ = weights[begin + k]
                for kind, sign in EFFECT.get(out, {}).items():
                    clause[kind] += sign
                    weight[kind] += sign * open_
            found = [k for k in KINDS if clause[k] > 0]
            clauses.update(found)
            matched += bool(found)
        begin = end + 1
    return [*(math.log1p(clauses[k]) for k in KINDS), *(math.log1p(max(0.0, weight[k])) for k in KINDS), math.log1p(matched), matched / n]


class Lexicon:
    """Word classes and weights, with a bounded cache."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self._held: dict[str, str] = {x: END_MARK for x in END}

    def weight(self, word: str) -> float:
        return max((self.grammar.marks.get(s, 0.0) for s in stems(word)), default=0.0)

    def of(self, word: str) -> str:
        for known, mark in ((TARGET, TARGET_MARK), (NEGATION, NEGATION_MARK), (REPORT, REPORT_MARK), (THREAT, THREAT_MARK)):
            if word in known:
                return mark
        if self.weight(word):
            return INSULT_MARK
        return self.grammar.classes.get(word, OTHER)

    def read(self, text: str) -> tuple[list[str], str]:
        """The words of a text, clause ends among them, and their classes."""
        held = self._held
        words = WORD.findall(text.lower())
        missing = [w for w in set(words) if w not in held]
        if len(held) + len(missing) > 500_000:
            self._held = held = {x: END_MARK for x in END}
            missing = set(words) - END
        held.update((w, self.of(w)) for w in missing)
        return words, "".join(map(held.__getitem__, words))


def stems(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in STEMS if len(word) >= k)]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The regression's inputs: 1 and clause_counts."""
    words, classes = lexicon.read(text)
    if INSULT_MARK not in classes and THREAT_MARK not in classes:
        return [1.0, *NO_MATCH]
    weights = [lexicon.weight(w) if c == INSULT_MARK else float(c == THREAT_MARK) for w, c in zip(words, classes, strict=True)]
    return [1.0, *clause_counts(classes, weights)]


def counts_of(sample: DataFrame, keys) -> DataFrame:
    """stem, a, b: the clean and the toxic texts of sample (text, toxic) that have each of keys(text), a set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s in keys(text):
                    held.setdefault(s, [0, 0])[toxic] += 1
            if len(held) > 200_000:
                yield _counted(held)
                held = {}
        if held:
            yield _counted(held)

    return sample.select("text", "toxic").mapInArrow(count, "stem string, clean long, bad long").groupBy("stem").agg(F.sum("clean").alias("a"), F.sum("bad").alias("b"))


def _ratio(part: Column | float) -> Column:
    """The likelihood ratio statistic of a and b against a toxic part."""
    of, part = F.col("a") + F.col("b"), F.lit(part) if isinstance(part, float) else part
    term = lambda n, p: F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0)
    return 2 * (term(F.col("b"), part) + term(F.col("a"), 1 - part))


def learned_marks(sample: DataFrame) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with weights; sample: text, toxic."""
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return {}
    part = toxic / n
    keys = lambda text: {s for w in set(WORD.findall(text.lower())) - END for s in stems(w)}
    kept = counts_of(sample, keys).filter("b >= 4").withColumn("ratio", _ratio(part)).filter((F.col("ratio") >= LEAST_RATIO) & (F.col("b") >= LEAST_PART * (F.col("a") + F.col("b"))))
    odds = F.log((F.col("b") + SHRUNK * part) / (F.col("a") + SHRUNK * (1 - part))) - math.log(part / (1 - part))
    return {r["stem"]: r["odds"] for r in kept.select("stem", odds.alias("odds")).collect() if r["odds"] > 0}  # bounded by the sample


#: What is counted for learned classes: a letter and a word; the letter alone for all texts that it is counted in.
DENIES, REPORTS, AIMS, THREATENS = "N", "R", "Y", "T"


def context_keys(text: str, lexicon: Lexicon) -> set[str]:
    """The words near marks, or near a second person in texts without marks, by the class that they may belong to."""
    words, classes = lexicon.read(text)
    out = set()
    if INSULT_MARK in classes:
        out |= {DENIES, REPORTS, AIMS}
        for k, x in enumerate(classes):
            if x != INSULT_MARK:
                continue
            begin, end = classes.rfind(END_MARK, 0, k) + 1, classes.find(END_MARK, k)
            end = len(words) if end < 0 else end
            out.update(DENIES + words[i] for i in range(max(begin, k - NEAR), k) if classes[i] == OTHER)
            out.update(REPORTS + words[i] for i in range(begin, max(begin, k - NEAR)) if classes[i] == OTHER)
            out.update(AIMS + words[i] for i in range(max(begin, k - NEAR), min(end, k + NEAR + 1)) if classes[i] == OTHER)
    elif TARGET_MARK in classes:
        out.add(THREATENS)
        for k, x in enumerate(classes):
            if x == TARGET_MARK:
                out.update(THREATENS + words[i] for i in range(max(0, k - NEAR), min(len(words), k + NEAR + 1)) if classes[i] == OTHER)
    return out


def learned_classes(sample: DataFrame, marks: dict[str, float]) -> dict[str, str]:
    """Words that change what marks or second persons near them mean, with their classes."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(marks)
    held: list[Lexicon] = []

    def keys(text: str) -> set[str]:
        lexicon = held[0] if held else held.append(Lexicon(Grammar(shared.value))) or held[0]
        return context_keys(text, lexicon)

    counts = written(counts_of(sample, keys), shared_dir(spark), "contexts")
    base = {r["stem"]: (r["a"], r["b"]) for r in counts.filter(F.length("stem") == 1).collect()}
    found: dict[str, tuple[float, str]] = {}
    for letter, sign, mark in ((DENIES, -1, NEGATION_MARK), (REPORTS, -1, REPORT_MARK), (AIMS, 1, TARGET_MARK), (THREATENS, 1, THREAT_MARK)):
        a, b = base.get(letter, (0, 0))
        if not a or not b:
            continue
        part = b / (a + b)
        away = sign * (F.col("b") - part * (F.col("a") + F.col("b")))
        words = counts.filter((F.length("stem") > 1) & F.col("stem").startswith(letter) & (away > 0)).withColumn("ratio", _ratio(part)).filter(F.col("ratio") >= CONTEXT_RATIO)
        for r in words.collect():  # bounded by the sample
            found[r["stem"][1:]] = max(found.get(r["stem"][1:], (0.0, "")), (r["ratio"], mark))
    return {w: mark for w, (_, mark) in found.items()}


def _counted(held: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"stem": list(held), "clean": [x[0] for x in held.values()], "bad": [x[1] for x in held.values()]})


def regression(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the bias, the first column, isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], strength)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(h, x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Grammar, list[float]]:
    """Grammar and weights from docs (doc_id, text) with labels (doc_id, toxic), those of HELD_FOLD excepted."""
    where = shared_dir(docs.sparkSession)
    usable = labels.filter((fold(FOLDS) != HELD_FOLD) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    part = min(1.0, SAMPLE / max(1, usable.count()))
    chosen = written(usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20)), where, "labels")
    sample = written(docs.select("doc_id", text_or_empty().alias("text")).join(small_side(chosen), "doc_id").select("text", "toxic"), where, "sample")
    marks = learned_marks(sample)
    grammar = Grammar(marks, learned_classes(sample, marks))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(grammar)
        for b in batches:
            x = [features(t, lexicon) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    held = sample.mapInArrow(rows, "x array<double>, toxic int").groupBy("x", "toxic").count().toPandas()  # bounded by the sample
    if held.empty:
        return grammar, [-10.0, *NO_MATCH]
    x = np.repeat(np.array(held["x"].tolist()), held["count"].to_numpy(), axis=0)
    return grammar, regression(x, np.repeat(held["toxic"].to_numpy(float), held["count"].to_numpy())).tolist()


def score(docs: DataFrame, grammar: Grammar, weights: list[float]) -> DataFrame:
    """doc_id, score for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar, weights))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        lexicon = Lexicon(known)
        for b in batches:
            z = [sum(a * c for a, c in zip(features(t, lexicon), w, strict=True)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z])], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, scored."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = F.coalesce(fold(FOLDS) == HELD_FOLD, F.lit(False))
    return score(docs, *model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones; every column stays as it is."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = shared.value
        lexicon = Lexicon(grammar)
        for b in batches:
            z = [sum(a * c for a, c in zip(features(t or "", lexicon), w, strict=True)) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([v < 0 for v in z], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
