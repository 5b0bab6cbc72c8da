"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause.  Five small transducers turn words into marks with weights: insults (words
and word beginnings with weights learned from labelled documents, and a short list of set ones), threats,
targets, negations and reported speech (closed word lists in four languages).  Their composition is one
automaton over marks: an insult counts more beside a target, a negation before it and a reporting verb
before it weaken it, and a threat counts only together with a target.  A clause's weight is what its matched
pattern weighs, not what its words weigh one by one; a logistic curve over the document's clause weights,
fitted on documents the lexicon was not learned from, gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stagecraft.llm.util import Memo, id_crc, map_arrow, release
from stagecraft.runtime import store

# Closed classes of the grammar: English, German, French, Spanish.
THREATS = frozenset("kill killing murder destroy hurt punch stab shoot strangle töten umbringen schlagen tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours he she they them him her people du dich dir ihr euch sie er ihm tu toi te vous il elle ils vosotros ustedes tú usted ellos ellas".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't don't nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says say called wrote quoted claimed reported sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())

THREAT_WEIGHT = 2.0   # of a threat beside a target
TARGET_FACTOR = 1.25  # of an insult beside a target
NEGATED = 0.6         # of an insult after a negation
REPORTED = 0.6        # of an insult after a reporting verb
REACH = 3             # words a negation reaches
TERMS = 50_000        # terms held by a task before it passes them on
PREFIXES = (3, 4, 5, 6, 7)  # lengths of learned word beginnings

EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
PLAIN, END = 0, 1     # marks; others are tuples


def normal(word: str) -> str:
    """Lower case, without signs and digits at both ends."""
    return EDGES.sub("", word.lower())


def terms(word: str) -> Iterable[str]:
    """What a word offers to the learned lexicon: itself, and its beginnings marked by a star."""
    if word:
        yield word
        for n in PREFIXES:
            if len(word) > n:
                yield word[:n] + "*"


@dataclass
class Grammar:
    """The composed transducer.  ``lexicon`` maps terms to weights; ``curve`` is the fitted logistic curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-2.0, 1.0, 0.0, 0.0)

    def marker(self) -> Memo:
        return Memo(self.mark, 200_000)

    def mark(self, raw: str):
        """The mark of one written word: PLAIN, END (of a clause), or (kind, weight, ends the clause)."""
        ends = raw[-1] in ".!?;:" or raw.rstrip("\"'%$#&*)").endswith((".", "!", "?", ";", ":"))
        word = normal(raw)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        for kind, found in (("insult", weight > 0), ("threat", word in THREATS), ("target", word in TARGETS),
                            ("negation", word in NEGATIONS), ("report", word in REPORTS)):
            if found:
                return kind, weight, ends
        return END if ends else PLAIN

    def clauses(self, marks: list) -> list[float]:
        """The weights of the matched clauses, read from left to right by the composed automaton."""
        out: list[float] = []
        insults, threat, target, report, negated = 0.0, False, False, False, 0
        for m in [*marks, END]:
            if m is PLAIN:
                negated -= negated > 0
                continue
            if m is END:
                kind, weight, ends = "", 0.0, True
            else:
                kind, weight, ends = m
            if kind == "insult":
                insults += weight * (NEGATED if negated else 1.0) * (REPORTED if report else 1.0)
            elif kind == "negation":
                negated = REACH + 1
            threat |= kind == "threat"
            target |= kind == "target"
            report |= kind == "report"
            negated -= negated > 0
            if ends:
                matched = insults * (TARGET_FACTOR if target else 1.0) + (
                    THREAT_WEIGHT * (NEGATED if negated else 1.0) * (REPORTED if report else 1.0) if threat and target else 0.0)
                if matched > 0:
                    out.append(matched)
                insults, threat, target, report, negated = 0.0, False, False, False, 0
        return out

    def features(self, text: str, marker: Memo) -> tuple[float, float, float]:
        """Sum, maximum and number of the matched clauses' weights, each on a logarithmic scale."""
        marks = list(map(marker.__getitem__, text.split()))
        if all(type(m) is int or m[0] in ("target", "negation", "report") for m in set(marks)):
            return 0.0, 0.0, 0.0
        found = self.clauses(marks)
        return float(np.log1p(sum(found))), float(np.log1p(max(found, default=0.0))), float(np.log1p(len(found)))

    def score(self, text: str, marker: Memo) -> float:
        level = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text, marker)))
        return float(1 / (1 + np.exp(-level)))


def learned(counts: Iterable[tuple[str, int, int]], toxic: int, clean: int, at_least: float = 12.0) -> dict[str, float]:
    """Weights of the terms that mark toxic documents: (term, toxic documents, clean documents) -> log odds.

    Kept are terms with a likelihood ratio of ``at_least``, in at least three and in half a percent of the
    toxic documents, and with a document odds ratio above e^2.
    """
    out = {}
    for term, t, c in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if t < max(3, 0.005 * toxic) or odds < 2:
            continue
        expected_t = (t + c) * toxic / (toxic + clean)
        expected_c = (t + c) * clean / (toxic + clean)
        ratio = 2 * (t * np.log(t / expected_t) + (c * np.log(c / expected_c) if c else 0))
        if ratio >= at_least:
            out[term] = float(odds)
    return out


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic regression by Newton's method; a small ridge keeps separable data finite."""
    if not len(y):
        return Grammar().curve
    a = np.column_stack([np.ones(len(y)), x])
    w, keep = np.zeros(a.shape[1]), np.array([1e-3] + [ridge] * (a.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", rows: int = 20_000, lexicon: int = 8192) -> Grammar:
    """A grammar learned from labelled documents.

    ``rows`` bounds the sample (by a hash of the text, so copies of a text stay together); ``lexicon`` bounds
    the learned terms.  The curve is fitted on terms learned from the other half of the sample.  Rows without
    a label are left out; without any label of one kind the lexicon is empty.
    """
    known = labelled.where(F.col(f"`{label_col}`").isNotNull()).select(
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), (F.col(f"`{label_col}`") > 0).alias("toxic"))
    known = known.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(1_000_003)))
    share = min(1.0, rows / max(1, known.count()))
    sample = store(known.where(F.col("draw") < F.lit(int(1_000_003 * share))).withColumn("fold", (F.col("draw") % 2).cast("int")), "labelled")

    def make():
        def step(batch):
            out: dict[str, list] = {"term": [], "fold": [], "toxic": []}
            for text, toxic, fold in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                seen = {t for w in set(map(normal, text.split())) for t in terms(w)}
                out["term"] += seen
                out["fold"] += [fold] * len(seen)
                out["toxic"] += [toxic] * len(seen)
                if len(out["term"]) > TERMS:
                    yield out
                    out = {k: [] for k in out}
            yield out
        return step

    cells = [(f, t) for f in (0, 1) for t in (True, False)]
    is_cell = lambda f, t: F.sum(((F.col("fold") == f) & (F.col("toxic") == t)).cast("int"))
    sizes = sample.agg(*[F.coalesce(is_cell(*c), F.lit(0)) for c in cells]).first()
    counts = map_arrow(sample.select("text", "toxic", "fold"), make, "term string, fold int, toxic boolean").groupBy("term").agg(
        *[is_cell(*c).alias(f"n{i}") for i, c in enumerate(cells)])
    toxic, clean = F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3")
    odds = (toxic + 0.5) / (clean + 0.5)
    # A bounded model: the terms with the highest odds among those in three toxic documents or more.
    best = counts.where((toxic >= 3) & (odds * F.lit((sizes[1] + sizes[3] + 1) / (sizes[0] + sizes[2] + 1)) > float(np.exp(2)))).orderBy(
        (odds * toxic).desc(), "term").limit(lexicon).collect()
    whole = Grammar(learned([(r.term, r.n0 + r.n2, r.n1 + r.n3) for r in best], sizes[0] + sizes[2], sizes[1] + sizes[3]))
    crossed = {1: Grammar(learned([(r.term, r.n0, r.n1) for r in best], sizes[0], sizes[1], 6.0)),
               0: Grammar(learned([(r.term, r.n2, r.n3) for r in best], sizes[2], sizes[3], 6.0))}

    def make_features():
        markers = {k: g.marker() for k, g in crossed.items()}

        def step(batch):
            found = [crossed[f].features(t, markers[f]) for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield {**{k: [x[i] for x in found] for i, k in enumerate(("total", "most", "clauses"))}, "toxic": batch.column(2)}
        return step

    seen = map_arrow(sample.select("text", "fold", "toxic"), make_features, "total double, most double, clauses double, toxic boolean").toPandas()
    whole.curve = fitted(seen[["total", "most", "clauses"]].to_numpy(float), seen["toxic"].to_numpy(float))
    return whole


def score_column(grammar: Grammar, text: Column) -> Column:
    """The score of a text, 0 to 1; NULL counts as empty.  The grammar (a bounded lexicon) travels with the task."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marker = grammar.marker()
        for texts in batches:
            yield texts.map(lambda t: grammar.score(t, marker)).astype("float64")
        marker = texts = None
        release()

    return run(F.coalesce(text.cast("string"), F.lit("")))


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", held_out: Column | None = None, rows: int = 20_000,
               text_col: str = "text") -> Grammar:
    """Learn from ``labels`` (id, toxic) outside the held-out fold; an id labelled more than once is toxic if any label says so."""
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    own = labels.where(F.col(id_col).isNotNull() & ~held).groupBy(F.col(id_col).alias("label_id")).agg(F.max("toxic").alias("label_toxic"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return fit(texts.join(own, F.col("id") == F.col("label_id")).select("text", F.col("label_toxic").alias("toxic")), rows=rows)


def is_held_out(id_col: str = "doc_id") -> Column:
    """Every fourth id by checksum takes no part in learning."""
    return id_crc(id_col) % 4 == 2


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of each document.

    NULL and empty texts get the score of a text without matched clauses; NULL ids and repeated rows are
    scored like any other; an empty table gives an empty result; other columns are not read.
    """
    scored = docs.select(F.col(f"`{id_col}`").alias("id"), score_column(grammar, F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, with all their columns; no shuffle."""
    return docs.where(score_column(grammar, F.col(f"`{text_col}`")) < threshold)
