"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words as classes: insult (I), threat (T), target (Y), negation (N), reported speech (R) and other
(O).  Small transducers rewrite that stream: negation marks what follows it closely, reported speech marks the rest of its clause,
and target marks what shares a clause with an address.  These three are composed into one machine, which reads a clause forwards;
addresses behind a match are marked before by a fourth, which reads it backwards.  The weight of a clause is the sum over its marked matches, so "you are an X", "he said X" and "not
an X" count differently although the word is the same.

Word weights are learned: forms (words and word beginnings) whose contexts are far commoner in toxic than in other
labelled rows.  A context is the word before, so copies of one text count once.  A logistic regression on clause sums turns
a text's matches into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

# Word lists of the grammar, English, German, French, Spanish.
INSULTS = "idiot moron stupid loser scum trash worthless disgusting pathetic clown imbecile dumbass jerk trottel dummkopf abschaum arschloch connard imbécile crétin salaud estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy punch beat shoot stab strangle umbringen töten verprügeln schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your you're youre u they them those he she du dich dir ihr euch sie tu toi te vous ils elles tú ti usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't without nicht kein keine keinen nie niemals ohne pas jamais aucun sans ne nunca jamás ningún sin".split()
REPORTS = "said says saying called calls wrote reported quoted claimed alleged according sagte sagt nannte schrieb laut zitierte dit disait appelé écrit selon dijo dice llamó escribió según".split()

CLASSES = "ITYNRO"
#: What the forward transducers read as an insult or a threat, addressed later in its clause or not.
MATCHES = ("I", "T", "I@", "T@")
NEGATION_REACH = 3
CLAUSE = re.compile(r"[.!?;:\n,]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")

#: The sample: about so many toxic and other labelled rows at most.
TOXIC_ROWS, OTHER_ROWS = 1500, 3000
STEMS = (4, 5, 6)
MIN_CONTEXTS, MIN_SHARE, MIN_LOG_ODDS, MAX_FORMS = 8, 0.01, 3.0, 500


@dataclass
class Transducer:
    """A deterministic transducer: arcs[(state, symbol)] = (state, symbol); a symbol without an arc passes unchanged."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))

    def compose(self, after: Transducer, alphabet: set[str]) -> Transducer:
        """The machine that feeds what this one writes to ``after``, reachable states only."""
        made, queue, seen = Transducer((self.start, after.start)), [(self.start, after.start)], {(self.start, after.start)}
        while queue:
            state = queue.pop()
            for symbol in alphabet:
                one, wrote = self.step(state[0], symbol)
                two, out = after.step(state[1], wrote)
                made.arcs[state, symbol] = ((one, two), out)
                if (one, two) not in seen:
                    seen.add((one, two))
                    queue.append((one, two))
        return made


def addressed_later() -> Transducer:
    """Reads a clause from its end and marks insults and threats before an address with '@'."""
    return Transducer(0, {(0, "Y"): (1, "Y"), (1, "I"): (1, "I@"), (1, "T"): (1, "T@")})


def negation() -> Transducer:
    """Marks insults and threats up to NEGATION_REACH words after a negation with '-'."""
    t = Transducer(0)
    for left in range(NEGATION_REACH + 1):
        for c in "YRO":
            t.arcs[left, c] = (max(0, left - 1), c)
        t.arcs[left, "N"] = (NEGATION_REACH, "N")
        for c in MATCHES:
            t.arcs[left, c] = (0, c + "-" if left else c)
    return t


def reported() -> Transducer:
    """Marks insults and threats after a verb of saying, to the end of the clause, with '"'."""
    t = Transducer(0, {(0, "R"): (1, "R")})
    for c in MATCHES:
        for d in (c, c + "-"):
            t.arcs[1, d] = (1, d + '"')
    return t


def targeted() -> Transducer:
    """Marks insults and threats after an address with '@', once; a threat whose clause addresses nobody is nothing."""
    t = Transducer(0, {(0, "Y"): (1, "Y")})
    for c in "IT":
        for marks in ("", "-", '"', '-"'):
            t.arcs[1, c + marks] = (1, c + marks + "@")
            if c == "T":
                t.arcs[0, c + marks] = (0, "O")
    return t


def grammar() -> Transducer:
    """The three forward transducers composed: negation, then reported speech, then target."""
    alphabet = {*CLASSES, *MATCHES}
    return negation().compose(reported(), alphabet).compose(targeted(), alphabet)


def marked(symbols: list[str], machine: Transducer) -> list[str]:
    """The symbols of one clause as the grammar marks them: one pass from its end, one from its beginning."""
    back, state, seen = addressed_later(), 0, []
    for symbol in reversed(symbols):
        state, wrote = back.step(state, symbol)
        seen.append(wrote)
    state, out = machine.start, []
    for symbol in reversed(seen):
        state, wrote = machine.step(state, symbol)
        out.append(wrote)
    return out


def weight_of(symbol: str) -> float:
    """What a match counts for against a bare insult: targets and threats more, negated and reported ones less."""
    if symbol[0] not in "IT":
        return 0.0
    w = 1.5 if symbol[0] == "T" else 1.0
    for mark, factor in (("@", 1.25), ("-", 0.3), ('"', 0.5)):
        w *= factor if mark in symbol else 1.0
    return w


@dataclass
class Model:
    """forms: word or 'stem*' to weight; coef: of 1, log(1 + sum of clause weights), strongest clause, clauses matched."""

    forms: dict[str, float]
    coef: np.ndarray

    def __post_init__(self) -> None:
        self._ready = None

    def __getstate__(self):
        return {"forms": self.forms, "coef": self.coef, "_ready": None}

    def _build(self):
        finder = ahocorasick.Automaton()
        for form in [*self.forms, *THREATS]:
            finder.add_word(form.rstrip("*"), (len(form.rstrip("*")), form.endswith("*")))
        finder.make_automaton()
        classes = {w: (c, 1.0) for c, words in (("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("T", THREATS)) for w in words}
        classes |= {w: ("I", v) for w, v in self.forms.items() if not w.endswith("*")}
        stems: dict[int, dict[str, float]] = {}
        for w, v in self.forms.items():
            if w.endswith("*"):
                stems.setdefault(len(w) - 1, {})[w[:-1]] = v
        machine = grammar()
        self._ready = (finder, classes, stems, machine)
        return self._ready

    def _class(self, word: str) -> tuple[str, float]:
        _, classes, stems, _ = self._ready
        found = classes.get(word)
        if found:
            return found
        for n, group in stems.items():
            if (v := group.get(word[:n])) is not None:
                return "I", v
        return "O", 0.0

    def clauses(self, text: str) -> list[float]:
        """The weights of the clauses that the grammar matches, in order."""
        finder, _, _, machine = self._ready or self._build()
        low = text.lower()
        size, spans, done = len(low), [], -1
        for end, (n, stem) in finder.iter(low):
            at = end - n + 1
            if (at and low[at - 1].isalnum()) or (not stem and end + 1 < size and low[end + 1].isalnum()) or at < done:
                continue
            begin = done if done > 0 else 0
            for m in CLAUSE.finditer(low, begin, at):  # clauses end behind their match, so each stretch is read once
                begin = m.end()
            stop = CLAUSE.search(low, end)
            done = stop.start() if stop else size
            spans.append((begin, done))
        out = []
        for begin, stop in spans:
            read = [self._class(m[0]) for m in WORD.finditer(low, begin, stop)]
            total = sum(weight_of(w) * value for w, (_, value) in zip(marked([c for c, _ in read], machine), read))
            if total > 0:
                out.append(total)
        return out

    def inputs(self, text: str | None) -> tuple[float, float, float, float]:
        found = self.clauses(text) if text else []
        return (1.0, math.log1p(sum(found)), max(found, default=0.0), math.log1p(len(found)))

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.coef, self.inputs(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def default_model() -> Model:
    return Model({w: 1.0 for w in INSULTS}, np.array([-4.0, 4.0, 2.0, 1.0]))


def forms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def _contexts(wanted: set[str] | None):
    """(form, context) pairs of each task, once a task; only the wanted forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for text in batch.column(0):
                before = 0
                for word in WORD.findall((text.as_py() or "").lower()):
                    if len(word) > 2 and not word.isdigit():
                        for form in forms_of(word):
                            if wanted is None or form in wanted:
                                seen.add((form, before))
                    before = int.from_bytes(word.encode()[-6:], "little")
        pairs = list(seen)
        for at in range(0, len(pairs), 100_000):
            part = pairs[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part]), pa.array([p[1] for p in part], pa.int64())], ["form", "context"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(text, toxic) of the sample, each distinct text once; toxic if any of its rows is."""
    marks = labels.where("toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, TOXIC_ROWS / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, OTHER_ROWS / max(1, counts.get(0, 0)))))
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    chosen = marks.where(chance < share).limit(2 * (TOXIC_ROWS + OTHER_ROWS))
    return docs.join(F.broadcast(chosen), "id").where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> Model:
    """Learn the insult forms and the logistic weights from labels (doc_id, toxic) of docs, on the bounded sample only.

    Without labels of both kinds the grammar keeps its fixed lists and weights."""
    rows = own_columns(docs, id=id_col, text=text_col)
    sample = _sample(rows, own_columns(labels, id=id_col, toxic="toxic"), seed).cache()
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        sample.unpersist()
        return default_model()
    schema = "form string, context bigint"
    least = max(MIN_CONTEXTS, int(MIN_SHARE * sizes[1]))
    counted = lambda kind, wanted: sample.where(F.col("toxic") == kind).select("text").mapInArrow(_contexts(wanted), schema).distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    toxic = {r.form: r.n for r in counted(1, None).where(F.col("n") >= least).collect()}
    other = {r.form: r.n for r in counted(0, set(toxic)).collect()}
    scale = math.log((sizes[0] + 1) / (sizes[1] + 1))
    odds = {f: math.log(n + 0.5) - math.log(other.get(f, 0) + 0.5) + scale for f, n in toxic.items()}
    strong = sorted((f for f, v in odds.items() if v >= MIN_LOG_ODDS), key=lambda f: (-toxic[f] * odds[f], len(f), f))
    forms: dict[str, float] = {}
    for f in strong:
        bare = f.rstrip("*")
        covered = any((g.endswith("*") and bare.startswith(g[:-1])) or g == f for g in forms)
        if not covered and len(forms) < MAX_FORMS:
            forms[f] = min(3.0, odds[f] / MIN_LOG_ODDS)
    for w in INSULTS:
        if not any(f == w or f == w[: len(f) - 1] + "*" for f in forms):
            forms[w] = 1.0
    model = Model(forms, np.zeros(4))
    found = sample.mapInArrow(_input_batches(model), "x array<double>, toxic int").collect()
    sample.unpersist()
    model.coef = logistic(np.array([r.x for r in found]), np.array([r.toxic for r in found], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Newton's method for the ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w


def _input_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [list(model.inputs(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "toxic"])

    return run


def _score_batches(model: Model, cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, clauses = [], []
            for t in batch.column("text"):
                x = model.inputs(t.as_py())
                z = float(np.dot(model.coef, x))
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
                clauses.append(round(math.expm1(x[3])))
            predicted = [int(s >= cut) for s in scores]
            rest = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores), pa.array(predicted, pa.int32()), pa.array(clauses, pa.int64())], ["doc_id", "held_out", "score", "predicted", "clauses"])

    return run


def score(docs: DataFrame, model: Model, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, clauses (how many clauses matched).

    Whole texts are read; a null or empty text gets the score of a text without a match.  Repeated rows get equal scores,
    a null id keeps its row (held_out is then false), an empty table gives no rows, and other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), held.alias("held_out"), "text")
    return rows.mapInArrow(_score_batches(model, cut), "doc_id bigint, held_out boolean, score double, predicted int, clauses bigint")


def keep_clean(docs: DataFrame, model: Model, cut: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores at least cut; all columns, types and repeats kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            yield batch.filter(pa.array([model.score(t.as_py()) < cut for t in texts], pa.bool_()))

    own_columns(docs, text=text_col)
    return docs.mapInArrow(run, docs.schema)
