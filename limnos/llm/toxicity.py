"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps words to symbols: insults and threats (with weights, learned from labels where these hold the word), targets,
negations and speech verbs. Five machines read the symbols of a clause. Two accept patterns: an insult, by itself or with a target behind
it, and a threat that a target stands before or behind. Three weigh what those take: a target before an insult, a negation before either,
reported speech before either. Their composition is one machine; a clause's weight is the sum over its accepted paths, each the product of
its arcs and of the weights of the words it takes. Arcs carry marks, so that paths are summed by the marks that they collect, and the weights of
all arcs are learned from labels: those that maximise the likelihood of the sums by mark. A document's score is the calibrated sum over its clauses.
Weights and calibration come from documents that the lexicon at hand was not learned from."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, isotonic, labelled_sample, map_batches, materialize

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = SYMBOLS = range(6)

# Fixed word lists in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumm dummkopf trottel abschaum widerlich wertlos idioten imbécile imbéciles connard crétin abruti minable ordure débile idiota idiotas estúpido estúpida imbécil imbéciles basura asqueroso patético inútil".split()
TARGETS = "you your yourself u he she they them people everyone du dich dir ihr euch sie er leute tu toi vous ton votre il elle ils gens tú usted ustedes él ella ellos gente".split()
NEGATIONS = "not no never isn't aren't don't wasn't without nicht kein keine nie niemals ohne ne pas jamais sans aucun nunca jamás sin ningún".split()
REPORTS = "said says say told called calls reported quoted claimed wrote sagte sagt nannte berichtete schrieb dit disait appelé écrit rapporté dijo dice llamó escribió citó".split()
THREATS = "kill hurt destroy beat shoot stab murder burn töten umbringen schlagen zerstören tuer frapper détruire brûler matar golpear destruir quemar".split()
_EDGE = "\"'()[]{}<>.,;:!?¡¿«»…*#%&$-_|"
_BINS = 400


#: Marks of arcs: a target behind an insult; a target before a threat; a target before an insult; negation; reported speech; a threat.
BEHIND, BEFORE, AIMED, NEGATED, REPORTED, THREATENED = MARKS = (1, 2, 4, 8, 16, 32)
#: Weights of arcs by mark before anything is learned. A target makes an insult worse, negation much weaker, reported speech weaker.
PRIOR = (0.5, 0.8, 1.5, 0.3, 0.5, 1.0)


@dataclass(frozen=True)
class Machine:
    """A weighted automaton over clause symbols: step(state, symbol) gives the arcs (next state, marks, whether the path takes the word) that read it."""

    start: object
    step: Callable
    accepts: Callable

    def __or__(self, other: "Machine") -> "Machine":
        """The union: a path is one of either. The first symbol decides."""

        def step(state, symbol):
            if state is None:
                return [((k, to), mark, takes) for k, m in enumerate((self, other)) for to, mark, takes in m.step(m.start, symbol)]
            k, own = state
            return [((k, to), mark, takes) for to, mark, takes in (self, other)[k].step(own, symbol)]

        return Machine(None, step, lambda s: s is not None and (self, other)[s[0]].accepts(s[1]))

    def __matmul__(self, other: "Weigher") -> "Machine":
        """The composition: the other reads the symbols and what the paths take of them; marks add up, so weights multiply."""

        def step(state, symbol):
            out = []
            for to, mark, takes in self.step(state[0], symbol):
                then, more = other.step(state[1], symbol, takes)
                out.append(((to, then), mark | more, takes))
            return out

        return Machine((self.start, 0), step, lambda s: self.accepts(s[0]))


@dataclass(frozen=True)
class Weigher:
    """A transducer that marks words of the symbols `over`, where a path takes them, if `start` is among the `reach` words before them (None: anywhere before them in the clause)."""

    start: int
    reach: int | None
    mark: int
    over: tuple[int, ...]

    def step(self, left: int, symbol: int, takes: bool) -> tuple[int, int]:
        to = (self.reach or 1) if symbol == self.start else left if self.reach is None else max(left - 1, 0)
        return to, self.mark if takes and left and symbol in self.over else 0


def insults(reach: int = 3) -> Machine:
    """Accepts an insult by itself and, besides, an insult whose next target is among the `reach` words behind it."""

    def step(state, symbol):
        if state == "end":
            return [("end", 0, False)]
        if state == "before":
            return [("before", 0, False)] + ([("end", 0, True), (reach, 0, True)] if symbol == INSULT else [])
        return [("end", BEHIND, False)] if symbol == TARGET else [(state - 1, 0, False)] if state > 1 else []

    return Machine("before", step, lambda s: s == "end")


def threats(reach: int = 4) -> Machine:
    """Accepts a threat whose next target is among the `reach` words behind it, and one with a target among the `reach` words before it. A threat without a target is none."""

    def step(state, symbol):
        if state == "end":
            return [("end", 0, False)]
        kind, left = state
        if kind == "before":
            out = [(("before", reach if symbol == TARGET else max(left - 1, 0)), 0, False)]
            if symbol == THREAT:
                out += [(("open", reach), THREATENED, True)] + ([("end", THREATENED | BEFORE, True)] if left else [])
            return out
        return [("end", 0, False)] if symbol == TARGET else [(("open", left - 1), 0, False)] if left > 1 else []

    return Machine(("before", 0), step, lambda s: s == "end")


#: Patterns, and what marks them; reported speech reaches to the clause's end.
PATTERNS = [insults(), threats()]
WEIGHERS = [Weigher(TARGET, 4, AIMED, (INSULT,)), Weigher(NEGATION, 3, NEGATED, (INSULT, THREAT)), Weigher(REPORT, None, REPORTED, (INSULT, THREAT))]


def compile_grammar(patterns: list[Machine] = PATTERNS, weighers: list[Weigher] = WEIGHERS) -> tuple[list, list[bool]]:
    """The composed machine with its states numbered from the start, 0: arcs[state][symbol] is a list of (next, marks, takes); and which states accept."""
    whole = reduce(lambda a, b: a @ b, weighers, reduce(lambda a, b: a | b, patterns))
    index, todo, arcs = {whole.start: 0}, [whole.start], []
    for s in todo:
        row = []
        for symbol in SYMBOLS:
            out = []
            for to, mark, takes in whole.step(s, symbol):
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                out.append((index[to], mark, takes))
            row.append(out)
        arcs.append(row)
    return arcs, [whole.accepts(s) for s in todo]


def clause_marks(grammar: tuple[list, list[bool]], clause: list[tuple[int, float]]) -> dict[int, float]:
    """By the marks that they collect, the sums of accepted paths (forward algorithm) for (symbol, weight of the word) in order; a word's weight counts where a path takes it."""
    arcs, accepts = grammar
    at = {(0, 0): 1.0}
    for symbol, word in clause:
        now: dict[tuple[int, int], float] = {}
        for (state, marks), weight in at.items():
            for to, mark, takes in arcs[state][symbol]:
                key = (to, marks | mark)
                now[key] = now.get(key, 0.0) + (weight * word if takes else weight)
        at = now
    out: dict[int, float] = {}
    for (state, marks), weight in at.items():
        if accepts[state]:
            out[marks] = out.get(marks, 0.0) + weight
    return out


def mark_weights(arcs: tuple[float, ...] | np.ndarray = PRIOR) -> np.ndarray:
    """The product of arcs for every set of marks."""
    sets = np.arange(1 << len(MARKS))
    return np.prod([np.where(sets & m, w, 1.0) for m, w in zip(MARKS, arcs)], axis=0)


def clause_weight(grammar: tuple[list, list[bool]], clause: list[tuple[int, float]], weights: np.ndarray | None = None) -> float:
    """The sum over accepted paths."""
    weights = mark_weights() if weights is None else weights
    return float(sum(weights[m] * w for m, w in clause_marks(grammar, clause).items()))


def fit_arcs(sums: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of arcs from documents' path sums by marks (documents, sets of marks) and labels: the logarithm of one plus the weighted sum explains the label's log odds.

    Steps up the likelihood by Newton's method on damped numerical derivatives; logarithms of weights are pulled towards PRIOR's by `pull`, so an arc that no labelled path takes keeps its weight."""
    if not len(y) or y.min() == y.max():
        return np.array(PRIOR)
    rare = (y == y.max()).mean()
    start = np.concatenate([[np.log(rare / (1 - rare)), 1.0], np.zeros(len(MARKS))])

    def residuals(t: np.ndarray) -> tuple[float, np.ndarray]:
        z = t[0] + t[1] * np.log1p(sums @ mark_weights(np.array(PRIOR) * np.exp(t[2:])))
        return float(np.sum(np.logaddexp(0, z) - y * z) + pull * np.sum(t[2:] ** 2) + 1e-3 * t[1] ** 2), z

    t, (value, z) = start, residuals(start)
    for _ in range(rounds):
        step = 1e-4
        j = np.stack([(residuals(t + step * e)[1] - z) / step for e in np.eye(len(t))], axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        ridge = np.concatenate([[0.0, 2e-3], np.full(len(MARKS), 2 * pull)])
        g, h = j.T @ (p - y) + ridge * np.concatenate([[0.0], t[1:]]), j.T @ ((p * (1 - p))[:, None] * j) + np.diag(ridge + 1e-6)
        move, scale = np.linalg.solve(h, g), 1.0
        while scale > 1e-4 and residuals(t - scale * move)[0] > value:
            scale /= 2
        if scale <= 1e-4:
            break
        t = t - scale * move
        before, (value, z) = value, residuals(t)
        if before - value < 1e-6 * max(1.0, abs(value)):
            break
    return np.array(PRIOR) * np.exp(np.clip(t[2:], -3, 3))


def _forms(word: str) -> list[str]:
    """A word and its stems of four to six letters, marked by a star."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def _bare(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class ToxicModel:
    weight: dict[str, float]
    rates: np.ndarray
    arcs: tuple[float, ...] = PRIOR
    grammar: tuple[list, list[bool]] = field(default_factory=compile_grammar)

    def lexicon(self) -> dict[str, tuple[int, float]]:
        """Whole words and stems to (symbol, weight); fixed lists give way to what labels taught."""
        out = {w: (s, 1.0) for s, ws in ((INSULT, INSULTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
        return out | {w: (THREAT if w in THREATS else INSULT, x) for w, x in self.weight.items()}

    def marker(self):
        """A function of a text: its clauses' sums by marks. It remembers words, a bounded number of them."""
        known, lexicon, none = {}, self.lexicon(), (OTHER, 0.0)

        def lookup(token: str) -> tuple[tuple[int, float], bool]:
            word = token.strip(_EDGE)
            found = lexicon.get(word)
            if found is None or found[0] in (TARGET, NEGATION, REPORT):
                found = next((lexicon[f] for f in reversed(_forms(word)[1:]) if f in lexicon), found or none)
            if len(known) > 400_000:
                known.clear()
            known[token] = found = (found, token[-1] in ".!?;:")
            return found

        def sums(text: str | None) -> dict[int, float]:
            symbols = [known.get(t) or lookup(t) for t in _bare(text)]
            hits = [i for i, (s, _) in enumerate(symbols) if s[0] <= THREAT]
            out: dict[int, float] = {}
            done = -1
            for i in hits:
                if i > done:  # the clause around the hit
                    begin = end = i
                    while begin > done + 1 and not symbols[begin - 1][1]:
                        begin -= 1
                    while end < len(symbols) - 1 and not symbols[end][1]:
                        end += 1
                    for m, w in clause_marks(self.grammar, [s for s, _ in symbols[begin : end + 1]]).items():
                        out[m] = out.get(m, 0.0) + w
                    done = end
            return out

        return sums

    def scorer(self):
        """A function of a text: the sum of its clauses' weights."""
        sums, weights = self.marker(), mark_weights(self.arcs)
        return lambda text: float(sum(weights[m] * w for m, w in sums(text).items()))

    @staticmethod
    def bins(total: np.ndarray) -> np.ndarray:
        return np.clip(total * 20, 0, _BINS - 1).astype(int)


def _term_counts(rows: DataFrame, flush: int = 200_000) -> DataFrame:
    """term, half, toxic, clean: labelled documents that hold the term, counted within tasks before the shuffle."""

    def run(batches):
        counts: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}

        def out():
            rows = [(t, h, counts[h, 1][t], counts[h, 0][t]) for h in (0, 1) for t in {**counts[h, 0], **counts[h, 1]}]
            for c in counts.values():
                c.clear()
            kinds = (("term", pa.string()), ("half", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

        for b in batches:
            for text, half, y in zip(*(b.column(c).to_pylist() for c in ("text", "half", "y"))):
                counts[half, y].update({f for w in {t.strip(_EDGE) for t in _bare(text)} if w for f in _forms(w)})
                if sum(map(len, counts.values())) > flush:
                    yield out()
        yield out()

    return rows.select("text", "half", "y").mapInArrow(run, "term string, half int, toxic long, clean long").groupBy("term", "half").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(terms: list, halves: tuple[int, ...], n: dict[tuple[int, int], int], least: int, odds: float) -> dict[str, float]:
    """Terms and stems of the documents of some halves with their weights."""
    bad, good = (sum(n.get((h, y), 0) for h in halves) for y in (1, 0))
    out = {}
    for r in terms:
        toxic, clean = sum(r[f"t{h}"] for h in halves), sum(r[f"c{h}"] for h in halves)
        w = np.log((toxic + 0.5) / (bad + 1.0)) - np.log((clean + 0.5) / (good + 1.0))
        if toxic >= least and w >= odds:
            out[r["term"]] = min(float(w), 8.0) / 4
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 60_000, least: int = 3, odds: float = 3.0) -> ToxicModel:
    """Learns the weighted lexicon, the weights of arcs and the calibration from about `most` labelled documents at most (crc32(id) mod 4 = 2 left out).

    A term or stem enters if at least `least` toxic documents of the sample hold it and its smoothed log odds reach `odds`; the sample bounds
    their number. For arcs and calibration each half of the sample is read with the lexicon of the other half; the path sums of the sample, by marks, reach the driver.
    Without labelled rows the lexicon holds the fixed lists only and every score is 0.5. Null texts hold no term."""
    sample = labelled_sample(labels, label, id_col, most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    rows = materialize(rows.select("text", "y", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")), "toxic-rows")
    n = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    of = lambda h, c, name: F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(name)
    found = _term_counts(rows).groupBy("term").agg(of(0, "toxic", "t0"), of(1, "toxic", "t1"), of(0, "clean", "c0"), of(1, "clean", "c1"))
    # what can enter a lexicon of the whole sample or of a half
    terms = found.where(F.col("t0") + F.col("t1") >= min(2, least)).where(_may_enter(n, odds)).collect()
    lexicons = {h: _lexicon(terms, (1 - h,), n, max(2, least - 1), odds) for h in (0, 1)}
    model = ToxicModel(_lexicon(terms, (0, 1), n, least, odds), np.full(_BINS, 0.5))

    def marks(b: dict, f) -> dict:
        sums = [f[h](t) for h, t in zip(b["half"], b["text"])]
        return {"marks": [list(x) for x in sums], "weights": [list(x.values()) for x in sums], "y": b["y"]}

    got = map_batches(rows, marks, "marks array<int>, weights array<double>, y int", lambda: {h: ToxicModel(x, None).marker() for h, x in lexicons.items()}).collect()
    sums, y = np.zeros((len(got), 1 << len(MARKS))), np.array([r["y"] for r in got], float)
    for to, r in zip(sums, got):
        to[r["marks"]] = r["weights"]
    model.arcs = tuple(fit_arcs(sums, y))
    if len(got):
        at = model.bins(sums @ mark_weights(model.arcs))
        model.rates = isotonic(np.bincount(at, y, _BINS), np.bincount(at, minlength=_BINS))
    return model


def _may_enter(n: dict[tuple[int, int], int], odds: float) -> Column:
    """Whether a term's log odds reach `odds` in the whole sample or in a half."""
    log = lambda k, total: F.log((k + 0.5) / (total + 1.0))
    count = lambda y, halves: sum(n.get((h, y), 0) for h in halves)
    c = lambda k, halves: sum((F.col(f"{k}{h}") for h in halves), F.lit(0))
    out = F.lit(False)
    for halves in ((0, 1), (0,), (1,)):
        out = out | (log(c("t", halves), count(1, halves)) - log(c("c", halves), count(0, halves)) >= odds)
    return out


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weight (sum of clause weights) and score (0 to 1) of every whole text. Null and empty texts hold no clause: weight 0. Null and repeated ids stay; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def step(b: dict, f) -> dict:
        total = np.array([f(t) for t in b["text"]], float)
        return {"id": b["id"], "weight": total, "score": model.rates[model.bins(total)]}

    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), step, f"id {kind}, weight double, score double", model.scorer).withColumnRenamed("id", id_col)


def toxicity_report(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
