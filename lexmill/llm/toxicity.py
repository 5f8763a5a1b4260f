"""Toxicity by a grammar of weighted finite-state transducers over clauses.

Words become symbols: an insult, a threat, a target, a negation, a verb of speech, or any other word. Four transducers
rewrite a clause's symbols one after another: ``negation`` and ``speech`` mark the insults and threats in their reach,
``target`` marks those beside somebody, and ``verdict`` says what each counts: an insult by itself, a threat only if it
has a target, either less if it is denied or reported. Their composition is one transducer, and a clause scores the weight
of its best path. A text's clauses add up, and a logistic curve turns the sum into a score from 0 to 1.

The lexicon is a list of English words and what labelled rows teach: beginnings of words and whole words that toxic
documents have so much oftener than others that chance is no explanation at the number of candidates tried. So it takes
up inflected words of any language. Learning counts in tasks and adds up in Spark; only the candidates that pass reach
the driver, MOST_STEMS at most.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import released, written
from lexmill.llm.quality import logistic

INSULTS = frozenset("idiot idiots moron morons imbecile imbeciles scum loser losers worthless pathetic stupid disgusting bastard bastards bitch bitches asshole assholes dumbass retard retards scumbag vermin".split())
THREATS = frozenset("kill hurt harm destroy stab shoot strangle murder beat burn punish".split())
TARGETS = frozenset("you your yours yourself he she him her his hers they them their these those we us our people everyone everybody anyone".split())
NEGATIONS = frozenset("not never no nobody none neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot".split())
SPEECH = frozenset("said says say saying called calls calling wrote writes written quoted quotes quote claimed claims reported reports alleged".split())
#: Letters of a beginning of a word that may become a stem, stems at most, documents that must have one, times that toxic
#: ones must have it oftener, and the chance that one of all candidates passes by accident.
STEMS, MOST_STEMS, LEAST_DOCS, LEAST_LIFT, ACCIDENT = (4, 8), 2_000, 4, 8.0, 1e-6
WORD, CLAUSE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*"), re.compile(r"[.!?;:\n]+")
#: Other words that a run of them counts as at most; longer runs are out of every reach.
REACH = 4

Arc = tuple[str, float, int]


@dataclass(frozen=True)
class Transducer:
    """States from 0, the start; all may end. Each state has, for an input symbol, arcs (output, weight, next state)."""

    arcs: tuple[dict[str, tuple[Arc, ...]], ...]

    def after(self, other: Transducer) -> Transducer:
        """The composition: this transducer reads what ``other`` writes. Only states that can be reached are built."""
        found, states = {(0, 0): 0}, [(0, 0)]
        arcs: list[dict[str, tuple[Arc, ...]]] = []
        for one, two in states:
            mine: dict[str, tuple[Arc, ...]] = {}
            for symbol, outer in other.arcs[one].items():
                joined = []
                for between, w, to in outer:
                    for out, v, then in self.arcs[two].get(between, ()):
                        if (to, then) not in found:
                            found[to, then] = len(states)
                            states.append((to, then))
                        joined.append((out, w + v, found[to, then]))
                mine[symbol] = tuple(joined)
            arcs.append(mine)
        return Transducer(tuple(arcs))

    def best(self, symbols: Iterable[str]) -> float:
        """The greatest weight of a path that reads the symbols; minus infinity if there is none."""
        held = {0: 0.0}
        for symbol in symbols:
            following: dict[int, float] = {}
            for state, weight in held.items():
                for _, w, to in self.arcs[state].get(symbol, ()):
                    following[to] = max(following.get(to, -np.inf), weight + w)
            held = following
        return max(held.values(), default=-np.inf)


#: Symbols: i, h an insult and a threat, t a target, n a negation, s a verb of speech, w another word; capitals of i and
#: h after a negation or a verb of speech (I, H; of both alike); "+" after one of these: beside a target.
PLAIN = "ihtnsw"


def reach(opens: str, symbols: str, length: int | None) -> Transducer:
    """Raises insults and threats within ``length`` symbols after one of ``opens`` (None: in the rest of the clause)."""
    states = 1 + (length or 1)
    arcs: list[dict[str, tuple[Arc, ...]]] = []
    for state in range(states):
        mine = {}
        for symbol in symbols:
            left = state if length is None else max(0, state - 1)
            out = symbol.upper() if state and symbol in "ih" else symbol
            mine[symbol] = ((out, 0.0, states - 1 if symbol in opens else left),)
        arcs.append(mine)
    return Transducer(tuple(arcs))


def beside(symbols: str) -> Transducer:
    """Marks insults and threats up to REACH words after a target or, by a guess that must come true, before one."""
    before = REACH + 1  # states: 0 free, 1..REACH words left after a target, then words within which one must come
    arcs: list[dict[str, tuple[Arc, ...]]] = []
    for state in range(before + REACH):
        mine: dict[str, list[Arc]] = {s: [] for s in symbols}
        owed = state - before + 1 if state >= before else 0
        for s in symbols:
            left = max(0, state - 1) if not owed else 0
            if s == "t":
                mine[s].append((s, 0.0, REACH))
            elif owed:
                if owed > 1:
                    mine[s].append((f"{s}+" if s in "ihIH" else s, 0.0, state - 1))
            elif s in "ihIH":
                mine[s].append((f"{s}+" if state else s, 0.0, left))
                mine[s].append((f"{s}+", 0.0, before + REACH - 1))
            else:
                mine[s].append((s, 0.0, left))
        arcs.append({s: tuple(a) for s, a in mine.items()})
    return Transducer(tuple(arcs))


#: What each symbol counts.
VERDICTS = {"i": 1.0, "i+": 1.5, "I": 0.5, "I+": 0.75, "h": 0.0, "h+": 1.5, "H": 0.0, "H+": 0.5}


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """The composition of the four transducers. A guess that no target fulfils must end before the clause does, so a clause
    is read with ``end`` after it, which only states that owe nothing pass."""
    marked = PLAIN + "IH"
    verdict = Transducer(({s: ((s, VERDICTS.get(s, 0.0), 0),) for s in (*marked, "i+", "h+", "I+", "H+", "end")},))

    def ended(x: Transducer, free: int) -> Transducer:
        return Transducer(tuple(a | ({"end": (("end", 0.0, 0),)} if state < free else {}) for state, a in enumerate(x.arcs)))

    negation, speech, target = reach("n", PLAIN, REACH), reach("s", marked, None), beside(marked)
    return verdict.after(ended(target, REACH + 1).after(ended(speech, 99).after(ended(negation, 99))))


@lru_cache(maxsize=200_000)
def clause_weight(symbols: str) -> float:
    return grammar().best((*symbols, "end"))


@dataclass(frozen=True)
class ToxicityModel:
    """Stems (a beginning of words, or a whole word with ``$``) that insult, and the curve's offset and slope."""

    stems: tuple[str, ...]
    curve: tuple[float, float] = (0.0, 0.0)

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds what may begin an insult or a threat."""
        machine = ahocorasick.Automaton()
        for stem in {s.rstrip("$") for s in self.stems} | INSULTS | THREATS:
            machine.add_word(stem, len(stem))
        machine.make_automaton()
        return machine

    @cached_property
    def whole(self) -> frozenset[str]:
        return frozenset(s[:-1] for s in self.stems if s.endswith("$")) | INSULTS

    @cached_property
    def beginnings(self) -> tuple[str, ...]:
        return tuple(s for s in self.stems if not s.endswith("$"))

    def symbol(self, word: str) -> str:
        if word in self.whole or word.startswith(self.beginnings):
            return "i"
        return "h" if word in THREATS else "t" if word in TARGETS else "n" if word in NEGATIONS else "s" if word in SPEECH else "w"

    def evidence(self, text: str | None) -> float:
        """The sum of the weights of a text's clauses; those without a possible insult or threat weigh nothing."""
        if not text:
            return 0.0
        low, total, done = text.lower(), 0.0, -1
        for end, length in self.automaton.iter(low):
            begin = end - length + 1
            if end < done or begin and low[begin - 1].isalpha():
                continue
            first = max((m.end() for m in CLAUSE.finditer(low, max(0, begin - 1000), begin)), default=max(0, begin - 1000))
            last = CLAUSE.search(low, end)
            done = min(last.start() if last else len(low), end + 1000)
            total += self.weight(low[first:done])
        return total

    def weight(self, clause: str) -> float:
        """The best path's weight; runs of other words count as REACH + 1 at most. Whole clauses are read in turn up to 1,000
        characters around a match."""
        symbols = "".join(self.symbol(word) for word in WORD.findall(clause))
        return clause_weight(re.sub(f"w{{{REACH + 1},}}", "w" * (REACH + 1), symbols))

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(evidence), -40, 40)))


def candidates(text: str) -> set[str]:
    """Words of a text (with ``$``) and their beginnings."""
    words = set(WORD.findall(text.lower()))
    low, high = STEMS
    return {f"{w}$" for w in words if len(w) >= low - 1} | {w[:n] for w in words for n in range(low, min(high, len(w)) + 1)}


def stems(counts: pd.DataFrame, toxic: int, clean: int, tried: int) -> tuple[str, ...]:
    """The candidates (term, toxic, clean: documents with it) that pass, the strongest first, none within another.

    The strength is twice the logarithm of how much likelier the counts are if toxic documents have the term more often
    (the G statistic); it must exceed what one of ``tried`` candidates reaches by ACCIDENT.
    """
    t, c = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    rate, own, other = (t + c) / (toxic + clean), t / toxic, c / clean

    def likely(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    strength = likely(t, toxic, own) + likely(c, clean, other) - likely(t, toxic, rate) - likely(c, clean, rate)
    lift = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
    good = counts.assign(strength=np.round(strength, 6))[(strength > np.log(max(tried, 1) / ACCIDENT)) & (lift >= LEAST_LIFT)]
    chosen: list[str] = []
    for term in sorted(good.itertuples(), key=lambda r: (-r.strength, -len(r.term), r.term)):
        if not any(term.term.startswith(x) or x.startswith(term.term) for x in chosen):
            chosen.append(term.term)
    return tuple(chosen[:MOST_STEMS])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000) -> ToxicityModel:
    """A model from labelled rows whose crc32 of the id (as text) is not divisible by 5.

    Of each label the first ``per_class`` ids, in the order of a hash of the id, are the sample: this bounds learning at any
    size of the corpus. Rows that repeat an id and label count once, with the least text. Without labelled rows of both
    labels there are only the listed words, and a curve through 1/2 at half an insult.
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    rows = usable.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label"), F.xxhash64(F.lit(11), F.col(id_col)).alias("_order")).distinct()
    first = [rows.filter(F.col("_label") == label).orderBy("_order", "_id").limit(per_class) for label in (0, 1)]
    named = first[0].union(first[1])  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    sample = written(texts.join(F.broadcast(named), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "toxicity-sample")
    sizes = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        released(spark, sample)
        return ToxicityModel((), (-4.0, 10.0))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pd.DataFrame:
            both = list(held[0].keys() | held[1].keys())
            return pd.DataFrame({"term": both, "toxic": [held[1][x] for x in both], "clean": [held[0][x] for x in both]}, columns=["term", "toxic", "clean"])

        for batch in batches:
            for label, clauses in zip(batch["_label"], batch["_clauses"], strict=True):
                held[label].update(set().union(*map(candidates, clauses)))
                if len(held[0]) + len(held[1]) > 400_000:
                    yield out()
                    held.clear()
        yield out()

    # a clause of several documents teaches once, else words of copies would pass for evidence from many documents
    clauses = sample.select("_id", "_label", F.explode(F.split("_text", CLAUSE.pattern)).alias("_clause")).groupBy("_clause").agg(F.min(F.struct("_id", "_label")).alias("_of"))
    owned = clauses.select("_of.*", "_clause").groupBy("_id", "_label").agg(F.collect_list("_clause").alias("_clauses"))  # a document's own
    each = owned.select("_label", "_clauses").mapInPandas(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = written(each.filter(F.col("toxic") + F.col("clean") >= LEAST_DOCS), "toxicity-terms")
    tried = often.count()
    # what could pass at all, the likeliest first
    hopeful = often.filter(F.col("toxic") * (clean + 1) >= LEAST_LIFT / 2 * F.col("clean") * (toxic + 1)).orderBy(F.desc("toxic"), F.asc("clean"), F.asc("term")).limit(20 * MOST_STEMS).toPandas()
    model = ToxicityModel(stems(hopeful, toxic, clean, tried))
    found = np.array([(r.e, r.y) for r in with_evidence(sample, model, "_text").select(F.col("_evidence").alias("e"), F.col("_label").alias("y")).collect()], float)
    released(spark, sample, often)
    share = toxic / (toxic + clean)
    return ToxicityModel(model.stems, logistic(np.log1p(found[:, :1]), found[:, 1], share) if np.ptp(found[:, 0]) else (-4.0, 10.0))


def with_evidence(docs: DataFrame, model: ToxicityModel, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # MOST_STEMS short strings at most

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([held.value.evidence(t) for t in texts], dtype="float64")

    return docs.withColumn("_evidence", evidence(F.col(text_col)))


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``cut`` on); columns of these names are replaced.

    Defined cases: null and empty texts get the score of no evidence; repeated rows get equal scores; an empty table
    gives an empty table.
    """
    exponent = -(F.lit(model.curve[0]) + F.lit(model.curve[1]) * F.log1p("_evidence"))
    score = 1 / (1 + F.exp(F.least(F.greatest(exponent, F.lit(-40.0)), F.lit(40.0))))
    out = with_evidence(docs.drop("score", "predicted"), model, text_col).withColumn("score", score).drop("_evidence")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
