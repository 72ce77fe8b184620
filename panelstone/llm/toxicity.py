"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into classes: insults (with weights learned from labels), threats, targets, negations, verbs of
reporting, others. Three small transducers then run over the classes of a clause: negation turns an insult shortly after a negator
into a denied one, reporting turns what follows a verb of speech into a quoted one, targeting raises what stands with a person
addressed. Their composition is one deterministic machine; what it writes for each clause is summed by class, and a logistic
regression over these sums gives the score. Words outside a matched clause count for nothing.

Learning: words and word beginnings that occur in toxic texts more often than chance allows among all that were tried, on a bounded
sample of labelled rows (``TRAIN_ROWS``, chosen by a hash of the id), and the regression on the same sample, drawn towards its
defaults. Scoring is one pass over whole texts; a text without a word of the grammar is only searched, by one automaton.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstone.llm.common import arrow_map, pick, staged

TRAIN_ROWS, CANDIDATES, LEXICON = 20_000, 20_000, 500
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")

SEED_INSULTS = {w: 3.0 for w in ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting", "trash", "imbecile", "bastard")}
THREATS = frozenset("kill hurt destroy murder stab shoot strangle töten umbringen schlagen tuer frapper étrangler matar golpear destruir".split())
TARGETS = frozenset("you your youre he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils elles usted ustedes ellos ellas".split())
NEGATORS = frozenset("not never isnt arent nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says wrote claimed called quoted sagte schrieb nannte dit écrivit appelle dijo escribió llamó".split())

# Transducers: (state, class read) -> (next state, class written); what is not listed keeps the class and follows the default.
REACH = 3  # words a negation reaches over
NEGATION = {("open", "N"): ("neg1", "O")} | {(f"neg{k}", "N"): ("neg1", "O") for k in range(1, REACH + 1)}
NEGATION |= {(f"neg{k}", c): (f"neg{k + 1}" if k < REACH else "open", c + "-") for k in range(1, REACH + 1) for c in "IT"}
NEGATION |= {(f"neg{k}", c): (f"neg{k + 1}" if k < REACH else "open", c) for k in range(1, REACH + 1) for c in "YRO"}
REPORTING = {("own", "R"): ("told", "O")} | {("told", c): ("told", c + '"') for c in ("I", "T")}
TARGETING = {("far", "Y"): ("near", "Y")}
STARTS = ("open", "own", "far")

FEATURES = ("plain", "targeted", "denied", "quoted", "threat", "strongest", "clauses", "density")
DEFAULT = np.array([2.0, 1.0, 0.5, 0.5, 2.0, 1.0, 0.5, 0.5, -4.0])


@dataclass(frozen=True)
class Model:
    """``terms``: (word or beginning, is it whole, weight); ``weights``: of the features, and the constant."""

    terms: tuple[tuple[str, bool, float], ...]
    weights: tuple[float, ...]


class Grammar:
    def __init__(self, terms: tuple[tuple[str, bool, float], ...]):
        import ahocorasick

        self.whole = {t: w for t, whole, w in terms if whole}
        self.begins = {t: w for t, whole, w in terms if not whole}
        self.search = ahocorasick.Automaton()
        for t in {*self.whole, *self.begins, *THREATS}:
            self.search.add_word(t, (len(t), t in self.begins))
        self.search.make_automaton()
        self.steps: dict[tuple, tuple] = {}

    def word_class(self, word: str) -> tuple[str, float]:
        if (w := self.whole.get(word)) is not None:
            return "I", w
        for k in PREFIXES:
            if (w := self.begins.get(word[:k])) is not None and len(word) >= k:
                return "I", w
        for name, words in (("T", THREATS), ("Y", TARGETS), ("N", NEGATORS), ("R", REPORTS)):
            if word in words:
                return name, 1.0
        return "O", 0.0

    def step(self, state: tuple[str, str, str], read: str) -> tuple[tuple[str, str, str], str]:
        """One move of the composed machine, worked out once."""
        known = self.steps.get((state, read))
        if known is None:
            neg, out = NEGATION.get((state[0], read), (state[0], read))
            told, out = REPORTING.get((state[1], out), (state[1], out))
            near, out = TARGETING.get((state[2], out), (state[2], out))
            known = self.steps[state, read] = ((neg, told, near), out)
        return known

    def clause(self, text: str) -> tuple[list[float], float]:
        """Sums by feature of one clause, and its score."""
        state, sums = STARTS, [0.0] * 5
        for m in WORD.finditer(text):
            name, weight = self.word_class(m.group())
            state, out = self.step(state, name)
            if out[0] == "I":
                sums[2 if out == "I-" else 3 if out.endswith('"') else 0] += weight
            elif out == "T":
                sums[4] += weight
        near = state[2] == "near"
        sums[1] = sums[0] if near else 0.0
        sums[4] = sums[4] if near else 0.0  # a threat needs someone threatened
        return sums, sums[0] + 0.5 * sums[1] + 2 * sums[4] + 0.25 * (sums[2] + sums[3])

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        places = []
        for end, (length, begins) in self.search.iter(low):
            start = end - length + 1
            if (start == 0 or not low[start - 1].isalpha()) and (begins or end + 1 == len(low) or not low[end + 1].isalpha()):
                places.append(start)
        total, best, matched, density = [0.0] * 5, 0.0, 0, 0.0
        if places:
            ends = [-1, *[m.start() for m in CLAUSE_END.finditer(low)], len(low)]
            at = np.unique(np.searchsorted(ends, places, side="right"))
            for i in at:
                sums, score = self.clause(low[ends[i - 1] + 1 : ends[i]])
                total = [x + y for x, y in zip(total, sums, strict=True)]
                best, matched = max(best, score), matched + (score > 0)
            density = 1000 * matched / len(low)
        return [*map(math.log1p, total), math.log1p(best), math.log1p(matched), math.log1p(density)]


@lru_cache(maxsize=4)
def grammar(terms: tuple[tuple[str, bool, float], ...]) -> Grammar:
    return Grammar(terms)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_terms(text: str | None) -> set[tuple[str, bool]]:
    """Words, and beginnings that occur at least twice: one word that happens to begin so says little."""
    words = WORD.findall((text or "").lower())
    begins = Counter(word[:k] for word in words for k in PREFIXES if len(word) >= k)
    return {(w, True) for w in words} | {(b, False) for b, n in begins.items() if n > 1}


def count_terms(sample: DataFrame, among: frozenset | None) -> DataFrame:
    """In how many texts each word or beginning occurs (only those ``among``, if given)."""

    def work(cols):
        n = Counter()
        for text in cols["text"]:
            n.update(text_terms(text) if among is None else text_terms(text) & among)
        return {"term": [t for t, _ in n], "whole": [w for _, w in n], "n": list(n.values())}

    return arrow_map(sample.select("text"), work, "term string, whole boolean, n long").groupBy("term", "whole").agg(F.sum("n").alias("n"))


def learn_terms(sample: DataFrame) -> tuple[tuple[str, bool, float], ...]:
    """Terms of toxic texts beyond chance: with share ``r`` of toxic rows, a term in ``s`` toxic and ``g`` other texts has probability
    about ``C(s+g, g) * r^s``, and this times the number of terms as frequent must stay below 0.05."""
    toxic, total = sample.where("toxic").count(), sample.count()
    if not toxic or toxic == total:
        return ()
    top = count_terms(sample.where("toxic"), None).where(F.col("n") >= 3).orderBy(F.desc("n"), "term", "whole").limit(CANDIDATES).collect()
    seen = {(r["term"], r["whole"]): r["n"] for r in top}
    other = {(r["term"], r["whole"]): r["n"] for r in count_terms(sample.where(~F.col("toxic")), frozenset(seen)).collect()}
    share, sizes = toxic / total, np.sort(np.array(list(seen.values())))
    good = {}
    for t, s in seen.items():
        g = other.get(t, 0)
        tried = len(sizes) - int(np.searchsorted(sizes, s))
        chance = math.lgamma(s + g + 1) - math.lgamma(s + 1) - math.lgamma(g + 1) + s * math.log(share) + math.log(max(1, tried))
        if chance < math.log(0.05) and s >= (9 if t[1] else 4) * g:
            good[t] = (s, math.log((s + 0.5) / (toxic + 1)) - math.log((g + 0.5) / (total - toxic + 1)))
    kept = {}
    for (t, whole), (s, weight) in sorted(good.items(), key=lambda x: (not x[0][1], len(x[0][0]), x[0][0])):
        if whole:
            # A whole word is dropped for a beginning only if that occurs in clearly more texts.
            if all(good.get((t[:k], False), (0, 0))[0] < 1.2 * s for k in PREFIXES if len(t) >= k):
                kept[t, whole] = (s, weight)
        elif not any((t[:k], False) in kept for k in PREFIXES if k < len(t)):
            longer = [x for x in good if not x[1] and len(x[0]) > len(t) and x[0].startswith(t) and good[x][0] >= 0.95 * s]
            words = [x for x in good if x[1] and x[0].startswith(t) and good[x][0] * 1.2 > s]
            if not longer and not words:
                kept[t, whole] = (s, weight)
    ranked = sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:LEXICON]
    return tuple((t, whole, round(weight, 6)) for (t, whole), (_, weight) in ranked)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards the defaults."""
    x = np.column_stack([x, np.ones(len(x))])
    w = DEFAULT.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - DEFAULT)
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - change / max(1.0, float(np.abs(change).max()))
        if np.abs(change).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled texts that are not held out. Without labels the defaults stay."""
    marks = pick(labels, doc_id=id_col, toxic=label_col).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The marks are bounded by ``rows``; a repeated document adds the same text again.
    sample = staged(pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(marks), "doc_id").dropDuplicates(["doc_id", "toxic"]).select("text", "toxic"))
    learned = learn_terms(sample)
    have = {t for t, whole, _ in learned if whole}
    terms = learned + tuple((t, True, w) for t, w in SEED_INSULTS.items() if t not in have)

    def work(cols):
        own = grammar(terms)
        x = np.array([own.features(t) for t in cols["text"]]).reshape(-1, len(FEATURES))
        return {f: x[:, i] for i, f in enumerate(FEATURES)} | {"toxic": cols["toxic"]}

    told = arrow_map(sample, work, ", ".join(f"{f} double" for f in FEATURES) + ", toxic boolean").collect()  # at most ``rows`` short rows
    table = np.array([[*[r[f] for f in FEATURES], float(r["toxic"])] for r in told]).reshape(-1, len(FEATURES) + 1)
    table = table[np.lexsort(table.T)]  # the order rows arrive in must not decide the last digits
    weights = fit_weights(table[:, :-1], table[:, -1]) if len(table) else DEFAULT
    return Model(terms, tuple(float(x) for x in np.round(weights, 9)))


def text_score(model: Model, text: str | None) -> float:
    z = sum(w * x for w, x in zip(model.weights, [*grammar(model.terms).features(text), 1.0], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    A null or empty text has the score of a text without matches. Rows are independent: repeated rows repeat their results, a null id
    stays null and is not held out, an empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("held_out", held_out(F.col("doc_id")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(cols):
        scores = [text_score(model, t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": scores, "predicted": [int(x >= threshold) for x in scores]}

    return arrow_map(rows, work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df``, all columns, without the rows whose text scores ``threshold`` or more.

    A null or empty text is judged as one without matches. Repeated rows are judged alike, an empty table stays empty.
    """
    names = df.columns

    def work(cols):
        keep = [text_score(model, t) < threshold for t in cols[text_col]]
        return {x: [v for v, k in zip(cols[x], keep, strict=True) if k] for x in names}

    return arrow_map(df, work, df.schema)
