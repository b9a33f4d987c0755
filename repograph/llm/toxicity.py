"""Toxicity by a lexicon trie, Levenshtein automata and the terms' surroundings.

The lexicon (words and productive stems) is learned from labelled rows. Its trie
is intersected with the Levenshtein automata of its terms: states are sets of
(trie node, edits), determinised into one table, so each word takes one
table step for each character, all words of a slice at once. A hit counts
less where it is quoted or reported (quotation marks around it, words of saying
before it) and more where it is addressed to someone; a logistic model turns the sums into a score.

Learning uses a bounded sample of labelled rows (``max_rows``). Of the terms that the sample shows to be
toxic the ``max_terms`` words and stems with the most evidence are kept, as the automaton's table grows with them (60 take
a few MB); ``max_clean`` of the sample's commonest clean words limit how far misspellings reach. All rows are scored, as whole texts.

Defined results: an empty or null text has the score of a text without hits;
with no labels of both kinds there are no terms and the score is the share of label 1
(0 if there are none); rows with equal ids are scored each by itself; a document with several labels counts with each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm import kernel as K

WINDOW = 4
QUOTES = "\"'“”„«»‘’`"
#: Words that report what another says, and words of address, in the corpus' languages.
REPORTING = "said says word words term called quote quoted wrote sagte sagt wort nannte dit mot appelé dijo dice palabra llamó".split()
ADDRESS = "you your you're yourself du dich dein ihr tu toi ton vous votre tú tu usted eres".split()
#: What a hit is worth beside a plain exact one, before learning: exact, fuzzy, quoted.
PRIOR = np.array([3.0, 2.4, 0.5])


@dataclass
class Automaton:
    step: np.ndarray  # states x classes
    value: np.ndarray  # 0: no term; else 1 + edits
    classes: dict[int, int]


def allowed(term: str) -> int:
    """Edits within which a word counts as a misspelling."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


def automaton(words: dict[str, int], stems: list[str]) -> Automaton:
    """Accepts words within the given edits of a term, and stems with any ending."""
    child: list[dict[int, int]] = [{}]
    most, ends, stem_ends = [0], {}, set()

    def add(word: str, edits: int) -> int:
        node = 0
        most[0] = max(most[0], edits)
        for c in map(ord, word):
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
                most.append(0)
            node = child[node][c]
            most[node] = max(most[node], edits)
        return node

    for x, edits in words.items():
        ends[add(x, edits)] = edits
    for x in stems:
        stem_ends.add(add(x, 0))
    classes = {c: k + 1 for k, c in enumerate(sorted({c for n in child for c in n}))}

    def close(states: dict[int, int]) -> frozenset:
        """Letters of a term that the word lacks; of a node only the fewest edits count."""
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            if states.get(node, 9) < e:
                continue
            for nxt in child[node].values():
                if e + 1 <= most[nxt] and e + 1 < states.get(nxt, 9):
                    states[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return frozenset(states.items())

    def after(state: frozenset, c: int) -> frozenset:
        out: dict[int, int] = {}
        for node, e in state:
            for letter, nxt in child[node].items():
                cost = e + (letter != c)
                if cost <= most[nxt] and cost < out.get(nxt, 9):
                    out[nxt] = cost
            if e + 1 <= most[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1
        return close(out)

    dead, begin, hit = frozenset(), close({0: 0}), frozenset({(-1, 0)})
    order, rows = {dead: 0, begin: 1, hit: 2}, []
    todo = [dead, begin, hit]
    while todo:
        nxt = []
        for state in todo:
            row = []
            for c in (-1, *classes):
                to = state if state in (dead, hit) else after(state, c)
                if any(node in stem_ends and e == 0 for node, e in to):
                    to = hit
                if to not in order:
                    order[to] = len(order)
                    nxt.append(to)
                row.append(order[to])
            rows.append(row)
        todo = nxt
    value = []
    for state in order:
        found = [e for node, e in state if node in ends and e <= ends[node]]
        value.append(1 if state == hit else 1 + min(found) if found else 0)
    return Automaton(np.array(rows, np.int32), np.array(value, np.int8), classes)


def run_automaton(a: Automaton, point: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each word: 0, or 1 + edits."""
    # One more than the highest character of a term; all above count as it does, as no term has them.
    table = np.zeros(max(a.classes, default=0) + 2, np.int32)
    for c, k in a.classes.items():
        table[c] = k
    out = np.zeros(len(first), np.int8)
    active, state, at = np.arange(len(first)), np.ones(len(first), np.int32), first.copy()
    while len(active):
        c = point[at]
        state = a.step[state, table[np.minimum(c, len(table) - 1)]]
        at = at + 1
        done = at == last[active]
        out[active[done]] = a.value[state[done]]
        keep = ~done & (state != 0)
        active, state, at = active[keep], state[keep], at[keep]
    return out


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray
    bias: float
    report: np.ndarray = field(default_factory=lambda: hashes(REPORTING))
    address: np.ndarray = field(default_factory=lambda: hashes(ADDRESS))
    words: dict[str, int] = field(default_factory=dict)  # with the edits that count as misspellings
    stems: list[str] = field(default_factory=list)


def hashes(words: list[str]) -> np.ndarray:
    point = np.array([ord(c) for c in "".join(words)], np.uint32)
    at = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    return np.sort(K.range_hash(K.prefix_sums(point), at[:-1], at[1:]))


def features(m: Model, t: K.Texts) -> np.ndarray:
    """Rows x (exact, fuzzy, quoted): logarithms of weighed counts of hits."""
    p = K.points(t)
    w = p.words
    out = np.zeros((len(t), 3))
    if m.automaton is None or not len(w.first):
        return out
    found = run_automaton(m.automaton, p.point, w.first, w.last)
    hit = np.flatnonzero(found)
    if not len(hit):
        return out
    row = np.searchsorted(w.at, hit, "right") - 1
    lo, hi = p.bounds[row], p.bounds[row + 1]
    mark = np.isin(p.original, [ord(c) for c in QUOTES])
    marks = np.concatenate([[0], np.cumsum(mark)])
    a, b = w.first[hit], w.last[hit]
    touching = (marks[a] > marks[np.maximum(lo, a - 1)]) | (marks[np.minimum(hi, b + 1)] > marks[b])
    left = np.maximum(w.at[row], hit - WINDOW)
    right = np.minimum(w.at[row + 1] - 1, hit + WINDOW)
    around = (marks[a] > marks[w.first[left]]) & (marks[w.last[right]] > marks[b])
    saying = np.zeros(len(hit), bool)
    addressed = np.zeros(len(hit), bool)
    for k in range(1, WINDOW + 1):
        before, after = hit - k, hit + k
        ok = before >= w.at[row]
        saying |= ok & np.isin(w.hash[np.maximum(before, 0)], m.report)
        addressed |= ok & np.isin(w.hash[np.maximum(before, 0)], m.address)
        ok = after < w.at[row + 1]
        addressed |= ok & np.isin(w.hash[np.minimum(after, len(w.hash) - 1)], m.address)
    quoted = touching | around | saying
    worth = np.where(addressed, 1.25, 1.0)
    np.add.at(out[:, 0], row[~quoted & (found[hit] == 1)], worth[~quoted & (found[hit] == 1)])
    np.add.at(out[:, 1], row[~quoted & (found[hit] > 1)], worth[~quoted & (found[hit] > 1)])
    np.add.at(out[:, 2], row[quoted], worth[quoted])
    return np.log1p(out)


def lexicon(rows: DataFrame, max_terms: int, max_clean: int) -> tuple[list[str], list[str], list[str]]:
    """Words, stems and words of clean documents from rows (text, toxic), by how far their documents' labels are from chance.

    A stem stands for words that are rarer than itself.
    """
    n0, n1 = (rows.where(F.col("toxic") == x).count() for x in (0, 1))
    if not n0 or not n1:
        return [], [], []
    own = rows.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    per_word = own.select("toxic", F.explode("w").alias("w")).where("length(w) > 2").groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    starts = F.array_distinct(F.flatten(F.transform(F.filter("w", lambda w: F.length(w) > 4), lambda w: F.transform(F.sequence(F.lit(4), F.least(F.lit(8), F.length(w) - 1)), lambda k: w.substr(F.lit(1), k)))))
    per_stem = own.select("toxic", F.explode(starts).alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = n1 / (n0 + n1)
    # Among many words some stand out by chance: the more there are, the more evidence each needs.
    often = per_word.where("a + b >= 3").count()
    evidence = 2 * F.col("a") * F.log(F.col("a") / (F.col("a") + F.col("b")) / F.lit(share))
    good = (F.col("a") >= 3) & (F.col("a") * F.lit(1 - share) >= 9 * F.col("b") * F.lit(share)) & (evidence > 2 * float(np.log(often + 1)) + 6)
    rank = F.desc(F.col("a") * F.log((F.col("a") + 0.5) / (F.col("b") + 0.5)))
    found = [(r["w"], r["a"]) for r in per_word.where(good).orderBy(rank, "w").limit(20 * max_terms).collect()]
    stems: list[str] = []
    for r in per_stem.where(good & (F.col("a") >= 5)).orderBy(F.length("w"), rank, "w").limit(20 * max_terms).collect():
        covered = max((a for w, a in found if w.startswith(r["w"])), default=0)
        if covered and r["a"] >= 1.5 * covered and not any(r["w"].startswith(s) for s in stems):
            stems.append(r["w"])
    words = [w for w, _ in found if not any(w.startswith(s) for s in stems)][:max_terms]
    clean = [r["w"] for r in per_word.where("b > 0").orderBy(F.desc("b"), "w").limit(max_clean).select("w").collect()]
    return words, stems[:max_terms], clean


def edits_for(words: list[str], clean: list[str]) -> dict[str, int]:
    """Per term, the most edits up to :func:`allowed` at which no clean word is taken for it."""
    point = np.array([ord(c) for c in "".join(clean)], np.uint32)
    at = np.concatenate([[0], np.cumsum([len(x) for x in clean], dtype=np.int64)]).astype(np.int64)
    out = {}
    for x in words:
        reached = run_automaton(automaton({x: allowed(x)}, []), point, at[:-1], at[1:]) if allowed(x) and clean else np.zeros(1)
        near = reached[reached > 1]
        out[x] = allowed(x) if not len(near) else max(0, int(near.min()) - 2)
    return out


def fit(labelled: DataFrame, max_rows: int = 4000, max_terms: int = 60, max_clean: int = 20_000, report: list[str] = REPORTING, address: list[str] = ADDRESS) -> Model:
    """Of rows (doc_id, text, toxic 0/1); rows without text or label take no part. ``report`` and ``address``: words of saying and of address."""
    with K.scratch():
        return _fit(K.stored(K.sampled(labelled.where("text is not null and toxic in (0, 1)"), ["doc_id", "text"], max_rows).select("text", F.col("toxic").cast("int").alias("toxic"))), max_terms, max_clean, report, address)


def _fit(rows: DataFrame, max_terms: int, max_clean: int, report: list[str], address: list[str]) -> Model:
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    share = (n1 + 0.5) / (n + 1) if n else 0.0
    words, stems, clean = lexicon(rows, max_terms, max_clean)
    if not words and not stems:
        return Model(None, np.zeros(3), float(np.log(share / (1 - share))) if share else -30.0)
    bias = 0.0
    edits = edits_for(words, clean)
    m = Model(automaton(edits, stems), PRIOR, bias, hashes(report), hashes(address), edits, stems)
    sent = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in K.slices(batches, "text"):
            x = features(sent.value, t)
            yield pa.RecordBatch.from_arrays([t.keys.column(0), *(pa.array(x[:, k]) for k in range(3))], names=["toxic", "a", "b", "c"])

    got = rows.mapInArrow(run, "toxic int, a double, b double, c double").groupBy("toxic", "a", "b", "c").count().toPandas()
    seen = got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy(), got["count"].to_numpy()
    # Misspelled and quoted hits are rare: without evidence of their own they are worth their share of an exact one.
    exact = logistic(*seen, PRIOR)[0][0]
    m.weights, m.bias = logistic(*seen, exact * PRIOR / PRIOR[0])
    return m


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, strength: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights that are not negative, drawn to ``prior``; Newton's method with a fixed number of steps."""
    x = np.column_stack([x, np.ones(len(x))])
    at, center, pull = np.concatenate([prior, [-3.0]]), np.concatenate([prior, [0.0]]), np.array([*[strength] * len(prior), 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (n * (p - y)) + pull * (at - center)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        at = at - np.clip(np.linalg.solve(hess, grad), -1, 1)
        at[:-1] = np.maximum(at[:-1], 0)
    return at[:-1], float(at[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Of (doc_id, text): doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for t in K.slices(batches, "text"):
            z = features(m, t) @ m.weights + m.bias
            yield pa.RecordBatch.from_arrays([t.keys.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
