"""Toxicity scores from a learned lexicon, with misspellings found by Levenshtein automata.

Learning uses a bounded sample of labelled rows outside the held-out fold (MOST_LABELLED). Words and word
beginnings (stems) that are far likelier in toxic texts make the lexicon; its terms form a trie.

Scoring reads every whole text. A token is a term, begins with a stem, or is a misspelling: a Levenshtein
automaton of the token is intersected with the trie, so that only branches within the allowed distance are
walked; a stem is met by a beginning of the token. All terms and stems of five letters or more, and of nothing but
letters, are targets, but for those that lie among ordinary words: near them the clean texts of the sample have more
than MOST_CLEAN_WORDS different words. Tokens that the sample has in clean texts are no misspellings. For each hit a window of context tells
quotation from abuse: a hit between quotation marks, or next to a word of reporting, counts as quoted. A
logistic model over the counts of the kinds of hits, fitted on the sample, gives the score; the weight of
quoted hits stays near nothing unless the labels say otherwise.

Edge cases: null and empty texts get the score of no hits; unlabelled tables give a constant score; a null
doc_id is not held out; repeated rows get equal scores; an empty table gives an empty result; texts of any length are
read whole; other columns, whatever their names, are not read. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: At most so many labelled rows are learned from, the first in the order of a hash of doc_id.
MOST_LABELLED = 20_000
MIN_TOXIC_TERM, MIN_TOXIC_STEM, MIN_LOG_ODDS, MIN_STEM_LOG_ODDS = 8, 20, 3.0, 2.5
#: A term must be found between so many different pairs of neighbours, so that copies of one text do not make it.
MIN_CONTEXTS = 12
#: A stem stands for so many different words; with fewer, the words themselves are the terms.
MIN_STEM_WORDS = 5
STEM_SIZES = (4, 5, 6, 7, 8)
#: A term or stem near which the clean texts of the sample have more different words is no target of misspelling.
MOST_CLEAN_WORDS = 3
CONTEXT = 6
#: Tokens remembered as no hit by a Python worker.
REMEMBER = 300_000
TOKEN = re.compile(r"[\w@$*]+|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
#: Words of reporting around a quotation.
REPORTING = frozenset("said says say quote quoted quoting quotes called calls wrote writes word words term slur reported allegedly dit a-t-il dijo escribió sagte schrieb zitat".split())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Automaton:
    """Levenshtein automaton of a word: a state is the row of edit distances that are within the limit."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((k, k) for k in range(self.most + 1))

    def step(self, state: tuple[tuple[int, int], ...], char: str) -> tuple[tuple[int, int], ...]:
        new: list[tuple[int, int]] = []
        if state and state[0][0] == 0 and state[0][1] < self.most:
            new.append((0, state[0][1] + 1))
        for j, (at, cost) in enumerate(state):
            if at == len(self.word):
                break
            value = cost + (self.word[at] != char)
            if new and new[-1][0] == at:
                value = min(value, new[-1][1] + 1)
            if j + 1 < len(state) and state[j + 1][0] == at + 1:
                value = min(value, state[j + 1][1] + 1)
            if value <= self.most:
                new.append((at + 1, value))
        return tuple(new)

    def accepts(self, state: tuple[tuple[int, int], ...]) -> bool:
        return bool(state) and state[-1][0] == len(self.word)


def trie_of(terms: list[str], stems: list[str] = ()) -> dict:
    """Nested maps by letter; the end of a term has it under '', the end of a stem under '*'."""
    root: dict = {}
    for mark, words in (("", terms), ("*", stems)):
        for word in words:
            node = root
            for char in word:
                node = node.setdefault(char, {})
            node[mark] = word
    return root


def nears(trie: dict, word: str, most: int) -> Iterator[str]:
    """Terms within the distance of word, and stems (with '*') within their own allowed distance of a beginning of word.

    The trie and the automaton of the word are walked together.
    """
    automaton = Automaton(word, most)
    walk = [(trie, automaton.start())]
    while walk:
        node, state = walk.pop()
        if "" in node and automaton.accepts(state):
            yield node[""]
        if "*" in node and min(cost for _, cost in state) <= allowed(len(node["*"])):
            yield node["*"] + "*"
        for char, child in node.items():
            if len(char) == 1 and char != "*" and (after := automaton.step(state, char)):
                walk.append((child, after))


def near(trie: dict, word: str, most: int) -> str | None:
    return next(nears(trie, word, most), None)


def split(term: str, n: int) -> list[str]:
    return [term[len(term) * k // n : len(term) * (k + 1) // n] for k in range(n)]


def allowed(size: int) -> int:
    return 0 if size < 5 else 1 if size < 9 else 2


@dataclass
class Model:
    terms: frozenset[str]
    stems: frozenset[str]
    clean: frozenset[str] = frozenset()
    #: Terms, and stems with '*', that are no targets of misspelling.
    ordinary: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [-2.0, 0.0, 0.0, 0.0, 0.0])

    def __post_init__(self) -> None:
        terms = sorted(t for t in self.terms if allowed(len(t)) and t.isalpha() and t not in self.ordinary)
        stems = sorted(t for t in self.stems if allowed(len(t)) and t.isalpha() and f"{t}*" not in self.ordinary)
        self.trie = trie_of(terms, stems)
        # A word within distance d of a term, or of a stem by a beginning, holds one of d + 1 pieces of it.
        self.pieces = {p for t in terms for p in split(t, allowed(len(t) + 2) + 1)} | {p for t in stems for p in split(t, allowed(len(t)) + 1)}
        self.piece_sizes = sorted({len(p) for p in self.pieces})
        self.sizes = {len(t) for t in terms}
        self.shortest_stem = min((len(t) - allowed(len(t)) for t in stems), default=1 << 30)
        self.known: dict[str, str] = {}
        self.none: set[str] = set()

    def maybe(self, token: str) -> bool:
        size = len(token)
        if size < self.shortest_stem and not any(size + d in self.sizes for d in (-2, -1, 0, 1, 2)):
            return False
        return any(token[k : k + n] in self.pieces for n in self.piece_sizes for k in range(size - n + 1))

    def kind(self, token: str) -> str:
        """'term', 'stem', 'near' or ''."""
        if token in self.terms:
            return "term"
        if any(token[:k] in self.stems for k in STEM_SIZES):
            return "stem"
        if token not in self.clean and (most := allowed(len(token))) and self.maybe(token) and near(self.trie, token, most):
            return "near"
        return ""

    def counts(self, text: str | None) -> tuple[int, int, int, int]:
        """Hits that are terms, forms of stems, misspelled terms and quotations of any."""
        if not text:
            return 0, 0, 0, 0
        tokens = TOKEN.findall(text.lower())
        fresh = set(tokens) - self.none
        hits = {}
        for token in fresh:
            kind = self.known.get(token)
            if kind is None:
                kind = self.kind(token)
                if kind:
                    self.known[token] = kind
                else:
                    self.none.add(token)
            if kind:
                hits[token] = kind
        if len(self.none) > REMEMBER:
            self.none.clear()
        if not hits:
            return 0, 0, 0, 0
        found = Counter()
        for at, token in enumerate(tokens):
            if token in hits:
                before, after = tokens[max(0, at - CONTEXT) : at], tokens[at + 1 : at + 1 + CONTEXT]
                marks = any(t in QUOTES for t in before) and any(t in QUOTES for t in after)
                reported = any(t in REPORTING for t in before[-2:]) or any(t in REPORTING for t in after[:2])
                found["quoted" if marks or reported else hits[token]] += 1
        return found["term"], found["stem"], found["near"], found["quoted"]

    def features(self, text: str | None) -> list[float]:
        return [1.0, *np.log1p(self.counts(text)).tolist()]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, self.features(text)), -30, 30))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic texts, clean texts) summed over a task; stems end with an asterisk."""
    sums = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            tokens = set(TOKEN.findall((text.as_py() or "").lower()))
            sums[toxic].update(tokens)
            sums[toxic].update({t[:k] + "*" for t in tokens for k in STEM_SIZES if len(t) > k})
    names = list(sums[1].keys() | sums[0].keys())
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([sums[1][n] for n in part], pa.int64()), pa.array([sums[0][n] for n in part], pa.int64())], ["feature", "n_toxic", "n_clean"])


def _contexts(likely: frozenset[str]):
    """(feature, its neighbours, token) for each place of a likely feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column("text"):
                tokens = ["", *TOKEN.findall((text.as_py() or "").lower()), ""]
                for before, token, after in zip(tokens, tokens[1:], tokens[2:], strict=False):
                    found |= {(f, f"{before} {after}", token) for f in (token, *(token[:k] + "*" for k in STEM_SIZES if len(token) > k)) if f in likely}
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1, 2)], ["feature", "context", "token"])

    return run


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """text and toxic of the sample."""
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def lexicon(learned: DataFrame) -> Model:
    """Terms, stems and clean words from a sample; what reaches the driver comes from the sample, which MOST_LABELLED bounds."""
    sums = learned.mapInArrow(_counts, "feature string, n_toxic long, n_clean long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    totals = learned.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = totals["t"], totals["n"] - totals["t"]
    odds = F.log(((F.col("n_toxic") + 0.5) / (toxic + 1)) / ((F.col("n_clean") + 0.5) / (clean + 1)))
    strong = sums.filter((F.col("n_toxic") >= F.when(F.col("feature").endswith("*"), MIN_TOXIC_STEM).otherwise(MIN_TOXIC_TERM)) & (odds > F.when(F.col("feature").endswith("*"), MIN_STEM_LOG_ODDS).otherwise(MIN_LOG_ODDS)))
    likely = frozenset(r["feature"] for r in strong.collect())  # features of the bounded sample
    places = learned.filter("toxic = 1").mapInArrow(_contexts(likely), "feature string, context string, token string").distinct()
    found = places.groupBy("feature").agg(F.countDistinct("context").alias("n"), F.countDistinct("token").alias("words")).filter(F.col("n") >= MIN_CONTEXTS).collect()
    stems: set[str] = set()
    for stem in sorted((r["feature"][:-1] for r in found if r["feature"].endswith("*") and r["words"] >= MIN_STEM_WORDS), key=lambda x: (len(x), x)):
        if not any(stem.startswith(s) for s in stems):
            stems.add(stem)
    terms = (r["feature"] for r in found if not r["feature"].endswith("*"))
    return Model(frozenset(t for t in terms if not any(t.startswith(s) for s in stems)), frozenset(stems))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    from reviewlake.llm._shared import stored

    learned = stored(sample(docs, labels, most), "toxic-sample")
    model = lexicon(learned)

    def near_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, str]] = set()
        for batch in batches:
            for text, half in zip(batch.column("text"), batch.column("half").to_pylist(), strict=True):
                seen |= {(half, t) for t in set(TOKEN.findall((text.as_py() or "").lower())) - model.none if model.kind(t) == "near"}
        found = [(half, token, target) for half, token in sorted(seen) for target in set(nears(model.trie, token, allowed(len(token))))]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))], ["half", "token", "target"])

    # Tokens near a term in clean texts: those of one half are known when the other half is fitted.
    half = F.abs(F.xxhash64("text")) % 2
    rows = learned.filter("toxic = 0").select("text", half.alias("half")).mapInArrow(near_clean, "half long, token string, target string").distinct().collect()  # of the bounded sample
    words = Counter(target for _, target in {(r["token"], r["target"]) for r in rows})
    ordinary = frozenset(t for t, n in words.items() if n > MOST_CLEAN_WORDS)
    clean = [frozenset(r["token"] for r in rows if r["half"] == k) for k in (0, 1)]
    model = Model(model.terms, model.stems, clean[0], ordinary)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in (1, 2, 3, 4)] + [batch.column("toxic")], ["a", "b", "c", "d", "toxic"])

    rows = learned.filter(half == 1).mapInArrow(featured, "a double, b double, c double, d double, toxic int").groupBy("a", "b", "c", "d", "toxic").count().collect()  # at most `most` rows
    rows.sort(key=tuple)
    model = Model(model.terms, model.stems, clean[0] | clean[1], ordinary)
    if rows:
        model.weights = logistic(np.array([[1.0, r["a"], r["b"], r["c"], r["d"]] for r in rows]), np.array([float(r["toxic"]) for r in rows]), np.array([float(r["count"]) for r in rows]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Weights by Newton's method; the ridge holds those of hits near a prior.

    Misspellings and quotations are rare among labelled rows, so theirs are held firmly: a misspelled term
    counts nearly as a term, a quoted one hardly.
    """
    prior = np.array([0.0, 5.0, 2.0, 5.0, 0.0])
    hold = ridge * np.array([0.01, 1.0, 1.0, 100.0, 100.0])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + hold * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the counts of hits, for each row of docs. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [model.counts(t.as_py()) for t in batch.column("text")]
            x = np.column_stack([np.ones(len(counts)), np.log1p(np.array(counts, float).reshape(-1, 4))])
            scores = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4))], ["doc_id", "score", "n_term", "n_stem", "n_near", "n_quoted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_term long, n_stem long, n_near long, n_quoted long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_term", "n_stem", "n_near", "n_quoted")
