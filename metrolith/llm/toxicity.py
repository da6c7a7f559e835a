"""Toxicity by weak supervision: voters, a generative label model over them, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrolith.io import stored
from metrolith.llm.text import by_size, lean

WORD = re.compile(r"[^\W\d_]+")
#: Voters that need no labels: common insults, and patterns over the lower-cased text.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless", "scum", "trash", "garbage", "clown",
    "disgusting", "jerk", "fool", "imbecile", "coward", "liar", "freak", "creep", "pig", "vermin", "filth", "hate", "hateful",
)
PATTERNS = (r"\bshut up\b", r"\bget lost\b", r"\byou(?:'re| are) (?:a|an|so|such)\b", r"\bgo to hell\b", r"!{3,}", r"\bi hate\b")
#: For each pattern a text without which it can't match.
NEEDED = ("shut up", "get lost", "you", "go to hell", "!!!", "i hate")
#: Beginnings of words that can become voters, by length; 0 stands for whole words.
STEMS = (0, 3, 4, 5, 6, 7, 8)
SHORTEST = STEMS[1]
#: A beginning of words is dense in a text with so many hits, and so large a share of its tokens.
LEAST_HITS, LEAST_SHARE = 2, 0.008
#: The most labelled rows that are learned from, and the most voters found in them.
MOST_ROWS, MOST_VOTERS = 8000, 160
#: Features of toxic rows that are looked at, the commonest first.
MOST_CANDIDATES = 40_000
#: How much a row without a label counts for the classifier, beside one with a label.
UNLABELLED_COUNT = 0.1


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str | None) -> tuple[dict[str, int], int]:
    """How often each word stands in a text, lower-cased (words are runs of letters), and the number of its tokens."""
    tokens = (text or "").lower().split()
    out: dict[str, int] = {}
    for token, n in Counter(tokens).items():
        for word in (token,) if token.isalpha() else WORD.findall(token):
            out[word] = out.get(word, 0) + n
    return out, len(tokens)


def is_dense(hits: int, tokens: int) -> bool:
    """Beginnings of words can meet clean words by chance, now and then: they speak only where they crowd."""
    return hits >= LEAST_HITS and hits >= LEAST_SHARE * tokens


def features_of(words: dict[str, int], tokens: int) -> set[str]:
    """Words, and beginnings of longer words, with a dash behind, that are dense in the text."""
    out = set(words)
    for n in STEMS[1:]:
        hits: dict[str, int] = {}
        for w, c in words.items():
            if len(w) > n:
                hits[w[:n]] = hits.get(w[:n], 0) + c
        out.update([f"{b}-" for b, c in hits.items() if is_dense(c, tokens)])
    return out


@dataclass(frozen=True)
class Voters:
    """What the classifier looks at: words, stems by length, and patterns; each has a column of the votes."""

    words: dict[str, int]
    stems: dict[int, dict[str, int]]
    patterns: tuple[str, ...]
    names: tuple[str, ...]
    openings: frozenset[str]

    @staticmethod
    def of(features: list[str]) -> Voters:
        names = [*dict.fromkeys([*LEXICON, *features]), *PATTERNS]
        at = {n: i for i, n in enumerate(names[: len(names) - len(PATTERNS)])}
        stems = {n: {f[:-1]: i for f, i in at.items() if f.endswith("-") and len(f) == n + 1} for n in STEMS[1:]}
        openings = frozenset(s[:SHORTEST] for of in stems.values() for s in of)
        return Voters({f: i for f, i in at.items() if not f.endswith("-")}, stems, PATTERNS, tuple(names), openings)

    def counts(self, text: str | None) -> np.ndarray:
        """For each voter, how many words (or how many matches) of a whole text speak for it."""
        words, tokens = words_of(text)
        out = np.zeros(len(self.names), np.float32)
        for w in words.keys() & self.words.keys():
            out[self.words[w]] = words[w]
        begun = [w for w in words if w[:SHORTEST] in self.openings]
        for n, at in self.stems.items():
            hits: dict[int, int] = {}
            if at:
                for w in begun:
                    i = at.get(w[:n])
                    if i is not None and len(w) > n:
                        hits[i] = hits.get(i, 0) + words[w]
            for i, c in hits.items():
                if is_dense(c, tokens):
                    out[i] = c
        lowered = (text or "").lower()
        base = len(self.names) - len(self.patterns)
        for k, p in enumerate(self.patterns):
            if NEEDED[k] in lowered:
                out[base + k] = len(re.findall(p, lowered))
        return out


@dataclass(frozen=True)
class LabelModel:
    """For each voter, how often it speaks for toxic and for clean texts; and how much correlation takes from its say."""

    prior: float
    on_toxic: np.ndarray
    on_clean: np.ndarray
    correlation: np.ndarray
    say: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.on_toxic / self.on_clean), np.log((1 - self.on_toxic) / (1 - self.on_clean))
        return np.log(self.prior / (1 - self.prior)) + votes @ (self.say * (yes - no)) + (self.say * no).sum()


def fit_label_model(votes: np.ndarray, given: np.ndarray, trust: float = 0.999, rounds: int = 12) -> tuple[LabelModel, np.ndarray]:
    """The model and the posterior of each row, by expectation maximisation.

    Votes are 0 or 1; `given` is 1, 0, or -1 where no label is known, and counts as one more vote of accuracy `trust`.
    Voters are taken to be independent given the label, except that a voter's say is divided by one plus the sum of the
    squares of its positive correlations, given the label, with the others: copies of one voter count about once.
    """
    n, m = votes.shape
    evidence = np.where(given == 1, 1.0, np.where(given == 0, -1.0, 0.0)) * np.log(trust / (1 - trust))
    start = np.where(given >= 0, evidence, np.where(votes.any(1), 1.0, -1.0))
    q = 1 / (1 + np.exp(-start))
    for _ in range(rounds):
        p, c = q.sum(), (1 - q).sum()
        prior = float(np.clip((p + 1) / (n + 4), 1e-3, 0.5))
        on_toxic = (q @ votes + 0.2) / (p + 2)
        on_clean = ((1 - q) @ votes + 0.02) / (c + 2)
        on_toxic, on_clean = np.clip(on_toxic, 1e-5, 1 - 1e-5), np.clip(on_clean, 1e-5, 1 - 1e-5)
        rest = votes - q[:, None] * on_toxic - (1 - q)[:, None] * on_clean
        spread = np.sqrt(np.maximum((rest**2).mean(0), 1e-9))
        correlation = (rest.T @ rest) / n / spread[:, None] / spread[None, :]
        np.fill_diagonal(correlation, 0)
        say = 1 / (1 + (np.clip(correlation, 0, 1) ** 2).sum(1))
        model = LabelModel(prior, on_toxic, on_clean, correlation, say)
        q = 1 / (1 + np.exp(-np.clip(model.log_odds(votes) + evidence, -30, 30)))
    return model, q


@dataclass(frozen=True)
class Classifier:
    """A linear model over the logarithms of the voters' counts."""

    voters: Voters
    weights: np.ndarray
    bias: float
    model: LabelModel | None

    def score(self, text: str | None) -> float:
        x = np.log1p(self.voters.counts(text))
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))))


def fit_classifier(x: np.ndarray, q: np.ndarray, count: np.ndarray | None = None, penalty: float = 0.05, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton's method with an L2 penalty on the weights; a row counts `count` times."""
    count = np.ones(len(x)) if count is None else count
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (count * (p - q)) + ridge * w
        h = (x * (count * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, most: int) -> list[str]:
    """Features that speak for toxic texts: by log-likelihood ratio, and only where few clean texts have them."""
    def ratio(a: int, b: int) -> float:
        rate = (a + b) / (n_toxic + n_clean)
        side = lambda k, n, r: k * np.log(max(k, 1e-9) / (n * r)) + (n - k) * np.log(max(n - k, 1e-9) / (n * (1 - r)))
        return side(a, n_toxic, rate) + side(b, n_clean, rate) if 0 < rate < 1 else 0.0

    scored = []
    for f, a in toxic.items():
        b = clean.get(f, 0)
        if a / n_toxic > 20 * b / max(n_clean, 1):
            scored.append((ratio(a, b), f))
    floor = np.log(len(toxic) + 1) + 4  # many candidates: what chance alone would bring stays out
    return [f for s, f in sorted(scored, key=lambda x: (-x[0], x[1]))[:most] if s >= floor]


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_voters: int = MOST_VOTERS,
          doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Classifier:
    """Learn from at most `most_rows` labelled rows that aren't held out, those of the smallest id hashes, and from as
    many rows without a label.

    Voters are the lexicon, the patterns, and the words and beginnings of words that set the toxic labelled rows apart
    (of the MOST_CANDIDATES commonest in them, MOST_VOTERS at most). The label model is fitted on the votes of all these
    rows; a known label is one more voter, so rows without one have their posteriors from the other voters alone. The
    classifier learns from the posteriors and sees texts alone. Repeated labels of an id count once, the higher; null
    labels and ids count as no label. Without labelled rows of both kinds, voters of the lexicon and the patterns have
    equal weights.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(toxic).alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max(F.when(F.col("y") == 1, 1).otherwise(0)).alias("y"))
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    first = lambda ids: ids.where(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rest = first(d.select("id").distinct().join(known, "id", "left_anti")).withColumn("y", F.lit(-1))
    # The sample's ids are bounded by twice most_rows, so they can be broadcast.
    sample = stored(d.join(F.broadcast(first(known).union(rest)), "id").select("id", "y", "text"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        voters = Voters.of([])
        return Classifier(voters, np.full(len(voters.names), 2.0), -3.0, None)

    def counted(rows: DataFrame, only: frozenset[str] | None, least: int) -> dict[str, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for whole in batches for b in by_size(whole, 0, 1 << 18)):
                seen: Counter[str] = Counter()
                for t in batch.column(0).to_pylist():
                    found = features_of(*words_of(t))
                    seen.update(found if only is None else found & only)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])

        n = rows.select("text").mapInArrow(lean(run), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        return {r["f"]: r["n"] for r in n.orderBy(F.desc("n"), "f").limit(MOST_CANDIDATES).collect()}

    in_toxic = counted(sample.where("y = 1"), None, max(3, n_toxic // 100))
    in_clean = counted(sample.where("y = 0"), frozenset(in_toxic), 1)
    voters = Voters.of(_choose(in_toxic, in_clean, n_toxic, n_clean, most_voters))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 2)):
            counts = [voters.counts(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(counts, pa.list_(pa.float32()))], names=["id", "y", "counts"])

    rows = sample.mapInArrow(lean(votes), "id long, y int, counts array<float>").orderBy("id").toArrow().combine_chunks()
    counts = np.asarray(rows.column("counts").combine_chunks().flatten()).reshape(-1, len(voters.names)).astype(np.float64)
    given = np.asarray(rows.column("y")).astype(int)
    model, q = fit_label_model((counts > 0).astype(np.float64), given)
    weights, bias = fit_classifier(np.log1p(counts), q, np.where(given < 0, UNLABELLED_COUNT, 1.0))
    return Classifier(voters, weights, bias, model)


def score_documents(docs: DataFrame, classifier: Classifier, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; whole texts are read.

    Null texts count as empty, and empty texts have the score of no votes. Null doc_ids keep their rows and are not held
    out. Repeated rows are scored alike. Empty tables give empty results; other columns are never looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, 1)):
            scores = [classifier.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.mapInArrow(lean(run), "doc_id long, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, classifier: Classifier, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose text scores below the threshold."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in by_size(whole, at)):
            yield batch.filter(pa.array([classifier.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
