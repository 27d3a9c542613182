"""Toxicity by weak supervision.

Voters, lexicons and patterns, vote toxic (+1), clean (-1) or abstain (0); a lexicon without a hit abstains, and one voter votes
clean where no lexicon hits. Besides a small seed lexicon there are lexicons mined from labelled training rows: words and word
beginnings a hundred times likelier in toxic documents, in groups of like strength that each make a voter. A generative model
estimates by expectation-maximisation, without labels but for weak prior counts, how voters vote given the hidden class; voters
whose votes the class leaves correlated form cliques with a joint distribution, so dependence is part of the likelihood. Its
posteriors are the labels on which a linear classifier over hashed words and word beginnings is trained; that classifier scores
every text.

Labels are read only for rows outside the held-out fold, from at most `sample_rows` of them (hashed doc_id order), and their texts
are brought to the driver as features of at most `sample_rows` documents. Null and empty texts get the score of a text without
features; without usable labels only the seed lexicon votes; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as W
from siftwell.llm.decontaminate import FOLD

#: General insults, not taken from any labelled table; words of the labelled rows are mined from the training fold.
SEEDS = [s.encode() for s in "fool liar coward creep jerk dumb hate ugly vile filthy".split()]
#: Bits of a hashed feature: enough that long texts don't meet a lexicon by chance.
BITS = 32
FOLDS = 5
PATTERNS = 4


def features(batch: W.Batch) -> list[np.ndarray]:
    """For each text the distinct hashed words and their beginnings of 4 and 5 bytes."""
    n = batch.ends - batch.starts
    ids, doc = [batch.hashes], [np.arange(len(n))]
    for k in (4, 5):
        long = np.flatnonzero(n > k)
        ids.append(W.mix(W.hash_spans(batch.buf, batch.starts[long], batch.starts[long] + k) + W.U(k)))
        doc.append(long)
    ids_all, word = (np.concatenate(ids) >> W.U(64 - BITS)).astype(np.int64), np.concatenate(doc)
    text = np.searchsorted(batch.first, word, "right") - 1
    pairs = np.unique(text << BITS | ids_all)
    bounds = np.searchsorted(pairs, np.arange(len(batch.first) + 1) << BITS)
    return [(pairs[a:b] & ((1 << BITS) - 1)).astype(np.uint32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def patterns(text: bytes) -> list[int]:
    """Votes of the pattern voters: shouting, runs of marks, masked letters, and a long calm text."""
    n = max(len(text), 1)
    capitals = sum(map(text.count, (bytes([b]) for b in range(65, 91))))
    marks = text.count(b"!!") + text.count(b"??")
    masked = text.count(b"*") + text.count(b"#")
    return [1 if n > 40 and capitals > 0.5 * n else 0, 1 if marks > 2 else 0, 1 if masked > 0.02 * n else 0, -1 if n > 4000 and not marks else 0]


def seed_ids() -> np.ndarray:
    batch = W.Batch(SEEDS, W.ALNUM)
    return (batch.hashes >> W.U(64 - BITS)).astype(np.uint32)


@dataclass
class LabelModel:
    """Class prior, and for each clique of dependent voters how its joint votes are distributed by class.

    A clique's joint votes are one number in base 3. Voters of a clique may agree or contradict each other in any way, so that what
    they share is counted once; between cliques votes are independent given the class."""

    prior: float
    cliques: list[list[int]]
    tables: list[np.ndarray]  # class, joint vote
    correlations: np.ndarray  # what the class leaves unexplained, voter by voter

    @staticmethod
    def joint(votes: np.ndarray, clique: list[int]) -> np.ndarray:
        return sum((votes[:, j] + 1) * 3**k for k, j in enumerate(clique))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1. A clique all of whose voters abstain is no evidence: lexicons of other languages are silent."""
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for clique, table in zip(self.cliques, self.tables, strict=True):
            z += (np.log(table[1]) - np.log(table[0]))[self.joint(votes, clique)] * (votes[:, clique] != 0).any(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def accuracies(self) -> np.ndarray:
        """For each voter the share of its votes, not counting abstentions, that name the class they are cast for; null: left out."""
        out = np.full(len(self.correlations), np.nan)
        for clique, table in zip(self.cliques, self.tables, strict=True):
            for k, j in enumerate(clique):
                vote = np.arange(table.shape[1]) // 3**k % 3 - 1
                right = self.prior * table[1][vote > 0].sum() + (1 - self.prior) * table[0][vote < 0].sum()
                cast = self.prior * table[1][vote != 0].sum() + (1 - self.prior) * table[0][vote != 0].sum()
                out[j] = right / cast
        return out


def find_cliques(correlations: np.ndarray, least: float, most: int = 3) -> list[list[int]]:
    """Voters joined by their strongest residual correlations, positive or negative, in cliques of at most `most`."""
    m = len(correlations)
    own = {j: [j] for j in range(m)}
    pairs = sorted(((-abs(correlations[i, j]), i, j) for i in range(m) for j in range(i) if abs(correlations[i, j]) >= least))
    for _, i, j in pairs:
        a, b = own[i], own[j]
        if a is not b and len(a) + len(b) <= most:
            a += b
            for x in b:
                own[x] = a
    return [sorted(c) for j, c in own.items() if j == min(c)]


def fit_label_model(votes: np.ndarray, y: np.ndarray, rounds: int = 40, prior_rows: float = 200.0, least: float = 0.15) -> LabelModel:
    """Expectation-maximisation over all rows without their labels.

    The labels give the class share, and prior counts worth `prior_rows` rows that keep the classes' meaning; what the voters are
    worth, and which depend on each other, comes from how they vote together."""
    n, m = votes.shape
    prior = float(np.clip(y.mean(), 0.02, 0.5))
    weight = min(1.0, prior_rows / max(n, 1))
    # voters that the labelled rows don't find better than chance (twice as often right as wrong) stay out
    rate = [[((votes[y == c] == v).sum(0) + 0.5) / ((y == c).sum() + 1) for v in (-1, 1)] for c in (0, 1)]
    useful = (rate[1][1] >= 2 * rate[0][1]) | (rate[0][0] >= 2 * rate[1][0])
    model = LabelModel(prior, [[j] for j in range(m) if useful[j]], [], np.eye(m))

    def tables(post: np.ndarray | None) -> list[np.ndarray]:
        out = []
        for clique in model.cliques:
            joint, size = model.joint(votes, clique), 3 ** len(clique)
            table = np.full((2, size), 0.5 / size * 3)
            for c in (0, 1):
                table[c] += weight * np.bincount(joint[y == c], minlength=size)
                if post is not None:
                    table[c] += np.bincount(joint, post if c else 1 - post, minlength=size)
            out.append(table / table.sum(1, keepdims=True))
        return out

    model.tables = tables(None)
    post = model.posterior(votes)
    for k in range(rounds):
        if k % 10 == 0:
            x = votes.astype(float)
            mean = np.stack([(1 - post) @ x / max((1 - post).sum(), 1e-9), post @ x / max(post.sum(), 1e-9)])
            r = x - (1 - post)[:, None] * mean[0] - post[:, None] * mean[1]
            sd = np.sqrt((r * r).mean(0)) + 1e-3
            model.correlations = np.clip(r.T @ r / max(n, 1) / np.outer(sd, sd), -1, 1)
            model.cliques = find_cliques(np.where(np.outer(useful, useful), model.correlations, 0), least)
            model.cliques = [c for c in model.cliques if useful[c[0]]]
        model.tables = tables(post)
        new = model.posterior(votes)
        if k % 10 and np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return model


@dataclass
class Model:
    lexicons: list[np.ndarray]
    label_model: LabelModel | None
    ids: np.ndarray  # sorted features with a weight
    weights: np.ndarray
    bias: float

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(docs), self.bias)
        for i, d in enumerate(docs):
            at = np.searchsorted(self.ids, d)
            ok = at < len(self.ids)
            ok[ok] = self.ids[at[ok]] == d[ok]
            z[i] += self.weights[at[ok]].sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, fold: int = 0) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def sample(docs: DataFrame, labels: DataFrame, column: str, train: F.Column, rows: int) -> DataFrame:
    """(label, text) of at most `rows` labelled training documents, chosen by hashed id; the labels broadcast are bounded by it."""
    known = labels.where(train & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("label"))
    n = known.count()
    if n > rows:
        # the rows with the smallest hashes: exactly `rows` of them, whatever the hashes
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("label", "text")


def votes_of(docs: list[np.ndarray], marks: list[list[int]], lexicons: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(docs), len(lexicons) + PATTERNS + 1), np.int64)
    every = np.unique(np.concatenate(lexicons)) if lexicons else np.empty(0, np.uint32)
    for i, d in enumerate(docs):
        hit = d[np.isin(d, every, assume_unique=True)]
        for j, lex in enumerate(lexicons):
            out[i, j] = int(len(hit) and np.isin(hit, lex).any())
        out[i, len(lexicons)] = 0 if len(hit) else -1
        out[i, len(lexicons) + 1 :] = marks[i]
    return out


@dataclass
class Compact:
    """The features of many documents: their names in order, and for each occurrence the place of its name and its document, in 8 bytes."""

    names: np.ndarray
    place: np.ndarray
    row: np.ndarray

    @staticmethod
    def of(docs: list[np.ndarray]) -> Compact:
        flat = np.concatenate(docs) if docs else np.empty(0, np.uint32)
        names = np.unique(flat)
        place = np.empty(len(flat), np.int32)
        for i in range(0, len(flat), 1 << 20):
            place[i : i + (1 << 20)] = np.searchsorted(names, flat[i : i + (1 << 20)])
        return Compact(names, place, np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs]))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each name the sum of its documents' weights."""
        out = np.zeros(len(self.names))
        for i in range(0, len(self.row), 1 << 20):
            out += np.bincount(self.place[i : i + (1 << 20)], weights[self.row[i : i + (1 << 20)]], len(out))
        return out


def mine(docs: Compact, y: np.ndarray, groups: int, least: int = 3) -> list[np.ndarray]:
    """Features a hundred times likelier in toxic documents, strongest first, in groups."""
    if not len(y) or y.min() == y.max():
        return []
    a, b, names = docs.sums(y == 1), docs.sums(y == 0), docs.names
    odds = np.log((a + 0.5) / (y.sum() + 1)) - np.log((b + 0.5) / ((1 - y).sum() + 1))
    n, share = a + b, y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.nan_to_num(a * np.log(a / n / share)) + np.nan_to_num(b * np.log(b / n / (1 - share))))
    found = np.flatnonzero((a >= least) & (odds > np.log(100)) & (gain > 2 * np.log(max((n >= least).sum(), 2)) + 4))  # beyond what chance gives among so many
    found = names[found[np.argsort(-odds[found] * np.sqrt(a[found]), kind="stable")]]
    # voters of like strength, so that the label model can tell the strong from the weak
    return [np.sort(part) for part in np.array_split(found, min(groups, len(found)))] if len(found) else []


def train(rows: list[tuple[np.ndarray, list[int]]], y: np.ndarray, groups: int = 12, epochs: int = 150) -> Model:
    docs, marks = [r[0] for r in rows], [r[1] for r in rows]
    seeds, flat = seed_ids(), Compact.of(docs)
    lexicons = [seeds[k::2] for k in range(2)] + mine(flat, y, groups)
    if not docs:
        return Model(lexicons, None, np.sort(seeds), np.full(len(seeds), 6.0), -3.0)
    votes = votes_of(docs, marks, lexicons)
    model = fit_label_model(votes, y)
    target = model.posterior(votes)
    # the linear classifier: features that part the posteriors beyond chance get a weight
    names = flat.names
    a, n = flat.sums(target), np.bincount(flat.place, minlength=len(names))
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    gain = 2 * (a * np.log((a + 1e-9) / np.maximum(n, 1) / share + 1e-12) + (n - a) * np.log((n - a + 1e-9) / np.maximum(n, 1) / (1 - share) + 1e-12))
    use = np.flatnonzero((n >= 3) & (gain > 2 * np.log(max((n >= 3).sum(), 2))))
    ids = np.union1d(np.concatenate(lexicons), names[use])
    here = np.full(len(names), -1, np.int32)
    known = np.isin(names, ids, assume_unique=True)
    here[known] = np.searchsorted(ids, names[known])
    col = here[flat.place]
    col, row = col[col >= 0], flat.row[col >= 0]
    w, bias, g2, gb2 = np.zeros(len(ids)), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))), np.full(len(ids), 1e-8), 1e-8
    for _ in range(epochs):  # logistic regression by Adagrad over all rows
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], len(docs)), -30, 30)))
        e = p - target
        g, gb = np.bincount(col, e[row], len(ids)) / len(docs) + 2e-5 * w, e.mean()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * gb / np.sqrt(gb2)
    return Model(lexicons, model, ids, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> Model:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = W.utf8(part.column(1))
            feats = []
            for _, _, batch in W.batches([t.translate(FOLD) for t in raw], W.ALNUM):
                feats += [f.astype(np.uint32).tobytes() for f in features(batch)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(feats, pa.binary()), pa.array([patterns(t) for t in raw], pa.list_(pa.int32()))], names=["label", "features", "marks"])

    got = sample(docs, labels, "toxic", ~held_out(), sample_rows).mapInArrow(run, "label int, features binary, marks array<int>").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    return train([(np.frombuffer(r[1], np.uint32), list(r[2])) for r in got], np.array([r[0] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.weights, model.bias))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model([], None, *shared.value)
        for part in parts:
            scores = [m.score(features(batch)) for _, _, batch in W.batches([t.translate(FOLD) for t in W.utf8(part.column(1))], W.ALNUM)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """Returns doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, sample_rows)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = 8000) -> DataFrame:
    """Documents scored below the threshold, columns as they are. The decision is made on the row itself, so doc_id may repeat."""
    model = fit(docs, labels, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.ids, model.weights, model.bias))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model([], None, *shared.value)
        for part in parts:
            scores = [m.score(features(batch)) for _, _, batch in W.batches([t.translate(FOLD) for t in W.utf8(part.column(at))], W.ALNUM)]
            if scores:
                yield part.filter(pa.array(np.concatenate(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)
