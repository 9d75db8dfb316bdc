"""Mixing sources to target weights, with soft membership.

A naive Bayes classifier of the labelled table (tokens in hashed places, and the label itself as one
more feature) gives each document a posterior over the sources, its membership. How much the tokens
count is fitted on records that the table of counts did not see. Nonnegative document rates, at most
the repeats that the document's source allows, are fitted by projected gradient least squares, so
that the expected tokens of every domain meet the targets. The last steps take the labels for the
membership: they move what the posteriors leave between expected and labelled totals, and show which
sources stay short with every document at its cap. Rates become whole repeats by a hash.

Documents of one source and (rounded) membership have one rate, so the steps work on the sums of
such cells and the documents are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.tokens import Encoder, encoder
from slotline.session import ensure_checkpoint_dir

TRAINING_DOCUMENTS = 2000  # bound of the labelled sample
MAX_SOURCES = 1000
PLACES = 8192  # of hashed tokens
TOKEN_WEIGHTS = (0.0, 0.03, 0.1, 0.3, 1.0)
GRAIN = 64  # memberships are kept in parts of this
SOFT_STEPS, LABEL_STEPS = 40, 60
SOFT_RESIDUAL, LABEL_RESIDUAL = 1e-4, 1e-9  # of all tokens, at which the steps stop


def _evidence(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What a text's tokens say for each source: log probabilities over the root of their number, as tokens of a text depend on each other."""
    return table[ids % len(table)].sum(0, dtype=np.float64) / np.sqrt(len(ids)) if len(ids) else np.zeros(table.shape[1])


def _posterior(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


class Membership:
    """The classifier: log probabilities of hashed tokens, prior and label odds, and the weight of the tokens.

    ``held_out``: accuracy of the tokens alone on unseen records, that of always naming the commonest source, and the records.
    """

    def __init__(self, tokens: np.ndarray, prior: np.ndarray, labels: np.ndarray, weight: float, held_out: tuple[float, float, int]) -> None:
        self.tokens, self.prior, self.labels, self.weight, self.held_out = tokens, prior, labels, weight, held_out

    @classmethod
    def fit(cls, documents: DataFrame, sources: list[str], code: Encoder, most: int) -> Membership:
        """From the counts of all documents of ``sources`` and about ``most`` of their texts, those of least hash."""
        k, place = len(sources), {s: i for i, s in enumerate(sources)}
        if not k:
            return cls(np.zeros((PLACES, 0), np.float32), np.zeros(0), np.zeros(0), 0.0, (0.0, 0.0, 0))
        labelled = documents.filter(F.col("source").isin(sources))
        n = np.zeros(k)
        for r in labelled.groupBy("source").count().collect():  # one row per target source
            n[place[r[0]]] = r[1]
        fine = 1 << 40
        at = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(fine))
        chosen = labelled.filter(at < int(min(1.0, most / max(1.0, n.sum())) * fine) + 1).orderBy(at).limit(2 * most)
        coded = code.encode(chosen).select("source", "ids", (F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(2)) == 0).alias("seen")).checkpoint()
        pairs = coded.filter("seen").select("source", F.explode("ids").alias("token")).groupBy("source", (F.col("token") % PLACES).alias("at")).count().collect()  # at most the sample's tokens
        table = np.full((PLACES, k), 0.5)
        for r in pairs:
            table[r["at"], place[r["source"]]] += r["count"]
        tokens = np.log(table / table.sum(0)).astype(np.float32)

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"label": f.source.map(place), "z": [_evidence(tokens, ids) for ids in f.ids]})

        unseen = coded.filter("not seen and size(ids) > 0").mapInPandas(score, "label bigint, z array<double>").collect()  # at most the sample
        prior = np.log((n + 0.5) / (n.sum() + 0.5 * k))
        own, z = np.array([r.label for r in unseen], np.int64), np.array([r.z for r in unseen], float).reshape(-1, k)
        fit = [np.log(np.maximum(_posterior(prior + w * z)[np.arange(len(own)), own], 1e-12)).sum() for w in TOKEN_WEIGHTS]
        weight = TOKEN_WEIGHTS[int(np.argmax(fit))]
        right = float((np.argmax(prior + max(weight, TOKEN_WEIGHTS[1]) * z, 1) == own).mean()) if len(own) else 0.0
        return cls(tokens, prior, np.log((n + 0.5) / 0.5), weight, (right, float((own == np.argmax(prior)).mean()) if len(own) else 0.0, len(own)))

    def of(self, ids: np.ndarray, own: int) -> np.ndarray:
        """Posterior of a document with the label ``own`` (-1: none), in parts of ``GRAIN``."""
        z = self.prior + self.weight * _evidence(self.tokens, ids)
        if own >= 0:
            z[own] += self.labels[own]
        p = np.rint(_posterior(z) * GRAIN).astype(np.int32)
        if not p.any():
            p[int(np.argmax(z))] = GRAIN
        return p


def _tokens_of(members: DataFrame, sources: list[str]) -> np.ndarray:
    """Tokens of each of the sources (at most ``MAX_SOURCES``), however many others the corpus has."""
    have = {r.source: r.n for r in members.filter(F.col("source").isin(sources)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    return np.array([have.get(s) or 0 for s in sources], float)


class SourceMix:
    """The mix of ``documents`` (doc_id, text, source) for ``targets`` (source, target_share, max_repeats).

    A source gives ``target_share`` of the tokens of all documents. One that can't, with each of its
    documents used as often as allowed, gives what it has; what it lacks is reported and not given
    to others, so the mix has as many tokens as the corpus less that.

    NULL and empty texts have no tokens; documents of sources without a target are not used but
    count in the whole; sources of ``targets`` without documents are reported with 0 tokens; NULL
    shares count as 0, NULL repeats as 1; repeated target rows of a source add up their shares and
    keep the greatest number of repeats; repeated doc_ids are documents of their own. More than
    ``MAX_SOURCES`` target sources are refused, as every document has a membership in each. What is
    kept per document is its tokens and membership.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, path: str | None = None, most: int = TRAINING_DOCUMENTS) -> None:
        spark = documents.sparkSession
        ensure_checkpoint_dir(spark)
        wanted = targets.groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats"))
        rows = wanted.filter(F.col("source").isNotNull()).orderBy("source").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.sources, self.share, self.repeats = [r.source for r in rows], np.array([r.share for r in rows], float), np.array([r.repeats for r in rows], float)
        narrow = documents.select("doc_id", "text", "source")
        code = encoder(spark, path).learnt(narrow)
        self.membership = Membership.fit(narrow, self.sources, code, most)
        self.members = code.encode(narrow).select("doc_id", "source", "ids").mapInPandas(self._members(), "doc_id bigint, source string, n_tokens bigint, cell array<int>").checkpoint()
        self.cells = self.members.filter(F.col("source").isin(self.sources) & (F.col("n_tokens") > 0)).groupBy("source", "cell").agg(F.sum("n_tokens").alias("n_tokens")).checkpoint()
        self.tokens = _tokens_of(self.cells, self.sources)
        self.total = float(self.members.agg(F.sum("n_tokens")).first()[0] or 0)
        self.steps: list[tuple[bool, np.ndarray]] = []
        self._fit()

    def _members(self):
        """For mapInPandas: tokens and membership of each document."""
        place, model = {s: i for i, s in enumerate(self.sources)}, self.membership

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                own = f.source.map(place).fillna(-1).astype("int64")
                yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "n_tokens": f.ids.map(len).astype("int64"), "cell": [model.of(ids, o) for ids, o in zip(f.ids, own, strict=True)] if place else [[]] * len(f)})

        return run

    def _rated(self):
        """Rates that the steps so far give to a frame's rows, with their caps, labels and memberships."""
        place, cap, steps = {s: i for i, s in enumerate(self.sources)}, self.repeats, list(self.steps)

        def rates(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            own = f.source.map(place).fillna(-1).to_numpy(np.int64)
            top = np.where(own >= 0, np.append(cap, 0.0)[own], 0.0)
            member = np.stack(f.cell.to_numpy()).astype(float) if len(f) else np.zeros((0, len(place)))
            member /= np.maximum(member.sum(1, keepdims=True), 1.0)
            r = np.minimum(1.0, top)
            for soft, g in steps:
                r = np.clip(r - (member @ g if soft else np.append(g, 0.0)[own]), 0.0, top)
            return r, top, own, member

        return rates

    def _sums(self) -> dict[str, np.ndarray]:
        """Per source, under the present rates: expected and actual tokens, and the tokens of documents that could still give more (``up``) or less (``down``), by membership and by label."""
        rates, k = self._rated(), len(self.sources)
        names = [f"{side}_{what}" for side in ("soft", "label") for what in ("now", "up", "down")]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = {n: np.zeros(k) for n in names}
            for f in frames:
                r, top, own, member = rates(f)
                t = f.n_tokens.to_numpy(float)
                for what, w in (("now", t * r), ("up", t * (r < top)), ("down", t * (r > 0))):
                    out[f"soft_{what}"] += w @ member
                    out[f"label_{what}"] += np.bincount(own, weights=w, minlength=k)
            yield pd.DataFrame({"at": np.arange(k), **out})

        rows = self.cells.mapInPandas(run, "at bigint, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(*(F.sum(n).alias(n) for n in names)).collect()
        out = {n: np.zeros(k) for n in names}
        for r in rows:
            for n in names:
                out[n][r["at"]] = r[n]
        return out

    def _fit(self) -> None:
        """Gradient steps, each divided by the tokens that can move, which bound the gradient's own change; a source that none can move is left as it is."""
        goal = self.share * self.total
        self.expected = self.actual = np.zeros(len(goal))
        self.exhausted = np.ones(len(goal), bool)
        if not self.sources or not self.total:
            return
        for soft, most, least in ((True, SOFT_STEPS, SOFT_RESIDUAL), (False, LABEL_STEPS, LABEL_RESIDUAL)):
            for _ in range(most):
                now = self._sums()
                side = "soft" if soft else "label"
                off = now[f"{side}_now"] - goal
                room = np.where(off > 0, now[f"{side}_down"], now[f"{side}_up"])
                off = np.where(room > 0, off, 0.0)
                if np.abs(off).max() <= least * self.total:
                    break
                self.steps.append((soft, off / np.maximum(room, 1e-9)))
        now = self._sums()
        self.expected, self.actual, self.exhausted = now["soft_now"], now["label_now"], now["label_up"] == 0

    def reachable(self) -> np.ndarray:
        """False where a source's documents are all at their cap and still give less than the target."""
        return ~(self.exhausted & (self.actual < self.share * self.total))

    def rows(self) -> DataFrame:
        """Every document: doc_id, source, n_tokens, rate and copies (how often it is used, at most max_repeats)."""
        rates = self._rated()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"doc_id": f.doc_id, "source": f.source, "n_tokens": f.n_tokens, "rate": rates(f)[0]})

        rated = self.members.mapInPandas(run, "doc_id bigint, source string, n_tokens bigint, rate double")
        u = F.pmod(F.xxhash64(F.lit(2026), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
        return rated.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("bigint"))

    def sources_table(self) -> DataFrame:
        """Per source of the targets, from the fitted rates: target_share, max_repeats, tokens, wanted_tokens, expected_tokens (by posterior), rated_tokens (by label), reachable."""
        columns = (self.share, self.repeats, self.tokens, self.share * self.total, self.expected, self.actual, self.reachable())
        table = [(s, float(w), int(m), int(t), float(g), float(e), float(a), bool(ok)) for s, w, m, t, g, e, a, ok in zip(self.sources, *columns, strict=True)]
        return self.members.sparkSession.createDataFrame(table, "source string, target_share double, max_repeats bigint, tokens bigint, wanted_tokens double, expected_tokens double, rated_tokens double, reachable boolean")

    def report(self) -> DataFrame:
        """``sources_table`` with mixed_tokens (of whole repeats), actual_share (of the tokens of all documents), share_of_mix and lacking_tokens."""
        used = self.rows().filter(F.col("source").isin(self.sources)).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
        mixed = {r.source: int(r.mixed_tokens or 0) for r in used.collect()}  # one row per target source
        whole = max(1, sum(mixed.values()))
        table = [(s, mixed.get(s, 0), mixed.get(s, 0) / max(1.0, self.total), mixed.get(s, 0) / whole) for s in self.sources]
        shares = self.members.sparkSession.createDataFrame(table, "source string, mixed_tokens bigint, actual_share double, share_of_mix double")
        lacking = F.when(F.col("reachable"), 0.0).otherwise(F.col("wanted_tokens") - F.col("rated_tokens"))
        return self.sources_table().join(shares, "source").withColumn("lacking_tokens", lacking)
