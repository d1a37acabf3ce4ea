"""Mixing sources to target weights, by soft membership and projected gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.shingles import shingle_sets
from gleanspark.session import checkpointed

#: Hashed word features of the classifier; weight of the label beside the predicted membership.
FEATURES, LABEL_WEIGHT = 4096, 0.95
#: The descent ends when no share moves by more than SETTLED any more. STEPS only guards against one that never does, which is an error.
STEP, SETTLED, STEPS = 0.9, 1e-4, 100


def named(c):
    """A source as it is compared: trimmed, in lower case; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def _features(texts):
    which, bounds, tokens = shingle_sets(texts, 1, 1)
    return which, bounds, (tokens & np.uint64(FEATURES - 1)).astype(np.int64)


def train(docs: DataFrame, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log prior and log likelihood per domain, from all labelled rows: a table of domains x FEATURES counts."""
    index = {d: k for k, d in enumerate(domains)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(domains), FEATURES + 1), dtype=np.int64)
        for b in batches:
            label = np.array([index.get(s, -1) for s in b.column(0).to_pylist()])
            which, bounds, tokens = _features(b.column(1).to_pylist())
            owner = label[np.repeat(which, np.diff(bounds))]
            np.add.at(held, (owner[owner >= 0], tokens[owner >= 0]), 1)
            np.add.at(held[:, FEATURES], label[label >= 0], 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(domains)), pa.int32()), pa.array([r.tobytes() for r in held], pa.binary())], ["domain", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"domain": table.column("domain").combine_chunks().slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((len(domains), FEATURES + 1))
    for r in docs.select("source", "text").where("source is not null").mapInArrow(count, "domain int, counts binary").groupBy("domain").applyInArrow(add, "domain int, counts binary").collect():
        counts[r.domain] = np.frombuffer(r.counts, np.int64)
    prior = np.log(counts[:, FEATURES] + 1.0)
    like = np.log((counts[:, :FEATURES] + 0.5) / (counts[:, :FEATURES].sum(1, keepdims=True) + 0.5 * FEATURES))
    return prior - np.log(max(np.exp(prior).sum(), 1.0)), like


def posteriors(texts: list[str | None], prior: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Domain posteriors per text; that of no words is the prior. Scores are flattened by the root of the text's length."""
    score = np.tile(prior, (len(texts), 1))
    which, bounds, tokens = _features(texts)
    if len(which):
        s = np.add.reduceat(like[:, tokens], bounds[:-1], axis=1).T
        score[which] += (s - s.max(1, keepdims=True)) / np.sqrt(np.diff(bounds))[:, None]
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Mixer:
    """Targets, a fitted membership table and fitted rates of all mixes. Everything on the driver is domains x mixes."""

    def __init__(self, docs: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source"):
        base = docs.select(F.col(doc).alias("doc"), named(F.col(source)).alias("source"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("tokens"), F.col(text).alias("text"))
        wanted = targets.where("target_share is not null and not isnan(target_share)").select("mix_id", named(F.col("source")).alias("source"), "target_share", "max_repeats")
        # Rows of a mix that name one source add up; the larger repeat count holds.
        rows = wanted.where("source is not null and mix_id is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("mix_id", "source").collect()  # the mixes' own table
        self.domains = sorted({r.source for r in rows})
        self.mixes = sorted({r.mix_id for r in rows})
        at = {d: k for k, d in enumerate(self.domains)}
        m = {x: k for k, x in enumerate(self.mixes)}
        self.share = np.zeros((len(self.mixes), len(self.domains)))
        self.repeats = np.zeros_like(self.share)
        self.listed = np.zeros_like(self.share, dtype=bool)
        for r in rows:
            self.share[m[r.mix_id], at[r.source]] = r.share
            self.repeats[m[r.mix_id], at[r.source]] = max(0, r.repeats or 0)
            self.listed[m[r.mix_id], at[r.source]] = True
        total = self.share.sum(1, keepdims=True)
        self.share = np.divide(self.share, total, out=np.zeros_like(self.share), where=total > 0)
        base = base.where(F.col("source").isin(self.domains)) if self.domains else base.limit(0)
        self.tokens = np.zeros(len(self.domains), dtype=np.int64)
        for r in base.groupBy("source").agg(F.sum("tokens").alias("n")).collect():  # one row a source
            self.tokens[at[r.source]] = r.n
        self.kind = base.schema["doc"].dataType.simpleString()
        self.members = self._members(base)
        self.size = (self.listed * self.tokens).sum(1)
        self.history = self._fit()

    def _members(self, base: DataFrame) -> DataFrame:
        """(doc, domain, tokens, q): the label blended with what the classifier predicts."""
        prior, like = train(base, self.domains)
        index = {d: k for k, d in enumerate(self.domains)}
        held = base.sparkSession.sparkContext.broadcast((prior, like))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                label = np.array([index[s] for s in b.column(1).to_pylist()], dtype=np.int32)
                q = (1 - LABEL_WEIGHT) * posteriors(b.column(3).to_pylist(), *held.value)
                q[np.arange(len(label)), label] += LABEL_WEIGHT
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label), b.column(2), pa.array(list(q.astype(np.float32)), pa.list_(pa.float32()))], ["doc", "domain", "tokens", "q"])

        return checkpointed(base.mapInArrow(run, f"doc {self.kind}, domain int, tokens bigint, q array<float>"))

    def _rates(self, history: list[np.ndarray], domain: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Rates (mix x document) after the steps whose residuals are known: nonnegative, at most the repeats allowed."""
        cap = self.repeats[:, domain]
        rate = np.minimum(self.share[:, domain] * np.divide(self.size[:, None], self.tokens[domain][None, :], out=np.zeros((len(self.mixes), len(domain))), where=self.tokens[domain][None, :] > 0), cap)
        for step in history:
            rate = np.clip(rate - step @ q.T, 0, cap)
        return rate

    def _fit(self) -> list[np.ndarray]:
        """Projected gradients on the squared gap between expected and wanted token shares.

        A step needs the domains' expected totals alone, which the tasks sum up; a document's rate is found again from the
        residuals so far, so nothing is kept per document. Shares beyond what repeats allow never meet their target, so
        the descent ends when the shares rest; self.gap is then what is left, per mix and domain.
        """
        history: list[np.ndarray] = []
        self.gap = np.zeros(self.share.shape)
        shape = self.share.shape
        if not self.domains or not self.mixes:
            return history
        weight = np.divide(self.size[:, None], self.tokens[None, :], out=np.zeros(shape), where=self.tokens[None, :] > 0)
        for _ in range(STEPS):

            def total(batches: Iterator[pa.RecordBatch], history=tuple(history)) -> Iterator[pa.RecordBatch]:
                held = np.zeros(shape)
                for b in batches:
                    if b.num_rows:
                        q = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1).astype(float)
                        rate = self._rates(history, b.column(0).to_numpy(), q)
                        held += (rate * b.column(1).to_numpy()[None, :]) @ q
                yield pa.RecordBatch.from_arrays([pa.array(range(held.size), pa.int32()), pa.array(held.ravel())], ["cell", "total"])

            members, self.members = self.members, None
            cells = members.select("domain", "tokens", "q").mapInArrow(total, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()  # mixes x domains rows
            self.members = members
            reached = np.zeros(shape)
            for r in cells:
                reached.flat[r.cell] = r.total
            gap = np.divide(reached - self.share * self.size[:, None], self.size[:, None], out=np.zeros(shape), where=self.size[:, None] > 0)
            rests = bool(history) and np.abs(gap - self.gap).max() < SETTLED
            self.gap = gap
            if rests or np.abs(gap).max() < SETTLED:
                return history
            history.append(STEP * gap * weight)
        raise RuntimeError(f"shares still move after {STEPS} steps")

    def chosen(self) -> DataFrame:
        """(mix_id, doc, source, tokens, repeats): documents with the times each is taken, at least once.

        A rate is rounded down, or up with the probability of its fraction, by a hash of document and mix.
        """
        history, mixes, domains = tuple(self.history), self.mixes, self.domains
        members, self.members = self.members, None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                domain = b.column(1).to_numpy()
                rate = self._rates(history, domain, np.array(b.column(3).to_pylist(), dtype=float))
                coin = (b.column(4).to_numpy().astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(mixes) + 1, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(11)
                times = np.floor(rate + coin.astype(float) / (1 << 53)).astype(np.int64)
                times = np.minimum(times, self.repeats[:, domain].astype(np.int64))
                m, x = np.nonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array([mixes[k] for k in m], pa.int32()), b.column(0).take(pa.array(x)), pa.array([domains[k] for k in domain[x]], pa.string()), b.column(2).take(pa.array(x)), pa.array(times[m, x], pa.int32())], ["mix_id", "doc", "source", "tokens", "repeats"])

        out = members.withColumn("h", F.xxhash64("doc")).mapInArrow(run, f"mix_id int, doc {self.kind}, source string, tokens bigint, repeats int")
        self.members = members
        return out

    def report(self) -> DataFrame:
        """(mix_id, source, target_share, reached_share, available_tokens, reachable): one row per source of a mix.

        reachable is whether the target share of the mix's size is within the repeats of the source's tokens, exactly.
        """
        spark = self.members.sparkSession
        rows = [
            (int(x), d, float(self.share[m, k]), int(self.tokens[k]), not bool(self.share[m, k] * float(self.size[m]) > self.repeats[m, k] * float(self.tokens[k])))
            for m, x in enumerate(self.mixes)
            for k, d in enumerate(self.domains)
            if self.listed[m, k]
        ]
        goal = spark.createDataFrame(rows, "mix_id int, source string, target_share double, available_tokens bigint, reachable boolean")
        got = self.chosen().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken"))
        whole = got.groupBy("mix_id").agg(F.sum("taken").alias("all"))
        return goal.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left").select("mix_id", "source", "target_share", (F.coalesce("taken", F.lit(0)) / F.col("all")).alias("reached_share"), "available_tokens", "reachable")
