"""Mixing sources to target weights by soft membership and projected-gradient least squares.

1. One pass over the texts gives each document its size in tokens and, where they are needed, the classes of its fields, of a few marks of its text and of its words.
2. A softmax regression on these classes (of words those that depend on the source beyond chance), fitted on a bounded sample of the labelled documents, predicts source posteriors of documents without a source; a labelled document
   belongs to its source. Documents with the same posterior (to 1/1024) form a cell; what follows needs cells only.
3. The size of a mix is its budget, or what the caps allow if every source is to have its share. Rates r >= 0 of the cells (expected uses of each of their documents), at
   most the cap, minimise the squared distance of the sources' expected tokens from their targets: projected gradient with a diagonal step, until it stands still.
4. A rate becomes whole uses: its whole part, and one more for the documents whose hash lies below a threshold that is set from sums of tokens by
   hash class, so that the tokens meet the rate to a few documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.tokens import TOKENIZERS, encode
from tidewright.session import BROADCAST_BYTES, checkpointed, hash_sample, measured, real, small

#: Classes of each field's values by hash, of each mark of the text, and of all words by hash. Fields have classes of their own, so that words cannot drown them.
VALUES, GRADES, WORDS = 256, 16, 4096
#: A class is used if its chi-square against the source passes this normal deviate: of fields and marks, and of words, of which the MOST_WORDS greatest count at most.
DEVIATE, WORD_DEVIATE, MOST_WORDS = 1.0, 4.75, 64
#: Posteriors are rounded to this part.
GRAIN = 1024
#: Projected gradient ends when no source's tokens move by this part of the largest target, or after so many rounds.
STILL, ROUNDS = 1e-6, 2000
CLASSES = 4096
#: Most sources that an operator here accepts; it fails beyond, as tables of a row for each source go to the driver.
MOST_SOURCES = 256
#: Columns of the documents table whose values may tell the source.
FIELDS = ("lang", "kind_code", "mt_from", "applicant")
#: Most labelled documents (those with the smallest hash) that the classifier is fitted on; a quarter of them chooses the penalty, and whether words are used.
FIT_ROWS = 10_000
PENALTIES = [3.0, 10.0, 30.0]
#: Beside its source's target share, a source's share counts as met within this part.
TOLERANCE = 0.02


WIDE = re.compile(r"[\u3000-\u9fff\uac00-\ud7a3]")
MARKS = 6


def marks(text: str | None) -> list[int]:
    """Grades of a text's length, line breaks, spaces, question marks, hyphenated line ends and wide characters."""
    t = text or ""
    n = len(t) + 1
    wide = 0 if t.isascii() else 1 + bool(WIDE.search(t))
    counts = [math.log2(n), 100 * t.count("\n") / n, 100 * t.count(" ") / n, t.count("?"), t.count("-\n"), wide]
    return [min(GRADES - 1, int(c)) for c in counts]


def features(text: str | None, fields: list) -> np.ndarray:
    """Classes: one of each field (null is a value of its own), one of each mark, one of each word."""
    own = [i * VALUES + zlib.crc32(b"\0" if v is None else str(v).encode()) % VALUES for i, v in enumerate(fields)]
    own += [len(fields) * VALUES + j * GRADES + g for j, g in enumerate(marks(text))]
    base = len(fields) * VALUES + MARKS * GRADES
    return np.unique(np.array(own + [base + zlib.crc32(w.encode()) % WORDS for w in set((text or "").split())], np.int32))


def sized(df: DataFrame, name: str, folder: str, fields: tuple[str, ...] = FIELDS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, source, tokens, sampled, features) of each document; features of those without a source and of the labelled ones that are sampled by hash, a
    few more than `fit_rows`."""
    share = min(1.0, (1.1 * fit_rows + 50) / max(df.count(), 1))
    sampled = F.col("source").isNotNull() & (F.pmod(F.xxhash64(F.lit(11), F.col("doc_id").cast("bigint")), F.lit(1 << 40)) < int(share * (1 << 40)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, needed = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            values = list(zip(*[batch.column(4 + i).to_pylist() for i in range(len(fields))])) or [()] * len(texts)
            size = [len(encode(t, name, folder)) for t in texts]
            found = [features(t, list(v)) if s or label is None else None for t, v, s, label in zip(texts, values, needed, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), batch.column(3), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "source", "tokens", "sampled", "features"])

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", F.coalesce(sampled, F.lit(False)).alias("sampled"), *[F.col(c).cast("string").alias(c) for c in fields])
    return rows.mapInArrow(run, "doc_id bigint, source string, tokens bigint, sampled boolean, features array<int>")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Classes:
    """The classes of several rows, end to end; only those for which `used` is true."""

    def __init__(self, rows: list, used: np.ndarray):
        kept = [f[used[f]] for f in (np.asarray(r, np.int64) for r in rows)]
        self.size = len(kept)
        self.flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.size), [len(k) for k in kept])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, w[self.flat, j], self.size) for j in range(w.shape[1])], axis=1)


def _regress(x: Classes, y: np.ndarray, prior: np.ndarray, width: int, penalty: float, rounds: int = 120) -> np.ndarray:
    """(width, sources): weights added to the log prior. Adaptive gradient steps on all rows, with a squared penalty."""
    k = len(prior)
    truth = np.eye(k)[y]
    w, g1, g2 = (np.zeros((width, k)) for _ in range(3))
    for step in range(1, rounds + 1):
        gap = _softmax(prior + x.scores(w)) - truth
        g = np.stack([np.bincount(x.flat, gap[x.row, j], width) for j in range(k)], axis=1) / x.size + penalty / x.size * w
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        w -= 0.05 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.99**step)) + 1e-8)
    return w


def _depends(rows: list, y: np.ndarray, k: int, base: int, width: int, words: bool) -> np.ndarray:
    """The classes that depend on the source beyond chance, by chi-square and its cube-root approximation; those of words (from `base` on) only if wanted."""
    x = Classes(rows, np.ones(width, bool))
    counts = np.bincount(x.flat * k + y[x.row], minlength=width * k).reshape(width, k)
    n = np.bincount(y, minlength=k).astype(float)
    expected = counts.sum(axis=1, keepdims=True) * n / n.sum()
    chi = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=1) / np.maximum(1 - counts.sum(axis=1) / n.sum(), 1e-6)
    free, word = max(1, (n > 0).sum() - 1), np.arange(width) >= base
    level = lambda z: free * (1 - 2 / (9 * free) + z * math.sqrt(2 / (9 * free))) ** 3
    top = np.zeros(width, bool)
    if words:
        top[np.argsort(np.where(word, -chi, 0.0), kind="stable")[:MOST_WORDS]] = True
    return np.where(word, top & (chi > level(WORD_DEVIATE)), chi > level(DEVIATE))


class SourceModel:
    """Softmax regression on classes: log prior (of all labelled rows) and weights."""

    def __init__(self, sources: list[str], prior: np.ndarray, weight: np.ndarray, used: np.ndarray, held_loss: float = float("nan")):
        self.sources, self.prior, self.weight, self.used, self.held_loss = sources, prior, weight, used, held_loss

    @staticmethod
    def fit(docs: DataFrame, fields: int, fit_rows: int = FIT_ROWS) -> SourceModel:
        """From the rows of sized() that have a source and are sampled; the prior is that of all that have one."""
        labelled = docs.where("source is not null")
        rows = labelled.groupBy("source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        rows = sorted(rows, key=lambda r: r["source"])
        sources, n = [r["source"] for r in rows], np.array([r["n"] for r in rows], float)
        base = fields * VALUES + MARKS * GRADES
        width = base + WORDS
        used, k = np.ones(width, bool), len(sources)
        if not k:
            return SourceModel([], np.zeros(0), np.zeros((width, 0)), used)
        prior = np.log(n / n.sum())
        sample = hash_sample(labelled.where("sampled").select("doc_id", "source", "features"), ["doc_id"], fit_rows).toArrow()
        if not len(sample):
            return SourceModel(sources, prior, np.zeros((width, k)), used)
        x, y = np.array(sample["features"].to_pylist(), object), np.searchsorted(sources, sample["source"].to_pylist())
        held = np.arange(len(y)) % 4 == 0
        losses = {}
        for words in (False, True) if (~held).any() else ():
            own = _depends(x[~held], y[~held], k, base, width, words)
            fit, judge = Classes(x[~held], own), Classes(x[held], own)
            for penalty in PENALTIES:
                p = _softmax(prior + judge.scores(_regress(fit, y[~held], prior, width, penalty)))
                losses[words, penalty] = float(-np.log(p[np.arange(len(p)), y[held]]).mean())
        words, penalty = min(losses, key=losses.get, default=(False, PENALTIES[-1]))
        used = _depends(x, y, k, base, width, words)
        return SourceModel(sources, prior, _regress(Classes(x, used), y, prior, width, penalty), used, losses.get((words, penalty), float("nan")))

    def posterior(self, features: list) -> np.ndarray:
        """(rows, sources)."""
        return _softmax(self.prior + Classes(features, self.used).scores(self.weight))

    def cells(self, features: list) -> np.ndarray:
        """Posteriors in parts of GRAIN that sum to GRAIN, largest remainders first."""
        p = self.posterior(features) * GRAIN
        whole = np.floor(p).astype(int)
        rank = np.argsort(np.argsort(whole - p, axis=1, kind="stable"), axis=1, kind="stable")
        return whole + (rank < (GRAIN - whole.sum(axis=1))[:, None])


def membership(docs: DataFrame, model: SourceModel) -> DataFrame:
    """docs with `cell` (array: the part of each source, of GRAIN)."""
    sources = {s: i for i, s in enumerate(model.sources)}
    n = len(sources)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = model.cells(pdf["features"].tolist()).tolist() if len(pdf) else []
            yield pdf[["doc_id", "source", "tokens"]].assign(cell=cells)

    none = docs.where("source is null").mapInPandas(run, "doc_id bigint, source string, tokens bigint, cell array<int>")
    index = F.create_map(*[F.lit(x) for s, i in sources.items() for x in (s, i)])
    one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index[F.col("source")], GRAIN).otherwise(0).cast("int"))
    known = docs.where("source is not null").select("doc_id", "source", "tokens", one.alias("cell"))
    return known.unionByName(none)


def _parts(cells: pd.Series) -> np.ndarray:
    return np.array(cells.tolist(), float).reshape(len(cells), -1) / GRAIN


def _caps(p: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """(cells, mixes): the smallest cap of the sources that a cell may belong to."""
    return np.where((p > 0)[:, None, :], caps[None], np.inf).min(axis=2)


def _sums(cells: DataFrame, per_cell, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all cells of per_cell(frame of cells) -> array of `shape`; what reaches the driver has that shape."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                total += per_cell(pdf)
        yield pd.DataFrame({"at": range(total.size), "t": total.ravel()})

    out = np.zeros(shape)
    for r in cells.mapInPandas(run, "at int, t double").groupBy("at").agg(F.sum("t").alias("t")).collect():
        out.ravel()[r["at"]] = r["t"]
    return out


def rates(cells: DataFrame, targets: np.ndarray, caps: np.ndarray, tokens: np.ndarray, rounds: int = ROUNDS, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """((cell, rate: of each mix), whether the rounds came to stand still). cells: (cell, tokens); targets, caps: (mixes, sources); tokens: expected ones of each source.

    A round adds up the expected tokens of all cells and moves each rate against the gradient within its cap. Cells of at most `limit` bytes do all their rounds in one
    task; more of them stay distributed, their rates a column between rounds. Both take the same steps."""
    still = STILL * max(1.0, float(targets.max()))

    def moved(p: np.ndarray, r: np.ndarray, residual: np.ndarray, cap: np.ndarray) -> np.ndarray:
        return np.clip(r - (p @ residual.T) / np.maximum(p @ tokens, 1e-12)[:, None], 0.0, cap)

    cells, fits = measured(cells, limit)
    if fits:

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(batches)
            pdf = pd.concat(parts) if parts else pd.DataFrame()
            if not len(pdf):
                return
            p, size = _parts(pdf["cell"]), pdf["tokens"].to_numpy(float)
            cap, r, last, done = _caps(p, caps), np.zeros((len(pdf), len(targets))), None, False
            for _ in range(rounds):
                residual = (r * size[:, None]).T @ p - targets
                if last is not None and np.abs(residual - last).max() <= still:
                    done = True
                    break
                r, last = moved(p, r, residual, cap), residual
            yield pd.DataFrame({"cell": pdf["cell"], "rate": r.tolist(), "done": done})

        out = checkpointed(cells.coalesce(1).mapInPandas(whole, "cell array<int>, rate array<double>, done boolean"))
        return out.select("cell", "rate"), not out.where("not done").limit(1).count()
    state, last = cells.withColumn("rate", F.array(*[F.lit(0.0)] * len(targets))), None
    for _ in range(rounds):
        residual = _sums(state, lambda pdf: (np.array(pdf["rate"].tolist()) * pdf["tokens"].to_numpy(float)[:, None]).T @ _parts(pdf["cell"]), targets.shape) - targets
        if last is not None and np.abs(residual - last).max() <= still:
            return state.select("cell", "rate"), True
        last = residual

        def step(batches: Iterator[pd.DataFrame], residual: np.ndarray = residual) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                p = _parts(pdf["cell"])
                yield pdf.assign(rate=moved(p, np.array(pdf["rate"].tolist()).reshape(len(pdf), -1), residual, _caps(p, caps)).tolist() if len(pdf) else [])

        state = checkpointed(state.mapInPandas(step, "cell array<int>, tokens bigint, rate array<double>"))
    return state.select("cell", "rate"), False


def mix(
    documents: DataFrame, mix_targets: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, fields: tuple[str, ...] = FIELDS, fit_rows: int = FIT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: (mix_id, doc_id, source, tokens, uses), a row for each document that a mix uses, `uses` times. shares: (mix_id, source, target_share, reached_share,
    target_tokens, reached_tokens, budget_tokens, documents, most_uses, cap, status, settled) for each row of mix_targets; tokens of documents without a source count by posterior.

    target_share is the weight over the sum of the mix's weights of sources that have documents. A mix's size is budget_ratio times the tokens of all documents, or, where
    a cap keeps a source from its share of that, the largest size at which all sources have their shares; target_tokens follow that size and budget_tokens the ratio.
    Status, of the shares reached: `met` (within TOLERANCE of the target), `short` or `over`; `no target` for a missing, NaN, negative or zero share (the source is not
    used); `no documents`. settled: the projected gradient came to stand still. A missing cap means one use, and so does a cap below one. Of repeated target rows the first in
    order of (share, cap) counts. Texts without tokens are not selected. Documents repeated by doc_id must not occur. `fields` are columns whose values may
    tell the source. Empty documents or targets give empty results."""
    spark = documents.sparkSession
    docs = checkpointed(sized(documents, name, folder, fields, fit_rows))
    total = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    model = SourceModel.fit(docs, len(fields), fit_rows)
    share = F.when(real("target_share") > 0, F.col("target_share"))
    rows = mix_targets.where("mix_id is not null and source is not null").select("mix_id", "source", share.alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("cap"), real("budget_ratio").alias("ratio"))
    rows = rows.orderBy("mix_id", "source", F.col("share").asc_nulls_last(), "cap").limit(MOST_SOURCES * 100 + 1).toPandas()
    if len(rows) > MOST_SOURCES * 100:
        raise ValueError("too many target rows")
    rows = rows.drop_duplicates(["mix_id", "source"])
    mixes, sources = sorted(rows["mix_id"].unique().tolist()), model.sources
    out = "mix_id int, doc_id bigint, source string, tokens bigint, uses int"
    kinds = "mix_id int, source string, target_share double, reached_share double, target_tokens double, reached_tokens double, budget_tokens double, documents bigint, most_uses int, cap int, status string, settled boolean"
    if not mixes or not sources or not total:
        return spark.createDataFrame([], out), spark.createDataFrame([], kinds)
    at = {s: i for i, s in enumerate(sources)}
    shares, caps, budget = np.zeros((len(mixes), len(sources))), np.ones((len(mixes), len(sources))), np.zeros(len(mixes))
    for i, m in enumerate(mixes):
        own = rows[rows["mix_id"] == m]
        budget[i] = float(own["ratio"].dropna().max() if own["ratio"].notna().any() else 1.0) * total
        for s, w, c in zip(own["source"], own["share"].fillna(0.0), own["cap"]):
            if s in at:
                shares[i, at[s]], caps[i, at[s]] = w, c
    placed = checkpointed(membership(docs, model))
    cells = checkpointed(placed.where("tokens > 0").groupBy("cell").agg(F.sum("tokens").alias("tokens")))
    tokens = _sums(cells, lambda pdf: pdf["tokens"].to_numpy(float) @ _parts(pdf["cell"]), (len(sources),))
    room = _sums(cells, lambda pdf: (_caps(_parts(pdf["cell"]), caps) * pdf["tokens"].to_numpy(float)[:, None]).T @ _parts(pdf["cell"]), shares.shape)
    shares = np.where(tokens > 0, shares, 0.0)
    shares = np.divide(shares, shares.sum(axis=1, keepdims=True), out=np.zeros_like(shares), where=shares.sum(axis=1, keepdims=True) > 0)
    size = np.minimum(budget, np.min(np.divide(room, shares, out=np.full_like(shares, np.inf), where=shares > 0), axis=1))
    targets = shares * np.where(np.isfinite(size), size, 0.0)[:, None]
    rate, settled = rates(cells, targets, caps, tokens)
    # the hash of a document is the same for all mixes; thresholds come from sums of tokens by hash class
    u = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    used = placed.where("tokens > 0").withColumn("u", u).withColumn("class", F.floor(F.col("u") * CLASSES).cast("int"))
    w = W.partitionBy("cell").orderBy("class")
    sums = used.groupBy("cell", "class").agg(F.sum("tokens").alias("t"))
    sums = sums.select("cell", "class", "t", (F.sum("t").over(w) - F.col("t")).alias("below"), F.sum("t").over(W.partitionBy("cell")).alias("all"))
    per = sums.join(small(rate), "cell").select("cell", "class", "t", "below", "all", F.posexplode("rate").alias("m", "rate"))
    want = (F.col("rate") - F.floor("rate")) * F.col("all")
    inside = F.when((F.col("below") <= want) & (want < F.col("below") + F.col("t")), (F.col("class") + (want - F.col("below")) / F.col("t")) / CLASSES)
    cuts = per.groupBy("cell", "m").agg(F.first("rate").alias("rate"), F.coalesce(F.max(inside), F.lit(0.0)).alias("cut")).where("rate > 0")
    ids = F.create_map(*[F.lit(x) for i, m in enumerate(mixes) for x in (i, int(m))])
    whole = F.floor("rate").cast("int") + (F.col("u") < F.col("cut")).cast("int")
    picked = used.join(small(checkpointed(cuts)), "cell").select(ids[F.col("m")].cast("int").alias("mix_id"), "m", "doc_id", "source", "tokens", "cell", whole.alias("uses")).where("uses > 0")
    reached = picked.select("m", "tokens", "uses", F.posexplode("cell").alias("s", "part")).where("part > 0").groupBy("m", "s")
    sizes = {(r["m"], r["s"]): r for r in reached.agg(F.sum(F.col("tokens") * F.col("uses") * F.col("part") / GRAIN).alias("t"), F.count("*").alias("n"), F.max("uses").alias("most")).collect()}
    report = []
    for i, m in enumerate(mixes):
        got = sum(r["t"] for (k, _), r in sizes.items() if k == i)
        own = rows[rows["mix_id"] == m]
        for s, wanted, cap in zip(own["source"], own["share"], own["cap"]):
            r, j = sizes.get((i, at.get(s))), at.get(s)
            t, share_ = float(r["t"]) if r else 0.0, float(shares[i, j]) if s in at and tokens[j] > 0 else None
            reached_share = t / got if got else 0.0
            if wanted != wanted:
                status, share_ = "no target", None
            elif share_ is None:
                status = "no documents"
            else:
                status = "met" if abs(reached_share - share_) <= TOLERANCE * share_ else "short" if reached_share < share_ else "over"
            known = share_ is not None
            report.append((int(m), s, share_, reached_share, float(targets[i, j]) if known else None, t, float(shares[i, j] * budget[i]) if known else None, int(r["n"]) if r else 0, int(r["most"]) if r else 0, int(cap), status, settled))
    return picked.select("mix_id", "doc_id", "source", "tokens", "uses"), spark.createDataFrame(report, kinds)
