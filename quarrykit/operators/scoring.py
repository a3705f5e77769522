"""All questions of a repository against a block of its files, as arrays inside one task.

A pair of a question and a chunk is a number in an array, never a row: only the best rows of a question leave a
block.  A file is in one block, so what is capped for each file is capped inside the block, and the best rows of
all blocks hold the best of the repository.  Nothing is left out before it is scored.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.config import SearchOptions
from quarrykit.operators import index as I
from quarrykit.session import partitions, ship

BLOCK = 30_000  # chunks of a block, about


def _blocks(stats: DataFrame) -> DataFrame:
    """repo and the number of its blocks; a row for each repository."""
    return F.broadcast(stats.select("repo", F.greatest(F.ceil(F.col("blocks") / BLOCK), F.lit(1)).cast("int").alias("of")))


def placed(rows: DataFrame, stats: DataFrame, file: str | Column = "file_id") -> DataFrame:
    """Rows of a repository with the block that their file is in."""
    of = F.coalesce("of", F.lit(1))
    return rows.join(_blocks(stats), "repo", "left").withColumn("block", F.pmod(F.xxhash64(file), of).cast("int")).drop("of")


def everywhere(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows of a repository, once for each of its blocks."""
    return rows.join(_blocks(stats), "repo", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))).drop("of")


def asked(questions: DataFrame, frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """The questions with the weight of their terms: repo, question_id, terms, idfs, mean and any others; null weights where the repository is not known.

    questions: repo, question_id, terms and any others.
    """
    others = [c for c in questions.columns if c not in ("repo", "question_id", "terms")]
    t = questions.select("repo", "question_id", *others, F.posexplode_outer("terms").alias("pos", "term"))
    t = t.join(frequencies.select("repo", "term", "df"), ["repo", "term"], "left").join(F.broadcast(stats), "repo", "left")
    one = F.struct("pos", "term", I.idf(F.col("blocks"), F.coalesce("df", F.lit(0))).alias("idf"))
    g = t.groupBy("repo", "question_id").agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), one))).alias("t"), F.first("mean_length").alias("mean"), *[F.first(c).alias(c) for c in others])
    return g.select("repo", "question_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"), "mean", *others)


def met(blocks: DataFrame, questions: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Rows of ``run`` over the chunks and the questions of every (repo, block)."""
    spark = blocks.sparkSession
    ship(spark)
    n = partitions(spark)
    left, right = (x.repartition(n, "repo", "block").groupBy("repo", "block") for x in (blocks, questions))
    return left.cogroup(right).applyInPandas(run, schema)


class Block:
    """The chunks of a block (``chunk``, ascending) and the weight of every term that is asked for.

    rows: chunk_id, term_count, terms, tfs; each of them is in ``chunk``.
    """

    def __init__(self, chunk: np.ndarray, rows: pd.DataFrame, questions: pd.DataFrame, k1: float, b: float) -> None:
        self.chunk, self.k1 = chunk, k1
        self.idf = {t: w for ts, ws in zip(questions.terms, questions.idfs) for t, w in zip(ts, ws)}
        self.at: dict[str, tuple[array, array]] = {t: (array("i"), array("i")) for t in self.idf}
        place, length = np.searchsorted(chunk, rows.chunk_id.to_numpy()), np.zeros(len(chunk))
        length[place] = rows.term_count.to_numpy("float64")
        for i, ts, ns in zip(place.tolist(), rows.terms, rows.tfs):
            for t, n in zip(ts.split(" "), ns):
                if t in self.at:
                    self.at[t][0].append(i)
                    self.at[t][1].append(n)
        mean = questions["mean"].iloc[0]
        self.part = k1 * (1 - b + b * length / (mean if mean > 0 else 1.0))
        self.weights: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def weight(self, term: str) -> tuple[np.ndarray, np.ndarray]:
        got = self.weights.get(term)
        if got is None:
            i, n = (np.frombuffer(x, "int32") if x else np.zeros(0, "int32") for x in self.at[term])
            tf = n.astype("float64")
            got = self.weights[term] = i, self.idf[term] * (tf * (self.k1 + 1)) / (tf + self.part[i])
        return got

    def bm25(self, terms) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of terms of every chunk; terms are added in their order, so that equal chunks get equal scores."""
        score, count = np.zeros(len(self.chunk)), np.zeros(len(self.chunk), "int32")
        for t in terms:
            i, w = self.weight(t)
            score[i] += w
            count[i] += 1
        return score, count


def best(score: np.ndarray, among: np.ndarray, file: np.ndarray, per_file: int, k: int) -> list[int]:
    """The best k of the places ``among`` (ascending), at most ``per_file`` of a file; ties go to the earlier place."""
    most = 8 * k
    while True:
        s, own = score[among], among
        whole = len(among) <= most
        if not whole:
            own = among[s >= np.partition(s, len(s) - most)[len(s) - most]]
        own = own[np.argsort(-score[own], kind="stable")]
        seen: dict[int, int] = {}
        out = []
        for i in own:
            f = file[i]
            n = seen[f] = seen.get(f, 0) + 1
            if n <= per_file:
                out.append(i)
                if len(out) == k:
                    return out
        if whole:
            return out
        most *= 8


LEXICAL = "question_id BIGINT, chunk_id BIGINT, file_id BIGINT, score DOUBLE, terms BIGINT"


def lexical(blocks: DataFrame, questions: DataFrame, frequencies: DataFrame, stats: DataFrame, per_file: int, k: int, digits: int, o: SearchOptions = SearchOptions()) -> DataFrame:
    """question_id, chunk_id, file_id, score, terms: the best k chunks by BM25 of every block, at most ``per_file`` of a file.

    blocks: repo, chunk_id, file_id, term_count, terms, tfs; questions: repo, question_id, terms.
    """
    columns = [x.split()[0] for x in LEXICAL.split(", ")]

    def run(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(qs):
            rows = rows.sort_values("chunk_id", ignore_index=True)
            b, ids = Block(rows.chunk_id.to_numpy(), rows, qs, o.k1, o.b), rows.file_id.to_numpy()
            for q, terms in zip(qs.question_id, qs.terms):
                score, count = b.bm25(terms)
                score = np.round(score, digits)
                out += [(q, b.chunk[i], ids[i], score[i], count[i]) for i in best(score, np.flatnonzero(count), ids, per_file, k)]
        return pd.DataFrame(out, columns=columns)

    chunks = blocks.select("repo", "chunk_id", "file_id", "term_count", "terms", "tfs")
    return met(placed(chunks, stats), everywhere(asked(questions, frequencies, stats), stats), run, LEXICAL)


def most(packed: DataFrame, questions: DataFrame, stats: DataFrame, o: SearchOptions) -> DataFrame:
    """question_id, most: the best BM25 score of the questions of repositories that have several blocks.  questions: as of ``asked``."""
    large = stats.where(F.col("blocks") > BLOCK)
    names = F.broadcast(large.select("repo"))

    def run(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(qs):
            rows = rows.sort_values("chunk_id", ignore_index=True)
            b = Block(rows.chunk_id.to_numpy(), rows, qs, o.k1, o.b)
            for q, terms in zip(qs.question_id, qs.terms):
                score, count = b.bm25(terms)
                if count.any():
                    out.append((q, float(np.round(score, 12).max())))
        return pd.DataFrame(out, columns=["question_id", "most"])

    chunks = packed.join(names, "repo", "left_semi").select("repo", "chunk_id", "file_id", "term_count", "terms", "tfs")
    qs = questions.join(names, "repo", "left_semi").select("repo", "question_id", "terms", "idfs", "mean")
    return met(placed(chunks, large), everywhere(qs, large), run, "question_id BIGINT, most DOUBLE").groupBy("question_id").agg(F.max("most").alias("most"))


def path_files(questions: DataFrame, files: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """question_id, file_id, path: the best k files of every block by the terms of their paths.

    questions: repo, question_id, terms, idfs; files: repo, file_id, terms; sizes: repo, blocks (its files).
    """

    def run(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(qs):
            rows = rows.sort_values("file_id", ignore_index=True)
            ids, at = rows.file_id.to_numpy(), _inverted(rows.terms)
            every = np.arange(len(ids))
            for q, terms, idfs in zip(qs.question_id, qs.terms, qs.idfs):
                score, total = np.zeros(len(ids)), 0.0
                for t, w in zip(terms, idfs):
                    total += w
                    if t in at:
                        score[at[t]] += w
                if total > 0:
                    score = np.round(score / total, 12)
                    out += [(q, ids[i], score[i]) for i in best(score, np.flatnonzero(score), every, 1, k)]
        return pd.DataFrame(out, columns=["question_id", "file_id", "path"])

    return met(placed(files, sizes), everywhere(questions, sizes), run, "question_id BIGINT, file_id BIGINT, path DOUBLE")


def _inverted(sets) -> dict[str, np.ndarray]:
    at: dict[str, array] = {}
    for i, ts in enumerate(sets):
        for t in ts:
            at.setdefault(t, array("i")).append(i)
    return {t: np.frombuffer(x, "int32") for t, x in at.items()}


PACKED, PLACE, SYMBOL, ENTRY = range(4)
ROWS = (
    "repo STRING, kind INT, chunk_id BIGINT, file_id BIGINT, file_class STRING, term_count BIGINT, terms STRING, tfs ARRAY<INT>,"
    " shown STRING, names ARRAY<STRING>, parts ARRAY<STRING>, weights ARRAY<DOUBLE>, labels ARRAY<STRING>"
)
SIGNALS = "question_id BIGINT, chunk_id BIGINT, file_id BIGINT, score DOUBLE, bm25 DOUBLE, symbol DOUBLE, path DOUBLE, entry DOUBLE, names ARRAY<STRING>, bonus DOUBLE"


class _Lanes:
    """All lanes over one block.  rows: as ``ROWS``; a chunk counts if a row of another kind than PACKED places it."""

    def __init__(self, rows: pd.DataFrame, qs: pd.DataFrame, o: SearchOptions) -> None:
        self.o = o
        place = rows[rows.kind != PACKED].drop_duplicates("chunk_id").sort_values("chunk_id", ignore_index=True)
        self.chunk, self.file = place.chunk_id.to_numpy(), place.file_id.to_numpy()
        self.weight = np.ones(len(place))
        for name, w in o.class_weights.items():
            self.weight[(place.file_class == name).to_numpy()] = w
        self.of: dict[int, list[int]] = {}
        for i, f in enumerate(self.file.tolist()):
            self.of.setdefault(f, []).append(i)
        text = rows[(rows.kind == PACKED) & rows.chunk_id.isin(self.chunk)]
        self.block = Block(self.chunk, text, qs, o.k1, o.b)
        s = rows[rows.kind == SYMBOL].sort_values(["chunk_id"], ignore_index=True)
        self.shown, self.symbol_at = s.shown.tolist(), np.searchsorted(self.chunk, s.chunk_id.to_numpy())
        self.named = _inverted(s.names)
        self.part = _inverted(s.parts)
        weights: dict[str, array] = {}
        for ts, ws in zip(s.parts, s.weights):
            for t, w in zip(ts, ws):
                weights.setdefault(t, array("d")).append(w)
        self.part_weight = {t: np.frombuffer(x) for t, x in weights.items()}
        self.total = np.array([sum(ws) for ws in s.weights])
        e = rows[rows.kind == ENTRY]
        self.entry_at, self.label = np.searchsorted(self.chunk, e.chunk_id.to_numpy()), _inverted(e.labels)

    def symbols(self, terms, identifiers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of every chunk, and the symbols that score with their chunks."""
        hit = np.zeros(len(self.total))
        for t in terms:
            if t in self.part:
                hit[self.part[t]] += self.part_weight[t]
        score = np.divide(hit, self.total, out=np.zeros(len(hit)), where=self.total > 0)
        score[score < 0.5] = 0.0
        for t in identifiers:
            if t in self.named:
                score[self.named[t]] = 1.5
        own = np.flatnonzero(score)
        out = np.zeros(len(self.chunk))
        np.maximum.at(out, self.symbol_at[own], score[own])
        return np.round(out, 12), own, self.symbol_at[own]

    def of_question(self, r) -> list[tuple]:
        o, n = self.o, len(self.chunk)
        bm25, count = self.block.bm25(r.terms)
        bm25 = np.round(bm25, 12)
        found = count > 0
        top = r.most if r.most == r.most and r.most is not None else bm25.max(initial=0.0)
        symbol, own, at = self.symbols(r.terms, r.identifiers) if o.symbols else (np.zeros(n), np.zeros(0, "int64"), np.zeros(0, "int64"))
        path, entry = np.zeros(n), np.zeros(n)
        found |= symbol > 0
        for f, v in zip(r.path_files, r.path_scores):
            for i in sorted(self.of.get(f, ()), key=lambda i: (-bm25[i], i))[: o.per_file]:
                path[i] = v
                found[i] = True
        if r.intent and o.entry_boost and len(self.entry_at):
            shared = np.zeros(len(self.entry_at))
            for t in r.terms:
                if t in self.label:
                    shared[self.label[t]] += 1
            np.maximum.at(entry, self.entry_at, o.entry_base + 0.5 * np.minimum(1.0, shared / max(len(r.terms), 1)))
            found[self.entry_at] = True
        c = np.flatnonzero(found)
        score = np.zeros(n)
        part = bm25[c] / top if top > 0 else 0.0
        fused = part + o.symbol_weight * np.minimum(symbol[c], 1.5) + o.path_weight * path[c] + o.entry_weight * entry[c]
        score[c] = np.round(fused if r.any_class else fused * self.weight[c], 12)
        if r.near is None:
            picked = {i: 0.0 for i in best(score, c, self.file, o.per_file, o.k) + best(score, c, self.file, n, o.import_seeds)}
        else:
            picked = {}
            for f, parent in zip(r.near, r.parents):
                own_ = [i for i in self.of.get(f, ()) if bm25[i] > 0]
                if own_:
                    picked[min(own_, key=lambda i: (-bm25[i], i))] = o.import_decay * parent
        names: dict[int, set[str]] = {}
        for j in np.flatnonzero(np.isin(at, list(picked))):
            if (shown := self.shown[own[j]]) is not None:
                names.setdefault(int(at[j]), set()).add(shown)
        return [
            (r.question_id, self.chunk[i], self.file[i], score[i], bm25[i], symbol[i], path[i], entry[i], sorted(names[i])[:5] if i in names else None, bonus)
            for i, bonus in picked.items()
        ]


def signals(rows: DataFrame, questions: DataFrame, o: SearchOptions) -> DataFrame:
    """The candidates of every question that can be among its best, with their signals (``SIGNALS``).

    rows: as ``ROWS`` with their block; questions: as of ``asked`` with block, intent, any_class, identifiers, most, path_files, path_scores,
    and near and parents: if not null, files of which the best lexical chunk is wanted, whatever its place, and the scores it gains from.
    """
    columns = [x.split()[0] for x in SIGNALS.split(", ")]

    def run(left: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(qs):
            lanes = _Lanes(left, qs, o)
            if len(lanes.chunk):
                for r in qs.itertuples(index=False):
                    out += lanes.of_question(r)
        return pd.DataFrame(out, columns=columns)

    return met(rows, questions, run, SIGNALS)
