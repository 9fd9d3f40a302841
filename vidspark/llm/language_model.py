"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

Words are counted over all training texts. The most frequent become symbols of their own, the others are grouped by their
last byte; a symbol's probability depends on the two symbols before through r = R[a] C1 + R[b] C2 and r Q[c] + bias[c],
and a grouped word has its smoothed share of the group. Every training token takes part: in each round each partition
runs over its triples, weighted by how often they occur, against noise drawn from the symbol counts, and the partitions'
parameters are averaged in two steps. As scores split into a table over (a, c) and one over (b, c), the sums that
normalise all contexts are one matrix product, and probabilities add up to 1 over symbols.

The counts of the HOT most frequent words are broadcast (a bounded table); other words are joined with the whole count
table. Model tables have SYMBOLS x SYMBOLS entries whatever the corpus.

Defined results: a null or empty text has the end token alone; a null id counts as an empty text for the fold; repeated
rows are scored alike; other columns are left out; without training texts all counts are zero; texts of any length
are scored whole; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import documents, materialize, shuffle_partitions, text_slices

FOLDS, HELD_OUT = 5, 1
#: Words broadcast with their counts (those of the highest count classes that fit), symbols of the model, width, noise words and examples of a step, rounds, rate.
HOT, SYMBOLS, WIDTH, NOISE, STEP, ROUNDS, RATE = 100_000, 512, 24, 40, 4096, 3, 0.2
#: Distinct words or triples a task holds before it passes them on; bounds memory only.
HELD = 200_000
END = b" "  # no word can hold a space
#: Group of a word by its last byte: letters, digits, comma, stop, other ASCII, sixteen groups of other bytes.
GROUPS = 46


def group_of(last: int) -> int:
    if 97 <= last <= 122:
        return last - 97
    if 48 <= last <= 57:
        return 26
    return 27 if last == 44 else 28 if last == 46 else 29 if last < 128 else 30 + last % 16


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts; the end token, one in each text, is a single space."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for _, texts in text_slices(batches, text):
            for data in texts:
                held.update((data or b"").lower().split())
                held[END] += 1
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Counts:
    """What the driver keeps of the counts: the hot words, totals, and totals by group of the words that are no symbols."""

    def __init__(self, table: DataFrame):
        words = table.where(F.col("word") != F.lit(END)).withColumn("size", F.floor(8 * F.log2("n")).cast("int"))
        least, total = None, 0
        for size, kinds in sorted(words.groupBy("size").count().collect(), reverse=True):  # at most 512 sizes
            total += kinds
            if total > HOT:
                break
            least = size
        ordered = sorted(((bytes(r[0]), r[1]) for r in words.where(F.col("size") >= F.lit(least)).select("word", "n").collect()),
                         key=lambda r: (-r[1], r[0])) if least is not None else []  # at most HOT rows
        self.words = {r[0]: k for k, r in enumerate(ordered)}
        self.n = np.array([r[1] for r in ordered] or [0], np.int64)
        row = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(
            F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0))).first()
        self.tokens, self.distinct, self.ends = row
        self.symbols = min(len(ordered), SYMBOLS - GROUPS - 1)
        last = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int")
        sums, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
        for byte, n, words in table.where(F.col("word") != F.lit(END)).groupBy(last.alias("b")).agg(
                F.sum("n"), F.count("*")).collect():  # at most 256 rows
            sums[group_of(byte)] += n
            kinds[group_of(byte)] += words
        for word in list(self.words)[:self.symbols]:
            sums[group_of(word[-1])] -= self.n[self.words[word]]
            kinds[group_of(word[-1])] -= 1
        self.group_sums, self.group_log = sums, np.log10(sums + 0.5 * (kinds + 1))
        # symbols: words, then the end, then groups
        self.end = self.symbols
        self.totals = np.concatenate((self.n[:self.symbols], [self.ends], sums)).astype(np.float64)


def coded(docs: DataFrame, counts: Counts) -> DataFrame:
    """One row per text: symbols (16 bits each, the end last), sums over hot words, and the words that are not hot."""
    words = docs.sparkSession.sparkContext.broadcast((counts.words, counts.n, counts.symbols, counts.end, counts.ends))

    def run(batches: Iterator[pa.RecordBatch]):
        known, n, symbols, end, ends = words.value
        logs = np.log10(n + 0.5)
        groups = np.array([end + 1 + group_of(b) for b in range(256)], np.uint16)
        symbol_of = np.array([k if k < symbols else groups[w[-1]] for w, k in known.items()] or [0], np.uint16)
        for batch, texts in text_slices(batches, "text"):
            rows = []
            for data in texts:
                found = (data or b"").lower().split()
                ids = np.fromiter((known.get(w, -1) for w in found), np.int64, len(found))
                hot = ids >= 0
                rest = [found[i] for i in np.flatnonzero(~hot)]
                out = np.empty(len(found) + 1, "<u2")
                out[-1] = end
                out[:-1][hot] = symbol_of[ids[hot]]
                out[:-1][~hot] = groups[[w[-1] for w in rest]] if rest else 0
                part = logs[ids[hot]]
                rows.append((out.tobytes(), len(found) + 1, int(hot.sum()) + (ends > 0),
                             float(part.sum()) + math.log10(ends + 0.5), float(part[ids[hot] >= symbols].sum()), rest))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))))],
                names=[*batch.schema.names[:-1], "symbols", "n_tokens", "n_hot", "hot_log", "grouped_log", "rest"])

    return docs.mapInArrow(run, "doc_id long, id_key long, text_key long, held_out boolean, symbols binary, "
                                "n_tokens long, n_hot long, hot_log double, grouped_log double, rest array<binary>")


# --- the model ------------------------------------------------------------------------------------------------------

def initial(totals: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """R, Q, C1, C2 and bias; without training the model is the smoothed symbol distribution."""
    rng = np.random.default_rng(seed)
    size = len(totals)
    bias = np.log((totals + 0.5) / (totals + 0.5).sum())
    return [x.astype(np.float32) for x in (
        rng.normal(0, 0.1, (size, WIDTH)), rng.normal(0, 0.1, (size, WIDTH)), 0.7 * np.eye(WIDTH), np.eye(WIDTH), bias)]


def triples(symbols: np.ndarray, end: int) -> np.ndarray:
    """(a, b, c) of every token of texts that stand one after the other, packed in 10 bits each; ends start a text anew."""
    s = symbols.astype(np.int64)
    first = np.concatenate(([True], s[:-1] == end))
    b = np.where(first, end, np.concatenate(([end], s[:-1])))
    second = np.concatenate(([True], first[:-1])) | first
    a = np.where(second, end, np.concatenate(([end, end], s[:-2]))[:len(s)])
    return (a << 20) | (b << 10) | s


def _scattered(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    width = values.shape[1]
    at = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, values.ravel(), size * width).reshape(size, width).astype(np.float32)


class Trainer:
    """Noise-contrastive steps over packed triples with weights; AdaGrad."""

    def __init__(self, parameters: list[np.ndarray], totals: np.ndarray, seed: int):
        self.p = [x.copy() for x in parameters]
        self.past = [np.full_like(x, 1e-2) for x in parameters]
        self.rng = np.random.default_rng(seed)
        self.noise = (totals + 0.5) / (totals + 0.5).sum()
        self.log_noise = (np.log(self.noise) + math.log(NOISE)).astype(np.float32)

    def run(self, packed: np.ndarray, weights: np.ndarray) -> None:
        order = self.rng.permutation(len(packed))
        for k in range(0, len(order), STEP):
            part = order[k:k + STEP]
            self._step(packed[part], weights[part].astype(np.float32))

    def _step(self, packed: np.ndarray, weight: np.ndarray) -> None:
        r_, q, c1, c2, bias = self.p
        size = len(bias)
        a, b, c = packed >> 20, packed >> 10 & 1023, packed & 1023
        weight = (weight / weight.sum())[:, None]
        noise = self.rng.choice(size, NOISE, p=self.noise)
        ra, rb, qc, qn = r_[a], r_[b], q[c], q[noise]
        r = ra @ c1 + rb @ c2
        real = (r * qc).sum(1) + bias[c] - self.log_noise[c]
        fake = r @ qn.T + bias[noise] - self.log_noise[noise]
        d_real = (-weight[:, 0] / (1 + np.exp(np.clip(real, -30, 30))))[:, None]
        d_fake = weight / (1 + np.exp(np.clip(-fake, -30, 30)))
        d_r = d_real * qc + d_fake @ qn
        d_q = _scattered(c, d_real * r, size)
        np.add.at(d_q, noise, d_fake.T @ r)
        d_bias = np.bincount(c, d_real[:, 0], size).astype(np.float32)
        np.add.at(d_bias, noise, d_fake.sum(0))
        d_in = _scattered(a, d_r @ c1.T, size) + _scattered(b, d_r @ c2.T, size)
        for k, grad in enumerate((d_in, d_q, ra.T @ d_r, rb.T @ d_r, d_bias)):
            self.past[k] += grad * grad
            self.p[k] -= RATE * grad / np.sqrt(self.past[k])


def log_tables(parameters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 p(c | a, b) = A[a, c] + B[b, c] - Z[a, b], normalised for every context by one matrix product."""
    r, q, c1, c2, bias = (x.astype(np.float64) for x in parameters)
    one, two = r @ c1 @ q.T, r @ c2 @ q.T + bias
    top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
    total = np.log(np.exp(one - top1) @ np.exp(two - top2).T) + top1 + top2.T
    return tuple((x / math.log(10)).astype(np.float32) for x in (one, two, total))


def _packed(parameters: list[np.ndarray]) -> bytes:
    return np.concatenate([x.ravel() for x in parameters]).astype("<f4").tobytes()


def _unpacked(data: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([x.size for x in like])
    return [data[e - x.size:e].reshape(x.shape).astype(np.float32) for e, x in zip(ends, like)]


def trained(symbols: DataFrame, counts: Counts, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Parameters after ``rounds`` rounds; round k takes the texts whose place in their partition is k modulo rounds."""
    spark = symbols.sparkSession
    parameters, totals, end = initial(counts.totals), counts.totals, counts.end
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(parameters)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k):
            trainer, at, tokens, held = Trainer(shared.value, totals, k), 0, 0, []
            waiting = 0
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    at += 1
                    if at % rounds == k:
                        held.append(data)
                        waiting += len(data) // 2
                    if waiting > 10 * HELD:
                        trainer.run(*np.unique(triples(np.frombuffer(b"".join(held), "<u2"), end), return_counts=True))
                        tokens, waiting, held = tokens + waiting, 0, []
            if waiting:
                trainer.run(*np.unique(triples(np.frombuffer(b"".join(held), "<u2"), end), return_counts=True))
                tokens += waiting
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([_packed(trainer.p)], pa.binary()),
                                                  pa.array([tokens], pa.int64())], names=["parameters", "tokens"])

        def average(batches: Iterator[pa.RecordBatch]):
            total, tokens = 0.0, 0
            for batch in batches:
                for data, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total, tokens = total + n * np.frombuffer(data, "<f4").astype(np.float64), tokens + n
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary()),
                                                  pa.array([tokens], pa.int64())], names=["parameters", "tokens"])

        kind = "parameters binary, tokens long"
        parts = symbols.mapInArrow(run, kind)
        parts = parts.repartition(max(1, math.isqrt(shuffle_partitions(spark)))).mapInArrow(average, kind).collect()
        tokens = sum(r[1] for r in parts)
        if tokens:
            mean = sum(r[1] / tokens * np.frombuffer(r[0], "<f4").astype(np.float64) for r in parts)
            parameters = _unpacked(mean, parameters)
    return parameters


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(name).alias("id_key"),
                       F.xxhash64(whole).alias("text_key"),
                       (F.crc32(name.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"), whole.alias("text"))
    table = materialize(word_counts(rows.where(~F.col("held_out"))), "word-counts")
    counts = Counts(table)
    texts = materialize(coded(rows, counts), "coded")
    parameters = trained(texts.where(~F.col("held_out")).select("symbols"), counts)
    shared = spark.sparkContext.broadcast((*log_tables(parameters), counts.end, counts.group_log))

    def run(batches: Iterator[pa.RecordBatch]):
        one, two, total, end, group_log = shared.value
        for batch in batches:
            scores = []
            for data in batch.column(0).to_pylist():
                found = triples(np.frombuffer(data, "<u2"), end)
                a, b, c = found >> 20, found >> 10 & 1023, found & 1023
                score = (one[a, c] + two[b, c] - total[a, b]).sum(dtype=np.float64)
                grouped = c[c > end] - end - 1
                scores.append(float(score - group_log[grouped].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[1:], "model"])

    kept = ["doc_id", "id_key", "text_key", "held_out", "n_tokens", "n_hot", "hot_log", "grouped_log"]
    out = texts.select(*kept, F.lit(0.0).alias("model")).schema
    per_text = texts.select("symbols", *kept).mapInArrow(run, out)
    key = ["id_key", "text_key"]
    # equal rows have one key: their words are summed over all of them and divided by their number
    rest = texts.select(*key, F.explode("rest").alias("word")).join(table, "word", "left")
    rest = rest.groupBy(*key).agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest_log"),
                                  F.count("n").alias("n_rest"))
    times = texts.groupBy(*key).agg(F.count("*").alias("times"))
    rest = rest.join(times, key).select(*key, (F.col("rest_log") / F.col("times")).alias("rest_log"),
                                        (F.col("n_rest") / F.col("times")).cast("long").alias("n_rest"))
    joined = per_text.join(rest, key, "left").withColumn("rest_log", F.coalesce("rest_log", F.lit(0.0)))
    share = math.log10(counts.tokens + 0.5 * (counts.distinct + 1))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.col("rest_log") - F.col("n_tokens") * share).alias("base_score"),
        (F.col("model") + F.col("grouped_log") + F.col("rest_log")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
