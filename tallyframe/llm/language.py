"""Language of documents from a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a window of bytes from either side; every position gets
a distribution over the languages, and a document's distribution is the mean over all
its bytes.  Training is back-propagation through time in numpy on the driver, from a
bounded sample of labelled rows: ``SAMPLE`` documents per language and four pieces of
``PIECE`` code points from each.  Prediction reads whole texts, in windows of ``SPAN``
bytes that are stepped through side by side.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.0; rows
without a label are predicted and not learnt from; repeated rows are predicted alike;
with no labelled row every text is ``und``; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.tables import cells_of, in_batches, packed, read, rows_of, unpacked

UNKNOWN = "und"
HIDDEN, SPAN, LANES = 8, 128, 2048
SAMPLE, PIECE = 300, 160
#: The sample and the counts of languages pass through the driver.
MOST_LANGUAGES = 500
STEPS, BATCH, LENGTH, RATE = 260, 128, 48, 0.02
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, np.float32(0.5), out=x)
    np.tanh(x, out=x)
    np.multiply(x, np.float32(0.5), out=x)
    np.add(x, np.float32(0.5), out=x)
    return x


class Network:
    """Weights per direction: ``x`` maps a byte to gate inputs, ``u`` the state, ``v`` the reset state."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        self.languages = languages
        self.w = {}
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, 0.3, (h, 2 * h)).astype(np.float32)
            self.w[f"v{d}"] = rng.normal(0, 0.3, (h, h)).astype(np.float32)
            self.w[f"o{d}"] = rng.normal(0, 0.3, (h, n)).astype(np.float32)
        self.w["c"] = np.zeros(n, np.float32)

    def step(self, d: str, seen: np.ndarray, state: np.ndarray):
        """One step of a direction: (new state, what back-propagation needs)."""
        h, w = HIDDEN, self.w
        inputs = w[f"x{d}"][seen]
        gates = sigmoid(inputs[:, : 2 * h] + state @ w[f"u{d}"])
        update, reset = gates[:, :h], gates[:, h:]
        kept = reset * state
        fresh = np.tanh(inputs[:, 2 * h :] + kept @ w[f"v{d}"])
        return state + update * (fresh - state), (update, reset, kept, fresh)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over all positions of byte windows ``x`` (time, lane) with classes ``y``, and its gradients."""
        h, w, (steps, lanes) = HIDDEN, self.w, x.shape
        states, notes = {}, {}
        for d in ("f", "b"):
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            state, states[d], notes[d] = np.zeros((lanes, h), np.float32), [None] * steps, [None] * steps
            for t in order:
                before = state
                state, note = self.step(d, x[t], state)
                states[d][t], notes[d][t] = state, (before, *note)
        hidden = {d: np.stack(states[d]) for d in ("f", "b")}
        logits = hidden["f"] @ w["of"] + hidden["b"] @ w["ob"] + w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        lane = np.arange(lanes)
        loss = float(-np.log(p[:, lane, y] + 1e-9).mean())
        p[:, lane, y] -= 1
        p /= steps * lanes
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["c"] = p.sum(axis=(0, 1))
        for d in ("f", "b"):
            grad[f"o{d}"] = np.einsum("tlh,tlc->hc", hidden[d], p, optimize=True)
            outward, carry = p @ w[f"o{d}"].T, np.zeros((lanes, h), np.float32)
            order = range(steps - 1, -1, -1) if d == "f" else range(steps)
            for t in order:
                before, update, reset, kept, fresh = notes[d][t]
                carry = carry + outward[t]
                to_fresh = carry * update * (1 - fresh * fresh)
                to_kept = to_fresh @ w[f"v{d}"].T
                to_gates = np.concatenate(
                    [carry * (fresh - before) * update * (1 - update), to_kept * before * reset * (1 - reset)], axis=1
                )
                grad[f"v{d}"] += kept.T @ to_fresh
                grad[f"u{d}"] += before.T @ to_gates
                np.add.at(grad[f"x{d}"], x[t], np.concatenate([to_gates, to_fresh], axis=1))
                carry = carry * (1 - update) + to_kept * reset + to_gates @ w[f"u{d}"].T
        return loss, grad

    def fit(self, texts: list[bytes], classes: list[int], seed: int = 11) -> float:
        """Adam over windows that start anywhere in the pieces; every class is drawn equally often."""
        rng = np.random.default_rng(seed)
        by_class = [[i for i, c in enumerate(classes) if c == k] for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for n in range(1, STEPS + 1):
            y = rng.integers(0, len(by_class), BATCH)
            x = np.zeros((LENGTH, BATCH), np.uint8)
            for lane, c in enumerate(y):
                text = texts[by_class[c][rng.integers(len(by_class[c]))]]
                start = rng.integers(0, max(1, len(text) - LENGTH + 1))
                part = (text[start : start + LENGTH] * LENGTH)[:LENGTH]
                x[:, lane] = np.frombuffer(part, np.uint8)
            loss, grad = self.gradients(x, y)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.9 * n / STEPS)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        return loss

    def sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per lane, the position distributions summed over its own bytes; ``x`` is (time, lane)."""
        steps, lanes = x.shape
        real = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        state, ahead = np.zeros((lanes, HIDDEN), np.float32), []
        for t in range(steps):
            state, _ = self.step("f", x[t], state)
            ahead.append(state @ self.w["of"])
        state, total = np.zeros((lanes, HIDDEN), np.float32), np.zeros((lanes, len(self.languages)), np.float32)
        for t in range(steps - 1, -1, -1):
            state, _ = self.step("b", x[t], state)
            state *= real[t][:, None]  # a shorter lane starts at its own last byte
            p = ahead[t] + state @ self.w["ob"] + self.w["c"]
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            p *= (real[t] / p.sum(axis=1))[:, None]
            total += p
        return total

    def predict(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """(key, language, score) for (key, text), in order; only ``LANES`` windows are held at a time."""
        waiting: list[list] = []  # key, bytes still open, byte count, sum of distributions
        lanes: list[tuple[list, bytes]] = []

        def run() -> Iterator[tuple]:
            x = np.zeros((SPAN, len(lanes)), np.uint8)
            for i, (_, part) in enumerate(lanes):
                x[: len(part), i] = np.frombuffer(part, np.uint8)
            lengths = np.array([len(part) for _, part in lanes])
            for (entry, part), p in zip(lanes, self.sums(x, lengths).astype(float)):
                entry[1] -= len(part)
                entry[3] = entry[3] + p
            lanes.clear()
            while waiting and not waiting[0][1]:
                yield done(waiting.pop(0))

        def done(entry: list) -> tuple:
            if not entry[2]:
                return entry[0], UNKNOWN, 0.0
            mean = entry[3] / entry[2]
            best = int(np.argmax(mean))
            return entry[0], self.languages[best], min(1.0, float(mean[best]))

        for key, text in rows:
            known = bool(self.languages) and text is not None and any(map(str.isalpha, text))
            raw = text.encode("utf-8", "surrogatepass") if known else b""
            entry = [key, len(raw), len(raw), 0.0]
            waiting.append(entry)
            for start in range(0, len(raw), SPAN):
                lanes.append((entry, raw[start : start + SPAN]))
                if len(lanes) == LANES:
                    yield from run()
            if not lanes:
                yield from run()
        if lanes:
            yield from run()
        for entry in waiting:
            yield done(entry)


def crc_class(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def train(docs: DataFrame, per_language: int = SAMPLE) -> Network:
    """A network from a sample of the labelled rows whose crc class is not 2.

    The sample is set by a threshold on a hash of the id, so it needs no sort; it has
    about ``per_language`` rows a language and at most twice that.
    """
    fit = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.coalesce(crc_class(F.col("doc_id")) != 2, F.lit(False)))
    counted = fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    counts = {r["lang"]: r["n"] for r in counted}
    languages = sorted(counts)
    if not languages:
        return Network([])
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    length = F.length("text")
    pieces = [
        F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), length - PIECE)) + 1).cast("int"), F.lit(PIECE))
        for k in range(4)
    ]
    chosen = fit.filter(draw).select("doc_id", "lang", F.array(*pieces).alias("pieces"))
    rows = sorted((tuple(r) for r in chosen.limit(2 * per_language * len(languages)).collect()), key=lambda r: (r[0], r[2]))
    samples = [(t.encode("utf-8", "surrogatepass"), languages.index(lang)) for _, lang, texts in rows for t in texts if t]
    present = sorted({c for _, c in samples})
    network = Network([languages[c] for c in present])
    network.fit([t for t, _ in samples], [present.index(c) for _, c in samples])
    return network


def predicted(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""

    def work(batches):
        rows = (((doc, out), text) for doc, out, text in rows_of(batches, "doc_id", "held_out", "text"))
        yield from in_batches(((*key, lang, score) for key, lang, score in network.predict(rows)), SCHEMA)

    held_out = F.coalesce(crc_class(F.col("doc_id")) == 2, F.lit(False))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    return asked.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, network: Network, least_score: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose language is known; a text without letters or of no clear language goes."""
    rows, place = packed(docs), docs.columns.index("text")

    def work(batches):
        for batch in batches:
            found = network.predict(enumerate(cells_of(batch.column("row"), place)))
            kept = [lang != UNKNOWN and score >= least_score for _, lang, score in found]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return unpacked(rows.mapInArrow(work, rows.schema), docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of a known language, all columns unchanged."""
    return keep_known(docs, train(docs))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predicted(docs, train(docs))
