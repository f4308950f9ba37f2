"""Language ID by a bidirectional gated recurrent network over bytes.

Every byte of a text gets a distribution over languages from a forward and a
backward GRU; a document's is the mean of its bytes'. Texts are cut into
stretches of ``SEGMENT`` bytes which the network reads by themselves, so whole
texts of any length are read in bounded memory.

The network is trained here, in numpy, by backpropagation through time, on every
labelled language: on at most ``per_lang`` documents of each (those with the smallest hashes of
id and text, among those with a letter) and ``SNIPPET`` characters of a document. The driver holds a
network with an output for each language. Ids choose who is learned from; neither they nor
labels enter a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as
is every text where nothing is labelled; a text of any length is read whole; a row without an id
is not held out and never learned from; repeated rows count as often as they occur; equal rows
may each be in the sample; languages that tie go to the
one first in the alphabet; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import map_rows

SEGMENT, HIDDEN, SNIPPET, PAD = 64, 8, 1500, 256
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
GROUP, CHUNK = 4096, 1 << 20


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Parameters of both directions and of the labels; rows of ``W`` belong to bytes, the last one to padding."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        w = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", w(PAD + 1, 3 * hidden)), ("U", w(hidden, 3 * hidden)), ("c", np.zeros(hidden, np.float32)), ("V", w(hidden, n_labels)))}
        self.p["o"] = np.zeros(n_labels, np.float32)

    def _direction(self, d: str, x: np.ndarray):
        """States (T, B, H) of one direction with what backpropagation needs; x is (T, B) in reading order."""
        h = self.h
        W, U, c = self.p["W" + d], self.p["U" + d], self.p["c" + d]
        s, states, kept = np.zeros((x.shape[1], h), np.float32), [], []
        for row in x:
            a, u = W[row], s @ U
            z, r = sigmoid(a[:, :h] + u[:, :h]), sigmoid(a[:, h : 2 * h] + u[:, h : 2 * h])
            q = u[:, 2 * h :] + c
            n = np.tanh(a[:, 2 * h :] + r * q)
            kept.append((s, z, r, q, n))
            s = n + z * (s - n)
            states.append(s)
        return states, kept

    def loss_and_gradients(self, x: np.ndarray, labels: np.ndarray):
        """Mean cross-entropy over positions of (T, B) bytes, and its gradients by backpropagation through time."""
        T, B = x.shape
        hf, kf = self._direction("f", x)
        hb, kb = self._direction("b", x[::-1])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        df, db, loss = [None] * T, [None] * T, 0.0
        real = (x != PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        for t in range(T):
            f, b = hf[t], hb[T - 1 - t]
            logit = f @ self.p["Vf"] + b @ self.p["Vb"] + self.p["o"]
            e = np.exp(logit - logit.max(1, keepdims=True))
            prob = e / e.sum(1, keepdims=True)
            loss -= float((np.log(prob[np.arange(B), labels] + 1e-9) * real[t]).sum())
            prob[np.arange(B), labels] -= 1
            prob *= real[t][:, None] / total
            g["Vf"] += f.T @ prob
            g["Vb"] += b.T @ prob
            g["o"] += prob.sum(0)
            df[t], db[T - 1 - t] = prob @ self.p["Vf"].T, prob @ self.p["Vb"].T
        self._back("f", x, kf, df, g)
        self._back("b", x[::-1], kb, db, g)
        return loss / total, g

    def _back(self, d: str, x, kept, into, g) -> None:
        h, U = self.h, self.p["U" + d]
        ds, ga = np.zeros_like(into[0]), []
        for t in range(len(x) - 1, -1, -1):
            s, z, r, q, n = kept[t]
            dh = into[t] + ds
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (s - n) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            g["U" + d] += s.T @ du
            g["c" + d] += (dn * r).sum(0)
            ds = dh * z + du @ U.T
            ga.append((x[t], da))
        rows, vals = np.concatenate([a for a, _ in ga]), np.concatenate([b for _, b in ga])
        order = np.argsort(rows, kind="stable")
        rows, vals = rows[order], vals[order]
        at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        g["W" + d][rows[at]] += np.add.reduceat(vals, at, axis=0)

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over batches that draw every language equally often; (N, T) segments."""
        rng, losses = np.random.default_rng(seed), []
        by = [np.flatnonzero(labels == k) for k in range(len(self.p["o"]))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, batch // len(by) + 1) for r in by if len(r)])
            loss, g = self.loss_and_gradients(segments[pick].T, labels[pick])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (steps + 1 - i) / steps)
            for k, w in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                w -= lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)
        return losses

    def reader(self):
        """A function from (B, T) segments to the sums (B, K) of their positions' probabilities.

        Gates are laid out feature by feature, with the halves of the sigmoids folded into the weights.
        """
        h, p = self.h, {}
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)
        for d in "fb":
            W = self.p["W" + d].copy()
            W[PAD] = 0
            W[PAD, :h] = 40  # a closed gate: padding leaves the state as it is
            p[d] = ((W * half).T.copy(), (self.p["U" + d] * half).T.copy(), self.p["c" + d][:, None].copy(), self.p["V" + d].T.copy())
        o = self.p["o"][:, None]

        def direction(d, x, order):
            W, U, c, V = p[d]
            s = np.zeros((h, x.shape[1]), np.float32)
            out = np.empty((len(x), len(V), x.shape[1]), np.float32)
            for t in order:
                a, u = W.take(x[t], axis=1), U @ s
                zr = a[: 2 * h]
                zr += u[: 2 * h]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                n = u[2 * h :]
                n += c
                n *= zr[h:]
                n += a[2 * h :]
                np.tanh(n, out=n)
                s -= n
                s *= zr[:h]
                s += n
                np.matmul(V, s, out=out[t])
            return out

        def read(segments: np.ndarray) -> np.ndarray:
            x = np.ascontiguousarray(segments.T).astype(np.intp)
            logit = direction("f", x, range(len(x)))
            logit += direction("b", x, range(len(x) - 1, -1, -1))
            logit += o
            np.exp(np.clip(logit, -30, 30, out=logit), out=logit)
            logit /= logit.sum(1, keepdims=True)
            logit *= (x != PAD)[:, None, :]
            return logit.sum(0).T

        return read


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (N, SEGMENT) of all texts and the text that each is from."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), count)
    flat = np.full(int(count.sum()) * SEGMENT, PAD, dtype=np.int16)
    starts = np.concatenate(([0], np.cumsum(count)[:-1])) * SEGMENT if len(texts) else sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) if len(texts) else sizes
    flat[np.arange(len(data)) + shift] = data
    return flat.reshape(-1, SEGMENT), owner


def probabilities(read, texts: list[bytes], n_labels: int) -> np.ndarray:
    """Mean distribution of each text's positions; about ``CHUNK`` bytes of texts are laid out at a time."""
    total = np.zeros((len(texts), n_labels))
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 == len(texts):
            segments, owner = cut(texts[at : i + 1])
            group = max(16, min(GROUP, (1 << 17) // n_labels))  # bounds what the network writes down
            for k in range(0, len(segments), group):
                np.add.at(total, at + owner[k : k + group], read(segments[k : k + group]))
            at, size = i + 1, 0
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def split(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return d.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> list[tuple[str, str]]:
    """``(lang, snippet)`` of at most ``per_lang`` documents of every labelled language, in two passes.

    Languages are counted first; of each, those rows are drawn whose hashes are below a bound that about
    twice ``per_lang`` of them meet, or are the least, so that few rows are ranked, however common it is.
    """
    seen = split(docs, id_col, text_col, lang_col).where("NOT held_out AND lang IS NOT NULL AND doc_id IS NOT NULL AND text RLIKE '\\\\p{L}'").withColumn("o", F.xxhash64("doc_id", "text"))
    counts = seen.groupBy("lang").agg((F.lit(2.0 * per_lang) / F.count("*")).alias("share"), F.min("o").alias("least")).collect()  # a row for each language, as the network has an output for each
    bounds = docs.sparkSession.createDataFrame(counts, "lang string, share double, least long")
    drawn = seen.join(F.broadcast(bounds), "lang").where("CAST(o AS DOUBLE) / 18446744073709551616D + 0.5D < share OR o = least")
    start = 1 + F.pmod("o", F.greatest(F.lit(1), F.length("text") - SNIPPET)).cast("int")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id"))
    rows = drawn.select("lang", "o", "doc_id", F.substring("text", start, F.lit(SNIPPET)).alias("text")).withColumn("rank", rank).where(F.col("rank") <= per_lang)
    return [(r["lang"], r["text"]) for r in rows.orderBy("lang", "rank").collect()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> tuple[list[str], BiGru | None]:
    """Languages and the trained network; both grow with the number of languages, neither with that of documents."""
    rows = sample(docs, id_col, text_col, lang_col, per_lang)
    if not rows:
        return [], None
    langs = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    segments, owner = cut([text.encode() for _, text in rows])
    many = len(langs) > 8  # needs a larger network, read in more steps
    net = BiGru(len(langs), min(32, len(langs)) if many else HIDDEN)
    net.train(segments, np.array([number[lang] for lang, _ in rows])[owner], 600 if many else 400)
    return langs, net


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", langs=None, net: BiGru | None = None) -> DataFrame:
    """Every document's language. One pass to choose the sample, one to predict; nothing is shuffled.

    The broadcast network has a fixed size.
    """
    if langs is None:
        langs, net = fit(docs, id_col, text_col, lang_col)
    source = split(docs, id_col, text_col, lang_col).select("doc_id", "held_out", "text")

    def make():
        read = net.reader() if net else None

        def step(b):
            rows = b.column("text").to_pylist()
            known = [i for i, t in enumerate(rows) if read and t and any(c.isalpha() for c in t)]
            pred, score = ["und"] * len(rows), [0.0] * len(rows)
            if known:
                prob = probabilities(read, [rows[i].encode() for i in known], len(langs))
                for i, k, s in zip(known, prob.argmax(1), prob.max(1)):
                    pred[i], score[i] = langs[k], min(1.0, float(s))
            return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pred, "score": score}

        return step

    return map_rows(source, make, SCHEMA)
