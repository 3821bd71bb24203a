"""Document scores by a gated recurrent language model with a class-factored softmax.

Word counts come from all training documents, by a shuffle of block word lists. Words have
classes: one for words seen once or never, one for each of the most frequent words, and classes by
word ending. P(word | history) = P(class | history) * P(word | class): a GRU in numpy, fitted by
truncated backpropagation on all training documents, gives the first; their counts give the second.
The state is carried across windows to the end of a document.

All training documents are dealt by hash to cells of some CELL tokens, the cells to rounds. In a
round a task per cell goes on from the same parameters, through each of its tokens; Spark adds up
what the tasks changed, weighted by tokens, and the driver gets one set of parameters. Cells and
their order come from ids and texts, so the model does not depend on how the table is cut.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.blocks import Numbers, assembled, by_bucket, documents_of, in_blocks, numbered, opened, squeezed, unpacked_bytes
from logsluice.llm.common import written

#: No word has a space, so this is the end token.
END = b" "
TOP, ENDINGS, HIDDEN, WINDOW = 63, 48, 32, 64
CLASSES = 1 + TOP + ENDINGS
#: Training tokens of a cell; rounds at most; a parameter's change times tokens is added up as a whole number of 2**-FIXED.
CELL, ROUNDS, FIXED = 1_000_000, 8, 16
#: States whose logits are taken at once, so that these stay in a core's cache.
SOFTMAX = 512


def in_training(doc_id: int | None) -> bool:
    """A null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def numbering():
    numbers = Numbers()
    return numbers, lambda text: numbers.of([*text.encode().lower().split(), END])


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Counts:
    """What the classes need of all training documents; bounded by TOP and ENDINGS."""

    tokens: int
    words: int
    once: int
    top: dict[bytes, tuple[int, int]]
    masses: list[int]

    def class_of(self, word: bytes, c: int) -> int:
        if c < 2:
            return 0
        return 1 + self.top[word][0] if word in self.top else 1 + TOP + ending(word)

    def inside(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 P(word | class). Half of class 0 is for unknown words, if any word was seen once."""
        mass = np.array([1.0] + [max(1, n) for n in [*(n for _, n in sorted(self.top.values())), *[1] * (TOP - len(self.top)), *self.masses]])
        known = np.maximum(c, 1) / mass[cls]
        rare = np.where(c == 1, 0.5 / max(1, self.once), 0.5 if self.once else 1.0)
        return np.log10(np.where(cls == 0, rare, known))


def count_words(blocks: DataFrame) -> DataFrame:
    """Training counts of the words of each block, and a summary of each bucket."""

    def solve(_: int, rows: list) -> tuple[list[bytes], bytes]:
        total: Counter[bytes] = Counter()
        for words, counts in rows:
            for w, n in zip(words, counts.tolist(), strict=True):
                total[w] += n
        masses = [0] * ENDINGS
        for w, n in total.items():
            if n > 1:
                masses[ending(w)] += n
        top = heapq.nlargest(TOP, ((n, w) for w, n in total.items() if n > 1))
        whole = {"tokens": sum(total.values()), "words": sum(n > 0 for n in total.values()), "once": sum(n == 1 for n in total.values()), "masses": masses, "top": [(n, w.hex()) for n, w in top]}
        return [squeezed(np.array([total[w] for w in words])) for words, _ in rows], json.dumps(whole).encode()

    return by_bucket(blocks, solve)


def summed(payloads: DataFrame) -> Counts:
    parts = [json.loads(bytes(r.payload)) for r in payloads.where("block is null").select("payload").collect()]
    top = heapq.nlargest(TOP, ((n, bytes.fromhex(w)) for p in parts for n, w in p["top"]))
    masses = [sum(p["masses"][k] for p in parts) for k in range(ENDINGS)]
    for n, w in top:
        masses[ending(w)] -= n
    return Counts(sum(p["tokens"] for p in parts), sum(p["words"] for p in parts), sum(p["once"] for p in parts), {w: (i, n) for i, (n, w) in enumerate(top)}, masses)


class Gru:
    """Gated recurrent units over classes; one-hot inputs, so an input is a row of a table."""

    def __init__(self, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0] if len(s) > 1 and s[0] == hidden else 4)).astype(np.float32)
        self.p = {"x": draw(classes + 1, 3 * hidden) * np.float32(0.3), "u": draw(hidden, 3 * hidden), "v": draw(hidden, classes), "c": np.zeros(classes, np.float32)}
        self.classes, self.hidden = classes, hidden

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        a, k = self.p["x"][x], self.hidden
        u = h @ self.p["u"]
        zr = 1 / (1 + np.exp(-(a[:, : 2 * k] + u[:, : 2 * k])))
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
        return (1 - z) * n + z * h, z, r, n, u[:, 2 * k :]

    def log_probs(self, hs: np.ndarray) -> np.ndarray:
        logits = hs @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=-1, keepdims=True))

    def scaled(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Input tables and state matrices of each gate as moved() takes them, those of the gates negated, the others
        doubled (tanh(x) = 1 - 2 / (1 + exp(2 x))); and the output matrix with its constants as last row."""
        parts = [(slice(g * self.hidden, (g + 1) * self.hidden), sign) for g, sign in enumerate((-1, -1, 2))]
        one, two = ([np.ascontiguousarray(self.p[name][:, at]) * self.p[name].dtype.type(sign) for at, sign in parts] for name in "xu")
        return one, two, np.vstack([self.p["v"], self.p["c"]])

    def exponentials(self, logits: np.ndarray, bounded: bool) -> np.ndarray:
        """exp of the logits (batch, classes) in place, less their largest where they could overflow."""
        if not bounded:
            logits -= logits.max(axis=1, keepdims=True)
        return np.exp(logits, out=logits)

    def bounded(self) -> bool:
        """States are within -1 and 1, so logits have a bound."""
        return bool(np.abs(self.p["v"]).sum(axis=0).max() + np.abs(self.p["c"]).max() < 60)

    def moved(self, tables: list[np.ndarray], gates: list[np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """step() on scaled() parameters. Each gate has arrays of its own, so that all of them lie in a row in memory."""
        z, r, um = (h @ g for g in gates)
        with np.errstate(over="ignore"):  # its reciprocal is 0 there
            for gate, own in ((z, tables[0]), (r, tables[1])):
                gate += own.take(x, axis=0)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            n = r * um
            n += tables[2].take(x, axis=0)
            np.exp(n, out=n)
        n += 1
        np.divide(-2, n, out=n)
        n += 1
        new = h - n
        new *= z
        new += n
        return new, z, r, n, um

    def train_window(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of one window (time, batch), back to its start; the state after it; the loss."""
        (tables, gates, outs), bounded = self.scaled(), self.bounded()
        (wide, batch), k, kind = x.shape, self.hidden, h.dtype
        fresh = (x != self.classes).astype(kind)[:, :, None]
        before, after, kept = np.empty((wide, batch, k), kind), np.ones((wide * batch, k + 1), kind), []
        for t in range(wide):
            h = np.multiply(h, fresh[t], out=before[t])
            rest = self.moved(tables, gates, x[t], h)
            kept.append(rest[1:])
            h = rest[0]
            after[t * batch : (t + 1) * batch, :k] = h
        share, wanted = (mask / max(1.0, float(mask.sum()))).astype(kind).reshape(-1), y.reshape(-1)
        gv, loss, out, ones = np.zeros_like(outs), 0.0, np.empty((wide * batch, k), kind), np.ones(self.classes, kind)
        back_v = np.ascontiguousarray(self.p["v"].T)
        for s in range(0, wide * batch, SOFTMAX):
            to = min(s + SOFTMAX, wide * batch)
            own, at = after[s:to], np.arange(to - s)
            d = self.exponentials(own @ outs, bounded)
            sums = d @ ones
            loss -= float((np.log(d[at, wanted[s:to]] / sums) * share[s:to]).sum())
            d *= (share[s:to] / sums)[:, None]
            d[at, wanted[s:to]] -= share[s:to]
            gv += own.T @ d
            out[s:to] = d @ back_v
        back, da, dn = np.zeros((batch, k), kind), np.empty((wide, batch, 3 * k), kind), np.empty((wide, batch, k), kind)
        back_zr, back_n = (np.ascontiguousarray(u.T) for u in np.split(self.p["u"], [2 * k], axis=1))
        for t in reversed(range(wide)):
            back += out[t * batch : (t + 1) * batch]
            h0, (z, r, m, um), own = before[t], kept[t], da[t]
            rest = back * (1 - z)
            new = rest * (1 - m * m)
            rest *= z
            np.multiply(rest, h0 - m, out=own[:, :k])
            um *= new
            um *= 0.5 * r * (1 - r)  # um is doubled
            own[:, k : 2 * k] = um
            own[:, 2 * k :] = new
            np.multiply(new, r, out=dn[t])
            back *= z
            back += own[:, : 2 * k] @ back_zr
            back += dn[t] @ back_n
            back *= fresh[t]
        flat, da, before = x.reshape(-1), da.reshape(-1, 3 * k), before.reshape(-1, k)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        start = np.flatnonzero(np.diff(flat[order], prepend=-1))
        gx = np.zeros_like(self.p["x"])
        gx[flat[order[start]]] = np.add.reduceat(da.take(order, axis=0), start, axis=0)
        gu = np.hstack([before.T @ da[:, : 2 * k], before.T @ dn.reshape(-1, k)])
        return {"x": gx, "u": gu, "v": gv[:k], "c": gv[k]}, h, loss

    def fit(self, sequences: list[np.ndarray], steps: int = 500, batch: int = 0, window: int = 32, rate: float = 0.01, done: float = 0.0, part: float = 1.0) -> Gru:
        """Adam over windows of streams of documents, all tokens once and on until `steps`; a stream's
        state starts at zero with each document and is carried across its windows, gradients are not.
        done: the share of the whole training that lies behind; part: that of this call."""
        start = self.classes
        long = np.concatenate([x for s in sequences for x in ([start], s)]).astype(np.int64) if sequences else np.empty(0, np.int64)
        batch = batch or (256 if len(long) >= 256 * 1024 else 64)
        if len(long) < 2 * batch:
            batch = 1
        width = -(-(len(long) - 1) // batch)
        if width < 1:
            return self
        long = np.append(long, np.full(width * batch + 1 - len(long), start))
        x, y = long[:-1].reshape(batch, width).T, long[1:].reshape(batch, width).T
        x, y = np.ascontiguousarray(x), np.ascontiguousarray(y)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        h, at = np.zeros((batch, self.hidden), np.float32), 0
        steps = max(steps, -(-width // window))
        for k in range(1, steps + 1):
            if at >= width:
                h, at = np.zeros_like(h), 0
            own, want = x[at : at + window], y[at : at + window]
            mask = (want != start).astype(np.float32)
            g, h, _ = self.train_window(own, np.where(want == start, 0, want), mask, h)
            at += window
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2 - 2 * (done + part * k / steps))
            for name, v in g.items():
                v *= min(1.0, 1.0 / (size + 1e-9))
                first[name] += 0.1 * (v - first[name])
                second[name] += 0.01 * (v * v - second[name])
                self.p[name] -= np.float32(now) * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-6)
        return self

    def score(self, sequences: list[np.ndarray], batch: int = 256) -> np.ndarray:
        """log10 probability of each class sequence, to its end. Sequences stand one behind the other in up to
        `batch` lanes, so that about as many are gone through at once whatever their lengths."""
        out = np.zeros(len(sequences))
        order = sorted((k for k in range(len(sequences)) if len(sequences[k])), key=lambda k: -len(sequences[k]))
        if not order:
            return out
        (tables, gates, outs), bounded, ones = self.scaled(), self.bounded(), np.ones(self.classes, np.float32)
        ends, lanes = [(0, k) for k in range(min(batch, len(order)))], [[] for _ in range(min(batch, len(order)))]
        for k in order:  # to the lane that ends first
            size, lane = ends[0]
            heapq.heapreplace(ends, (size + len(sequences[k]), lane))
            lanes[lane].append(k)
        lanes.sort(key=lambda own: -sum(len(sequences[k]) for k in own))
        first = [np.cumsum([0, *(len(sequences[k]) for k in own)]) for own in lanes]
        sizes, lines = np.array([f[-1] for f in first]), [np.concatenate([sequences[k] for k in own]) for own in lanes]
        # Where a sequence starts: its time, then its lane.
        starts = np.concatenate([np.stack([f[:-1], np.full(len(f) - 1, j)]) for j, f in enumerate(first)], axis=1)
        starts = starts[:, np.argsort(starts[0], kind="stable")]
        found = [np.empty(n, np.float32) for n in sizes]
        h, last = np.zeros((len(lanes), self.hidden), np.float32), np.full(len(lanes), self.classes)
        for at in range(0, int(sizes[0]), WINDOW):
            n = int((sizes > at).sum())
            wide = min(WINDOW, int(sizes[0]) - at)
            y = np.zeros((n, wide), np.int64)
            for j in range(n):
                piece = lines[j][at : at + wide]
                y[j, : len(piece)] = piece
            y, h, places = np.ascontiguousarray(y.T), h[:n], np.arange(n)
            x = np.vstack([last[:n], y[:-1]])
            own_starts = starts[:, slice(*np.searchsorted(starts[0], [at, at + wide]))]
            x[own_starts[0] - at, own_starts[1]] = self.classes
            cuts = np.searchsorted(own_starts[0], np.arange(at, at + wide + 1)).tolist()
            picked, sums = np.empty((2, wide, n), np.float32)
            own = np.ones((n, self.hidden + 1), np.float32)
            for t in range(wide):
                if cuts[t] < cuts[t + 1]:
                    h[own_starts[1, cuts[t] : cuts[t + 1]]] = 0
                own[:, :-1] = h = self.moved(tables, gates, x[t], h)[0]
                e = self.exponentials(own @ outs, bounded)
                picked[t], sums[t] = e[places, y[t]], e @ ones
            last = y[-1]
            for j, row in enumerate(np.log(picked / sums).T):
                found[j][at : at + wide] = row[: max(0, int(sizes[j]) - at)]
        for own, f, values in zip(lanes, first, found, strict=True):
            out[own] = np.add.reduceat(values.astype(np.float64), f[:-1])
        return out / np.log(10)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_flat(self, values: np.ndarray) -> Gru:
        new, at = Gru(self.classes, self.hidden), 0
        for k in sorted(self.p):
            size = self.p[k].size
            new.p[k] = values[at : at + size].astype(np.float32).reshape(self.p[k].shape)
            at += size
        return new


def trained(rows: DataFrame, tokens: int, steps: int) -> Gru:
    """The model of all rows (doc_id, classes) with so many tokens: each is trained on."""
    rounds = max(1, min(ROUNDS, -(-tokens // CELL)))
    cells = max(1, -(-tokens // (CELL * rounds)))
    model = Gru()
    for k in range(rounds):

        def task(batches: Iterator[pa.RecordBatch], k: int = k, model: Gru = model) -> Iterator[pa.RecordBatch]:
            own = [np.frombuffer(x, np.uint8) for batch in batches for x in batch.column("classes").to_pylist()]
            size = sum(map(len, own))
            if size:
                before = model.flat().astype(np.float64)
                after = model.with_flat(before).fit(own, -(-steps * size // max(size, tokens)), done=k / rounds, part=1 / rounds).flat()
                changes = np.rint((after - before) * size * 2.0**FIXED).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(changes), dtype=np.int32)), pa.array(np.append(size, changes))], names=["at", "value"])

        own = rows.where(F.pmod(F.xxhash64(F.lit("round"), "doc_id", "classes"), F.lit(rounds)) == k)
        own = own.repartition(cells, F.xxhash64("doc_id", "classes")).sortWithinPartitions("doc_id", "classes")
        sums = own.mapInArrow(task, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()
        if sums.num_rows:
            size, *changes = sums.column("value").to_pylist()
            model = model.with_flat(model.flat() + np.array(changes, np.float64) / (size * 2.0**FIXED))
    return model


def scored(docs: DataFrame, steps: int = 500) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Counts are over all training documents, and the GRU is fitted on all of them: on each token at
    least once, `steps` steps at least. Null and empty texts have the end token only. Repeated rows
    are scored each; without training documents all words are unknown.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = written(in_blocks(docs, numbering, in_training), "blocks")
    payloads = written(count_words(blocks), "counts")
    counts = summed(payloads)

    def looked_up(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [(n, opened(p).astype(np.int64), unpacked_bytes(w)) for n, w, p in numbered(left, right)]
        size = sum(len(p[0]) for p in parts)
        c, cls = np.zeros(size, np.int64), np.zeros(size, np.uint8)
        for numbers, own, words in parts:
            c[numbers] = own
            cls[numbers] = [counts.class_of(w, n) for w, n in zip(words, own.tolist(), strict=True)]
        return c, cls

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        c, cls = looked_up(left, right)
        base, inside = np.log10((c + 1) / (counts.tokens + counts.words + 1)), counts.inside(cls, c)
        rows = list(documents_of(left))
        return pa.table({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "held_out": pa.array([not r[1] for r in rows]), "n_tokens": pa.array([len(r[2]) for r in rows], pa.int64()),
            "n_known": pa.array([int((c[n] > 0).sum()) for _, _, n in rows], pa.int64()), "base_score": pa.array([float(base[n].sum()) for _, _, n in rows]),
            "inside": pa.array([float(inside[n].sum()) for _, _, n in rows]), "classes": pa.array([cls[n].tobytes() for _, _, n in rows], pa.binary()),
        })

    rows = written(assembled(blocks, payloads, put, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes binary"), "classes")
    model = trained(rows.where("not held_out").select("doc_id", "classes"), counts.tokens, steps)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score([np.frombuffer(x, np.uint8) for x in batch.column("classes").to_pylist()])
            columns = {n: batch.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known")}
            columns |= {"train_tokens": pa.array([counts.tokens] * len(found), pa.int64()), "base_score": batch.column("base_score")}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(found + batch.column("inside").to_numpy())})

    return rows.mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
