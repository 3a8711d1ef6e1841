"""Operator 4: scoring by a gated recurrent language model in numpy.

The most frequent words are outputs of a softmax over classes and, within a class, over its words; all other words
share one output and are told apart by their counts. Output offsets begin as the logarithms of corpus-wide counts, so
that an untrained model is the smoothed unigram model. Training goes once over all training documents, in rounds, each
dealt into shards that grow in number with the corpus: each task runs truncated backpropagation over its shard, and
the shards' weights are averaged in a tree. Scoring carries the state through whole documents, window by window.

Texts are read twice, for the counts and for a table of each document as ids; training and scoring read that table.
Rounds, shards and the order within one follow from ids and texts alone, not from how the table lies in partitions.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, cut, drop, hot_bound, small_batches

#: Words of the softmax, a class's words at most, words whose counts are broadcast: fixed bounds at any size of the corpus.
KEPT, CLASS_SIZE, HOT_WORDS = 8_192, 512, 1 << 18
HIDDEN, WINDOW, LANES = 16, 16, 1024
#: Rounds that the training documents are dealt over, so that each takes part in one.
SHARE = 6
#: Tokens of a shard, about, and shards whose weights a task averages.
SHARD_TOKENS, FAN_IN = 1_200_000, 32
RATE, DECAY, CLIP = 0.03, 0.95, 1.0
#: Bytes of text whose words a task holds to count or number them at once.
GROUP = 24 << 20
#: Scoring: tokens in memory, documents side by side, steps of a window.
BUFFER, SCORE_LANES, SCORE_WINDOW = 4_000_000, 512, 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, as bytes with A-Z in lower case, and the number of each text's."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at a text's ends leaves empty parts
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[real], minlength=len(texts))
        flat = flat.filter(pa.array(real))
    return flat.cast(pa.binary()), sizes


def groups(batches, column: int):
    """Lists of (batch, words, sizes) of the column's texts, with about GROUP bytes of text each; what their making took is given back at the end."""
    group, size = [], 0
    for b in batches:
        group.append((b.drop_columns([b.schema.names[column]]), *words_of(b.column(column))))
        size += b.column(column).nbytes
        if size > GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group
    del group
    pa.default_memory_pool().release_unused()


def counts_of(group) -> pa.RecordBatch:
    """word, n of a group's distinct words."""
    return pa.RecordBatch.from_arrays(pc.value_counts(pa.chunked_array([flat for _, flat, _ in group])).flatten(), names=["word", "n"])


def classes(counts: np.ndarray) -> np.ndarray:
    """Edges of classes over counts in falling order. A word of probability p lies in a class of about 1 / sqrt(p) words,
    which makes the terms of both softmaxes together fewest on average."""
    edges, p = [0], counts / counts.sum()
    while edges[-1] < len(p):
        edges.append(min(len(p), edges[-1] + int(min(CLASS_SIZE, max(1, round(p[edges[-1]] ** -0.5))))))
    return np.array(edges)


def sigmoid(x: np.ndarray) -> None:
    """In place. By exp, which takes less time than tanh; where it overflows, 0 is right."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Gru:
    """Ids: 0 the end, 1 any rare word, then the kept words by falling count. Weights by name in p; those of outputs, O and o, lie by place."""

    NAMES = ("E", "Wx", "U", "b", "C", "c", "O", "o")

    def __init__(self, counts: np.ndarray, rng: np.random.Generator, hidden: int = HIDDEN):
        """counts: of each id, plus one (the rare ones': plus one for each word and one for unseen words)."""
        k, h = len(counts), hidden
        self.order_classes(counts)
        n = lambda *s: (rng.standard_normal(s) * 0.3 / np.sqrt(h)).astype(np.float32)
        self.p = {"E": n(k, h) * 2, "Wx": n(h, 3 * h) * 2, "U": n(h, 3 * h) * 2, "b": np.zeros(3 * h, np.float32), "C": np.zeros((h, self.n_classes), np.float32), "O": np.zeros((k, h), np.float32)}
        total = np.bincount(self.cls, weights=counts, minlength=self.n_classes)
        self.p["c"] = np.log(total / total.sum()).astype(np.float32)
        self.p["o"] = np.empty(k, np.float32)
        self.p["o"][self.place] = np.log(counts / total[self.cls])

    def order_classes(self, counts: np.ndarray) -> None:
        """Ids get places by falling count, such that a class is a range of places."""
        by = np.argsort(-counts, kind="stable")
        self.place = np.empty(len(counts), np.uint16 if len(counts) <= 1 << 16 else np.int32)  # 16 bits sort in linear time
        self.place[by] = np.arange(len(counts))
        self.edges = classes(counts[by])
        self.cls = (np.searchsorted(self.edges, self.place, "right") - 1).astype(np.uint16)
        self.n_classes = len(self.edges) - 1
        self.counts = counts

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, counts=self.counts, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Gru:
        z, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.order_classes(z["counts"])
        self.p = {k: z[k] for k in cls.NAMES}
        return self

    def size(self) -> int:
        return sum(self.p[k].size for k in self.NAMES)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def unflat(self, x: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            self.p[k] = x[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size

    def safe(self) -> bool:
        """Whether no output before the exponential can overflow; states lie within -1 and 1."""
        p = self.p
        return max(float((abs(p["C"]).sum(0) + abs(p["c"])).max()), float((abs(p["O"]).sum(1) + abs(p["o"])).max())) < 60

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None, safe: bool = False):
        """Natural log-probabilities of ids y after states h; with grads, their gradients are added and that of h returned.

        Inside, a state is a column that ends with 1, so that one product makes biases and their gradients too, and sums over outputs are products with ones.
        """
        p, place, (n, H) = self.p, self.place[y], h.shape
        order = np.argsort(place, kind="stable")  # by place, so that each class is a slice
        place, hs, logp = place[order], np.ones((H + 1, n), np.float32), np.empty(n, np.float32)
        np.take(h.T, order, 1, out=hs[:H], mode="clip")
        ends = [*np.searchsorted(place, self.edges[:-1].astype(place.dtype)).tolist(), n]
        spans = [(k, slice(ends[k], ends[k + 1])) for k in range(self.n_classes) if ends[k] < ends[k + 1]]
        z = np.concatenate([p["C"], p["c"][None]]).T @ hs
        if not safe:
            z -= z.max(0)
        for k, at in spans:
            logp[at] = z[k, at]
        np.exp(z, out=z)
        total, dh = np.ones(len(z), np.float32) @ z, None
        if grads is not None:
            weight = weight[order]
            scale = weight / total
            for k, at in spans:
                z[k, at] -= total[at]
            g = (hs * scale) @ z.T
            grads["C"] += g[:H]
            grads["c"] += g[H]
            dh = p["C"] @ z
            dh *= scale
        outs, rows = np.concatenate([p["O"], p["o"][:, None]], 1), np.arange(n)
        for k, at in spans:
            ids, hk = slice(self.edges[k], self.edges[k + 1]), hs[:, at]
            if ids.stop - ids.start == 1:
                continue  # the class is the word
            z = outs[ids] @ hk
            if not safe:
                z -= z.max(0)
            flat, own = z.reshape(-1), (place[at] - place.dtype.type(ids.start)) * np.intp(at.stop - at.start)
            own += rows[: len(own)]
            logp[at] += flat[own]
            np.exp(z, out=z)
            sums = np.ones(len(z), np.float32) @ z
            if grads is not None:
                scale = weight[at] / sums
                flat[own] -= sums
                g = z @ (hk * scale).T
                grads["O"][ids] += g[:, :H]
                grads["o"][ids] += g[:, H]
                back = p["O"][ids].T @ z
                back *= scale
                dh[:, at] += back
            total[at] *= sums
        logp -= np.log(total)
        out = np.empty_like(logp)
        out[order] = logp
        if dh is not None:
            back = np.empty_like(order)
            back[order] = rows
            dh = np.take(dh, back, 1).T
        return out, dh

    def train(self, flat: np.ndarray, rate: float = RATE) -> None:
        """One pass of truncated backpropagation over ids of documents, each ending with 0. The state is carried from window to window and cleared at a document's end. Lanes are columns."""
        if not len(flat):
            return
        p, H = self.p, self.p["U"].shape[0]
        lanes = max(1, min(LANES, len(flat) // (4 * WINDOW)))
        steps = -(-len(flat) // lanes)
        y_all, real = np.zeros(steps * lanes, np.int32), np.zeros(steps * lanes, np.float32)
        y_all[: len(flat)], real[: len(flat)] = flat, 1  # what fills up the last lane has no weight
        y_all, real = np.ascontiguousarray(y_all.reshape(lanes, steps).T), np.ascontiguousarray(real.reshape(lanes, steps).T)
        x_all = np.concatenate([np.zeros((1, lanes), np.int32), y_all[:-1]])
        x_all[0, 1:] = y_all[-1, :-1]  # a lane goes on where the one before ends
        past = {k: np.full(p[k].shape, 1e-6, np.float32) for k in self.NAMES}
        h = np.zeros((H, lanes), np.float32)
        windows = -(-steps // WINDOW)
        for w in range(windows):
            at = slice(w * WINDOW, (w + 1) * WINDOW)
            x, y, weight = x_all[at], y_all[at], real[at]
            T = len(x)
            xs = np.take(p["E"], x, 0)
            keep = (x != 0).astype(np.float32)
            prev, zr, n, un = (np.empty((T, k, lanes), np.float32) for k in (H, 2 * H, H, H))
            hs, into, bias = np.empty((H, T, lanes), np.float32), np.ascontiguousarray(p["Wx"].T), p["b"][:, None]
            own = np.ascontiguousarray(p["U"].T)
            for t in range(T):
                np.multiply(h, keep[t], out=prev[t])
                e, u = into @ xs[t].T, own @ prev[t]
                e += bias
                g = np.add(e[: 2 * H], u[: 2 * H], out=zr[t])
                sigmoid(g)
                un[t] = u[2 * H :]
                a = np.multiply(g[H:], un[t], out=n[t])
                a += e[2 * H :]
                np.tanh(a, out=a)
                h = prev[t] - a
                h *= g[:H]
                h += a
                hs[:, t] = h
            g = {k: np.zeros_like(p[k]) for k in ("C", "c", "O", "o", "U")}
            share = (weight / max(weight.sum(), 1)).ravel()
            _, dh_out = self.outputs(hs.reshape(H, -1).T, y.ravel(), g, share, self.safe())
            dh_out = dh_out.T.reshape(H, T, lanes)
            d, du, dx = np.empty((3 * H, lanes), np.float32), np.empty((3 * H, lanes), np.float32), np.empty((T, lanes, H), np.float32)
            dh, g["Wx"], g["b"] = np.zeros((H, lanes), np.float32), np.zeros_like(p["Wx"]), np.zeros_like(p["b"])
            ones = np.ones(lanes, np.float32)
            for t in reversed(range(T)):
                z, r = zr[t][:H], zr[t][H:]
                dh += dh_out[:, t]
                left = 1 - z
                dz = np.multiply(prev[t] - n[t], z, out=d[:H])
                dz *= left
                dz *= dh
                dn = np.multiply(n[t], n[t], out=d[2 * H :])
                np.subtract(1, dn, out=dn)
                dn *= left
                dn *= dh
                dr = np.subtract(1, r, out=d[H : 2 * H])
                dr *= r
                dr *= un[t]
                dr *= dn
                du[: 2 * H] = d[: 2 * H]
                np.multiply(dn, r, out=du[2 * H :])
                g["U"] += prev[t] @ du.T
                g["Wx"] += xs[t].T @ d.T
                g["b"] += d @ ones
                np.matmul(d.T, into, out=dx[t])
                dh *= z
                dh += p["U"] @ du
                dh *= keep[t]
            order = np.argsort(x.ravel().astype(np.uint16) if len(self.counts) <= 1 << 16 else x.ravel(), kind="stable")
            own = x.ravel()[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            ids, gE = own[first], np.add.reduceat(np.take(dx.reshape(-1, H), order, 0), first, axis=0)
            norm = np.sqrt(sum(float(np.vdot(v, v)) for v in (*g.values(), gE)))
            scale, step = min(1.0, CLIP / (norm + 1e-9)), rate * (1 - 0.9 * w / windows)
            for k in self.NAMES:
                grad = gE if k == "E" else g[k]
                grad *= np.float32(scale)
                mean = past[k][ids] if k == "E" else past[k]
                mean *= np.float32(DECAY)
                mean += np.float32(1 - DECAY) * grad * grad
                if k == "E":
                    past[k][ids] = mean
                by = np.sqrt(mean)
                by += np.float32(1e-4)
                np.divide(grad, by, out=by)
                by *= np.float32(step)
                p[k][ids if k == "E" else slice(None)] -= by

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each document of ids that ends with 0, over its whole length. Memory is that of all ids and of a window."""
        if not docs:
            return np.zeros(0)
        p, H, safe = self.p, self.p["U"].shape[0], self.safe()
        size = np.array([len(d) for d in docs])
        # documents go to lanes, longest first, each to the shortest lane
        heap = [(0, k) for k in range(min(SCORE_LANES, len(docs)))]
        lanes: list[list[int]] = [[] for _ in heap]
        for i in np.argsort(-size, kind="stable").tolist():
            n, k = heap[0]
            lanes[k].append(i)
            heapq.heapreplace(heap, (n + int(size[i]), k))
        lanes.sort(key=lambda own: -int(size[own].sum()))
        order = np.concatenate(lanes)
        flat = np.concatenate([docs[i] for i in order])
        before = np.concatenate([np.zeros(1, flat.dtype), flat[:-1]])  # each lane begins after an end, too
        filled = np.array([int(size[own].sum()) for own in lanes])
        begin, steps = np.cumsum(filled) - filled, int(filled[0])
        active = len(lanes) - np.searchsorted(filled[::-1], np.arange(steps), "right")
        logp, h = np.empty(len(flat), np.float32), np.zeros((H, len(lanes)), np.float32)
        into, bias, own = np.ascontiguousarray(p["Wx"].T), p["b"][:, None], np.ascontiguousarray(p["U"].T)
        for w in range(0, steps, SCORE_WINDOW):
            ends = active[w : w + SCORE_WINDOW].tolist()
            hs, done, places = np.empty((H, sum(ends)), np.float32), 0, []
            for t, a in enumerate(ends, w):
                places.append(begin[:a] + t)
                x, h = before[places[-1]], h[:, :a]
                h = h * (x != 0)
                e, u = into @ np.take(p["E"], x, 0).T, own @ h
                e += bias
                zr = e[: 2 * H]
                zr += u[: 2 * H]
                sigmoid(zr)
                n = u[2 * H :]
                n *= zr[H:]
                n += e[2 * H :]
                np.tanh(n, out=n)
                h -= n
                h *= zr[:H]
                h += n
                hs[:, done : done + a] = h
                done += a
            places = np.concatenate(places)
            logp[places] = self.outputs(hs.T, flat[places], safe=safe)[0]
        own = size[order]
        total = np.empty(len(docs))
        total[order] = np.add.reduceat(logp.astype(np.float64), np.cumsum(own) - own)
        return total


def _train(table: DataFrame, model: Gru, n_tokens: int, share: int, rounds: int, id_type: str) -> None:
    """Rounds of training in tasks over the table's training rows; each starts from the mean of the last round's weights."""
    spark = table.sparkSession
    shards = max(1, n_tokens // share // SHARD_TOKENS)
    block = 1 << 14
    for r in range(rounds):
        start = spark.sparkContext.broadcast(model.dump())

        def train(shard):
            own, number = Gru.load(start.value), shard.column("shard")[0].as_py()
            flat = np.frombuffer(b"".join(shard.sort_by("key").column("ids").to_pylist()), id_type).astype(np.int32)
            own.train(flat, RATE * (1 - 0.8 * r / share))
            x, n = own.flat(), -(-own.size() // block)
            return pa.table({"shard": pa.array([number] * n, pa.int64()), "block": pa.array(range(n), pa.int32()), "weight": [float(len(flat))] * n, "x": pa.array([x[i * block : (i + 1) * block].tobytes() for i in range(n)], pa.binary())})

        def mean(key, pdf):
            import pandas as pd

            total, pdf = pdf["weight"].sum(), pdf.sort_values("shard")
            x = sum(np.frombuffer(v, np.float32).astype(np.float64) * w for v, w in zip(pdf["x"], pdf["weight"])) / total
            return pd.DataFrame({"shard": [key[1]], "block": [key[0]], "weight": [total], "x": [x.astype(np.float32).tobytes()]})

        shape = "shard long, block int, weight double, x binary"
        mine = ~F.col("held_out") & (F.pmod(F.shiftright("key", 8), F.lit(share)) == r)
        some = table.where(mine).select("key", "ids", F.pmod(F.shiftright("key", 20), F.lit(shards)).alias("shard"))
        found = made = cut(some.groupBy("shard").applyInArrow(train, shape), "shards")
        n = (made.agg(F.max("shard")).first()[0] or 0) + 1
        while n > 1:
            group = F.floor(F.col("shard") / FAN_IN).alias("up")
            found = found.withColumn("up", group).groupBy("block", "up").applyInPandas(mean, shape)
            n = -(-n // FAN_IN)
        rows = sorted(found.select("block", "x").collect())
        drop(made)
        if rows:
            model.unflat(np.concatenate([np.frombuffer(x.x, np.float32) for x in rows]))


def score(documents: DataFrame, kept: int = KEPT, hot_words: int = HOT_WORDS, share: int = SHARE, rounds: int | None = None, seed: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents.

    Learns from all rows whose crc32 of the id as text, mod 7, is not 2 (a null id counts as empty text), dealt over so
    many rounds as share says; fewer rounds leave some out. A null or empty
    text is one end token. Repeated rows are scored each, extra columns ignored. Without training rows both scores are
    those of one unseen word for each token.
    """
    spark = documents.sparkSession
    small_batches(spark)
    training = documents.where(crc_mod("doc_id", 7) != 2)

    def count(batches):
        yield from map(counts_of, groups(batches, 0))

    words = cut(training.where(F.col("text").isNotNull()).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    sums, ends = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first(), training.count()
    N, V = (sums.n or 0) + ends, sums.v + (ends > 0)
    bound, _ = hot_bound(words, hot_words)
    hot = words.where(F.col("n") >= bound).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    top = hot.column("n").to_numpy()[:kept]
    n_top = len(top)
    rare_total = N - ends - int(top.sum()) + (sums.v - n_top) + 1
    counts = np.concatenate([[ends + 1, rare_total], top + 1]).astype(np.float64)
    known = spark.sparkContext.broadcast((hot.column("word").combine_chunks(), hot.column("n").to_numpy()))
    del hot
    log_z, log_rare, id_type = np.log10(N + V + 1.0), np.log10(float(rare_total)), "<u2" if n_top < 60_000 else "<u4"
    kind = dict(documents.dtypes)["doc_id"]

    def tell(batches):
        hot, n = known.value
        log_n = np.concatenate([[np.log10(ends + 1.0), 0.0], np.log10(n + 1.0)])
        serial = TaskContext.get().partitionId() << 36
        for group in groups(batches, 3):
            found = pc.index_in(pa.chunked_array([flat for _, flat, _ in group]), value_set=hot)  # makes a table of hot words, so once a group
            found, done = pc.fill_null(found, -1).to_numpy() + 2, 0
            for b, flat, sizes in group:
                x, owner = found[done : done + len(flat)], np.repeat(np.arange(len(sizes)), sizes)
                done += len(flat)
                total = lambda v: np.bincount(owner, v, len(sizes))  # noqa: E731, B023
                other, rare, weight = x == 1, x > n_top + 1, log_n[x]
                n_other, place = total(other).astype(np.int64), np.concatenate([[0], np.cumsum(sizes + 1)])
                base = total(weight) + log_n[0] - log_z * (sizes + 1)
                shared = total(np.where(rare, weight, 0.0)) - log_rare * (total(rare) + n_other)
                x[rare] = 1
                ids = np.zeros(place[-1], id_type)  # each document ends with 0
                ids[np.arange(len(x)) + owner] = x
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_other)]).astype(np.int32)), flat.filter(pa.array(other)))
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((place * ids.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                made = [pa.array(c) for c in (serial + np.arange(len(sizes)), sizes + 1, sizes - n_other + (ends > 0), base, shared)]
                serial += len(sizes)
                yield pa.RecordBatch.from_arrays([*b.columns, *made, others, packed], names=["doc_id", "held_out", "key", "row", "n_tokens", "n_known", "base", "shared", "others", "ids"])

    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("key")
    rows = documents.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), key, "text")
    table = cut(rows.mapInArrow(tell, f"doc_id {kind}, held_out boolean, key long, row long, n_tokens long, n_known long, base double, shared double, others array<binary>, ids binary"), "lm-ids")
    model = Gru(counts, np.random.default_rng(seed))
    _train(table, model, N, share, share if rounds is None else rounds, id_type)
    sent = spark.sparkContext.broadcast(model.dump())

    def run(batches):
        own, held, ids, n = Gru.load(sent.value), [], [], 0

        def flush():
            s, at = own.score(ids) / np.log(10), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s[at : at + b.num_rows])], names=["row", "s"])
                at += b.num_rows

        for b in batches:
            ids += [np.frombuffer(x, id_type) for x in b.column(1).to_pylist()]
            held.append(b.select([0]))
            n += sum(map(len, ids[-b.num_rows :])) if b.num_rows else 0
            if n > BUFFER:
                yield from flush()
                held, ids, n = [], [], 0
        if ids:
            yield from flush()

    scored = cut(table.select("row", "ids").mapInArrow(run, "row long, s double"), "lm-scored")
    rest = table.select("row", F.explode("others").alias("word")).join(words.where(F.col("n") < bound), "word")
    more = rest.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = table.select("doc_id", "held_out", "n_tokens", "n_known", "base", "shared", "row").join(scored, "row").join(more, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(N).cast("long").alias("train_tokens"), (F.col("base") + zero("more")).alias("base_score"), (F.col("s") + F.col("shared") + zero("more")).alias("score"))
