"""Operator 7: n-gram Jaccard join by T-occurrence search (DivideSkip), and the groups that its links form.

Documents with one set of shingles are one class. A class's set is dealt into parts by hash, more parts than two
linked sets can have differing elements; so linked sets agree on a part, and classes that share a part's hash are
candidates. Components too large for a task are split by prefixes: of two linked sets, the rarest common shingle is
among the rarest fifth (or what the threshold leaves) of both. Components of candidates meet in a task (those still
large in pairs of pieces), where inverted lists are searched: a set's short lists are merged, its longest ones probed,
and sets that occur often enough are linked. Nothing is dropped: parts and prefixes find every linked pair, the search
is exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, drop, hot_bound, small_batches, trimmed
from lorekeep.llm.graph import components

#: A piece of a large candidate component has about so many sets and shingles.
PIECE_SETS, PIECE_SHINGLES = 4000, 2_000_000
#: Candidates are sent to the executors, instead of shuffling the documents, up to so many.
BROADCAST_IDS, BROADCAST_GONE = 2_000_000, 500_000
#: Frequent shingles, of which a fixed number share one part, and how a task finds them: shingles that it counts at a
#: time, and occurrences among these from which on it reports one. They only steer how sets are dealt into parts.
HOT_TERMS, COUNTED, REPORTED = 200_000, 4_000_000, 3
#: Signatures are shuffled in rounds of about so many, in so many rounds at most: each deletes its files before the next.
ROUND, ROUNDS = 24_000_000, 6
#: Words whose hashes a task keeps.
MEMO = 250_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    return x ^ (x >> np.uint64(27))


class Shingler:
    """Sets of n-word shingles as sorted 64-bit hashes."""

    def __init__(self, n: int):
        self.n, self.memo = n, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        docs = [(t or "").encode().lower().split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        for d in docs:
            for w in d:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
        flat = np.fromiter((memo[w] for d in docs for w in d), np.uint64, sum(map(len, docs)))
        h = np.full(len(flat), np.uint64(self.n))
        for i in range(self.n):
            ahead = np.zeros_like(flat)
            ahead[: len(flat) - i] = flat[i:] if i else flat
            h = (h ^ mixed(ahead + M1)) * M1 + np.uint64(i + 1)
        h = mixed(h)
        out, at = [], 0
        for d in docs:
            if len(d) >= self.n:
                out.append(np.unique(h[at : at + len(d) - self.n + 1]))
            elif d:
                out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(d), len(d) + 1)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += len(d)
        return out


class Bands:
    """Sizes in bands such that linked sets lie in one band or in neighbours, and the number of parts for pairs up to a band."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.known, low = percent, {}, [1]
        while low[-1] <= largest:
            low.append(low[-1] * 100 // percent + 1)
        low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int, int]:
        """Parts for pairs up to this band, by how many at least they exceed the elements by which a linked pair can differ, and elements of a strong part.

        Linked sets agree on so many parts. The excess is above nearly any set's number of weak parts, so agreement on
        weak ones alone is rare; sets for which it is possible give signatures of these, too. Strong parts have two
        elements if that leaves the excess below a quarter of the difference, else one.
        """
        if band not in self.known:
            least, most = int(self.low[band]) * self.percent // 100, int(self.low[band + 1]) - 1
            differ = 2 * most * (100 - self.percent) // (100 + self.percent)
            for strong, limit in ((2, differ // 4), (1, differ // 2 + 1)):
                excess, settled = 1, differ <= 4
                while not settled and excess <= limit:
                    load = max(least, 1) / (differ + excess)
                    weak = (differ + excess) * np.exp(-load) * (1 + load * (strong > 1))
                    wanted = int(np.ceil(weak + 4 * np.sqrt(weak)))
                    settled = wanted <= excess
                    excess = max(excess, wanted)
                if settled:
                    break
            self.known[band] = (differ + min(excess, limit + 1), min(excess, limit + 1), strong)
        return self.known[band]


def _parts(h: np.ndarray, part: np.ndarray, value: np.ndarray, k: int, excess: int, least: int, tag: int, weak_too: bool) -> tuple[np.ndarray, bool]:
    """Hashes of the strong parts (of all, if there may be no other agreement and weak_too), and whether there may be none."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    used, total = p[first], np.add.reduceat(value[order], first)
    strong = np.diff(np.append(first, len(p))) >= least
    doubtful = k - strong.sum() >= excess
    if doubtful and weak_too:
        every = np.zeros(k, np.uint64)
        every[used] = total
        used, total = np.arange(k), every
    else:
        used, total = used[strong], total[strong]
    return mixed(total * M1 + used.astype(np.uint64) * M2 + np.uint64(tag)), doubtful


def signatures(h: np.ndarray, bands: Bands, hot: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the parts of a set, for its band and for the next one.

    hot: sorted hashes of frequent shingles; they have a part of their own, so that they don't make the other parts of
    unlike sets agree. A set for which that leaves too few strong parts is also dealt without regard to them.
    """
    out, band = [], bands.of(len(h))
    deal, value = mixed(h * M2 + M1) >> np.uint64(32), mixed(h * M1 + M2)
    frequent = None
    if hot is not None and len(hot):
        frequent = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
    for b in (band, band + 1):
        k, excess, least = bands.parts(b)
        part = ((deal * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        doubtful = True
        if frequent is not None:
            own, doubtful = _parts(h, np.where(frequent, k, part), value, k + 1, excess + 1, least, 2 * b + 1, False)
            out.append(own)
        if doubtful:
            out.append(_parts(h, part, value, k, excess, least, 2 * b, True)[0])
    return np.concatenate(out).view(np.int64)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def linked(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[int]:
    """The root of each set after linking all pairs with 100 * common >= percent * united; the root is the least index.

    sides: pairs on one side (0 or 1) are left out. T-occurrence search by DivideSkip: for each set, from small to
    large, over the inverted lists of those before it. A candidate that already is in the set's group is not probed.
    """
    n = len(sets)
    groups, group = Union(n), np.arange(n)  # group: of each place in order, for whole lists at once
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    flat = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable")
    lists = np.repeat(np.arange(n, dtype=np.int32), size[order])[by]  # a term's list: positions in order, ascending
    flat = flat[by]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    df, inverse = np.diff(np.append(begin, len(flat))), np.empty(len(flat), np.int32)
    inverse[by] = np.repeat(np.arange(len(df), dtype=np.int32), df)
    del flat, by
    ends, side = np.cumsum(size[order]), None if sides is None else sides[order]
    sizes = size[order]

    def link(q: int, c: int) -> None:
        groups.link(int(order[q]), int(order[c]))
        if group[q] != group[c]:
            group[group == group[c]] = group[q]

    for q in range(1, n):
        m = int(sizes[q])
        if not m:
            continue
        mine = inverse[ends[q] - m : ends[q]]
        mine = mine[df[mine] > 1]
        least = -(-m * percent // 100)
        lowest = int(np.searchsorted(sizes, least))
        if lowest >= q:
            continue
        t_least = -(-percent * (m + least) // (100 + percent))
        if len(mine) < t_least:
            continue
        mine = mine[np.argsort(df[mine], kind="stable")]
        long_ones = mine[len(mine) - (t_least - 1) :] if t_least > 1 else mine[:0]
        short = mine[: len(mine) - len(long_ones)]
        merged = np.concatenate([lists[begin[t] : begin[t] + df[t]] for t in short])
        merged = merged[(merged < q) & (merged >= lowest)]
        if side is not None:
            merged = merged[side[merged] != side[q]]
        # a large group shows in most lists: one member that links spares the others
        for c in merged[:: max(1, len(merged) // 4)][:4]:
            if group[c] != group[q]:
                common = len(np.intersect1d(sets[order[q]], sets[order[c]], assume_unique=True))
                if 100 * common >= percent * (m + sizes[c] - common):
                    link(q, c)
        merged = np.sort(merged[group[merged] != group[q]], kind="stable")  # merges the sorted runs
        if not len(merged):
            continue
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[first], np.diff(np.append(first, len(merged)))
        need = -(-percent * (m + sizes[found]) // (100 + percent))
        fits = count + len(long_ones) >= need
        best = np.argsort(-(count[fits] / need[fits]), kind="stable")
        found, count, need = found[fits][best], count[fits][best], need[fits][best]
        step = 16
        while len(found):
            some, have = found[:step], count[:step].copy()
            for t in long_ones:
                one = lists[begin[t] : begin[t] + df[t]]
                at = np.searchsorted(one, some)
                have += one[np.minimum(at, len(one) - 1)] == some
            for c in some[have >= need[:step]]:
                link(q, c)
            found, count, need = found[step:], count[step:], need[step:]
            if len(found):
                open_ = group[found] != group[q]
                found, count, need = found[open_], count[open_], need[open_]
            step = min(step * 2, 1024)
    return [groups.root(i) for i in range(n)]


def _hot_terms(documents: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the shingles that tasks meet often, at most HOT_TERMS."""

    def run(batches):
        shingler, held, n = Shingler(words), [], 0

        def out():
            h = np.concatenate(held)
            held.clear()
            h.sort()
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            c = np.diff(np.append(first, len(h)))
            often = c >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(h[first[often]].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["h", "n"])

        for b in batches:
            sets = shingler.sets(b.column(0).to_pylist())
            held += sets
            n += sum(map(len, sets))
            if n > COUNTED:
                yield out()
                n = 0
        if held:
            yield out()

    table = cut(documents.where(F.col("text").isNotNull()).select("text").mapInArrow(lambda batches: trimmed(run(batches)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= 2 * REPORTED), "frequent", free=True)
    found = table.where(F.col("n") >= hot_bound(table, HOT_TERMS)[0]).select("h").toArrow()
    drop(table)
    return np.sort(np.array(found.column(0).to_pylist(), np.int64).view(np.uint64))


def _sets_table(documents: DataFrame, words: int, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    """doc_id, alike, n, node (128-bit hash of the set; null if empty), key (its first half) and, once in a task for each node, signatures. alike tells rows without an id apart."""
    sent = None if hot is None else documents.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        shingler, seen, bands = Shingler(words), set(), Bands(percent, 1 << 40)
        for b in batches:
            size, nodes, keys, sigs = [], [], [], []
            for h in shingler.sets(b.column(2).to_pylist()):
                size.append(len(h))
                node = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                nodes.append(node)
                keys.append(int.from_bytes(node[:8], "little", signed=True) if node else None)
                if node is None or node in seen:
                    sigs.append(None)
                else:
                    seen.add(node)
                    sigs.append(signatures(h, bands, None if sent is None else sent.value).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "alike", "n", "node", "key", "sigs"])

    kind = dict(documents.dtypes)["doc_id"]
    return cut(documents.select("doc_id", _alike(), "text").mapInArrow(lambda batches: trimmed(run(batches)), f"doc_id {kind}, alike long, n long, node binary, key long, sigs binary"), "sets")


def _alike():
    """0, or the text's hash where there is no id."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("alike")


def _heads(rows: DataFrame, rounds: int = 1) -> DataFrame:
    """a, b: for each sig of rows (sig, key), edges from the least key that has it to the others; repeated edges meet once a task. One of so many rounds takes fewer tasks, so that what they send packs as well."""

    def edges(batches):
        last, head, seen = None, None, set()
        for b in batches:
            sig, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(sig):
                continue
            starts = np.concatenate([[last is None or sig[0] != last], sig[1:] != sig[:-1]])
            group = np.cumsum(starts)
            heads = np.concatenate([[0 if head is None else head], key[starts]])[group]
            last, head = sig[-1], heads[-1]
            loose = heads != key
            new = set(zip(key[loose].tolist(), heads[loose].tolist())) - seen
            if new:
                seen |= new
                a, c = zip(*new)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
            if len(seen) > 1_000_000:
                seen = set()

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    n = max(-(-n // rounds), min(n, 24))
    return rows.repartition(n, "sig").sortWithinPartitions("sig", "key").mapInArrow(lambda batches: trimmed(edges(batches)), "a long, b long")


def _candidates(sets: DataFrame) -> list[DataFrame]:
    """Tables of a, b: for each hash of a part, edges from the least class that has it to the others; each table has the hashes of a round."""
    total = sets.agg(F.sum(F.length("sigs"))).first()[0] or 0
    rounds = int(min(max(-(-total // (8 * ROUND)), 1), ROUNDS))

    def spread(batches, this):
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), np.int64)
            parts = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            sig = np.concatenate([np.zeros(0, np.int64), *parts])
            key = np.repeat(keys, [len(p) for p in parts])
            if rounds > 1:
                mine = (sig.view(np.uint64) >> np.uint64(32)) % np.uint64(rounds) == this
                sig, key = sig[mine], key[mine]
            for k in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(sig[k : k + (1 << 16)]), pa.array(key[k : k + (1 << 16)])], names=["sig", "key"])

    given = sets.where("sigs is not null").select("key", "sigs")
    return [cut(_heads(given.mapInArrow(lambda batches, this=this: trimmed(spread(batches, this)), "sig long, key long"), rounds), "candidates", free=True) for this in range(rounds)]


def _sized(chosen: DataFrame) -> DataFrame:
    """root and k, the pieces it takes, of each root that two or more classes have."""
    pieces = F.greatest(F.ceil(F.col("m") / PIECE_SETS), F.ceil(F.col("total") / PIECE_SHINGLES)).cast("int")
    return chosen.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1").select("root", pieces.alias("k"))


def _texts(documents: DataFrame, plan: DataFrame, few: bool, words: int) -> DataFrame:
    """node, root, k and h, the set's shingles, of each class of plan."""

    def texts(batches):
        shingler, seen = Shingler(words), set()
        for b in batches:
            hs, ok = shingler.sets(b.column(0).to_pylist()), []
            for h, w in zip(hs, b.column(1).to_pylist()):
                ok.append(bool(len(h)) and w not in seen and xxhash.xxh3_128_digest(h.tobytes()) == w)
                if ok[-1]:
                    seen.add(w)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(1).filter(keep), b.column(2).filter(keep), b.column(3).filter(keep), pa.array([h.tobytes() for h, o in zip(hs, ok) if o], pa.binary())], names=["node", "root", "k", "h"])

    ids = plan.select("id", F.col("alike").alias("same"), F.col("node").alias("want"), "root", "k")
    docs = documents.select("doc_id", _alike(), "text").where("text is not null")
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("alike") == F.col("same"))).select("text", "want", "root", "k").mapInArrow(lambda batches: trimmed(texts(batches)), "node binary, root long, k int, h binary")


def _split(full: DataFrame, percent: int) -> DataFrame:
    """node (key of a class), root: the components of full's classes that are left when only classes meet that share a shingle of both prefixes.

    A set's prefix has the n - ceil(n * percent / 100) + 1 shingles that the fewest sets of its component have. Two
    linked sets have at least n * percent / 100 elements in common, so their rarest common one is in both prefixes.
    Shingles of one set alone meet nothing; sizes in bands keep sets apart that can't link. Classes without an edge link
    with none.
    """

    def terms(batches):
        for b in batches:
            for node, root, h in zip(*(b.column(c).to_pylist() for c in ("node", "root", "h"))):
                term = mixed(np.frombuffer(h, np.uint64) ^ np.uint64(root * int(M1) % (1 << 64))).view(np.int64)
                key = int.from_bytes(node[:8], "little", signed=True)
                for k in range(0, len(term), 1 << 16):
                    some = term[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), key)), pa.array(np.full(len(some), len(term), np.int32))], names=["term", "key", "n"])

    bands = Bands(percent, 1 << 40)

    def banded(batches):
        for b in batches:
            term, size = b.column(0).to_numpy().view(np.uint64), b.column(2).to_numpy()
            band = (np.searchsorted(bands.low, size, "right") - 1).astype(np.uint64)
            for up in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(mixed(term ^ (band + np.uint64(up)) * M2).view(np.int64)), b.column(1)], names=["sig", "key"])

    one_term, one_set = Window.partitionBy("term"), Window.partitionBy("key")
    shared = full.select("node", "root", "h").mapInArrow(lambda batches: trimmed(terms(batches)), "term long, key long, n int").withColumn("df", F.count("*").over(one_term)).where("df > 1")
    ranked = shared.withColumn("common", F.count("*").over(one_set)).withColumn("rank", F.row_number().over(one_set.orderBy("df", "term")))
    prefix = ranked.where(F.expr(f"rank + (n - common) <= n - (n * {percent}L + 99) div 100 + 1")).select("term", "key", "n")
    edges = cut(_heads(prefix.mapInArrow(lambda batches: trimmed(banded(batches)), "sig long, key long")), "prefixes", free=True)
    out = components(edges)
    drop(edges)
    return out


def _exact(documents: DataFrame, sets: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b (128-bit classes): links that join all classes which links join within each task's piece."""
    spark = documents.sparkSession
    # a row of each class: one with an id, if there is any
    who = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "alike")).alias("who")
    chosen = sets.where("node is not null").join(candidates.withColumnRenamed("node", "key"), "key").groupBy("node").agg(who, F.first("root").alias("root"), F.first("n").alias("n"), F.first("key").alias("key"))
    chosen = cut(chosen.select("node", F.col("who.doc_id").alias("id"), F.col("who.alike").alias("alike"), "root", "n", "key"), "chosen", free=True)
    few = chosen.count() <= BROADCAST_IDS
    large = _sized(chosen).where("k > 1")
    if large.limit(1).count():
        closer = _split(_texts(documents, chosen.join(large, "root"), few, words), percent)
        rest = chosen.join(large, "root", "left_anti")
        chosen = cut(rest.unionByName(chosen.join(large, "root", "left_semi").drop("root").join(closer.withColumnRenamed("node", "key"), "key")), "chosen", free=True)
    full = _texts(documents, chosen.join(_sized(chosen), "root"), few, words)
    piece = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    other = F.explode(F.expr("sequence(0, k - 1)"))
    dealt = full.withColumn("p", piece).withColumn("o", other).select("root", "k", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "node", "h")

    def join(batches):
        now, node, h, side, halves = None, [], [], [], False

        def close():
            keep = [x for x in range(len(node)) if x == 0 or node[x] != node[x - 1]]  # a repeated row of documents
            own = [np.frombuffer(h[x], np.uint64) for x in keep]
            roots = linked(own, percent, np.array([side[x] for x in keep]) if halves else None)
            return [(node[keep[x]], node[keep[r]]) for x, r in enumerate(roots) if x != r]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["a", "b"])

        rows = []
        for b in batches:
            for root, i, j, p, x, data in zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "p", "node", "h"))):
                if (root, i, j) != now:
                    if len(node) > 1:
                        rows += close()
                    if len(rows) > 10_000:
                        yield out(rows)
                        rows = []
                    now, node, h, side, halves = (root, i, j), [], [], [], i != j
                node.append(x), h.append(data), side.append(int(p == j))
        if len(node) > 1:
            rows += close()
        if rows:
            yield out(rows)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(lambda batches: trimmed(join(batches)), "a binary, b binary")


def _groups(documents: DataFrame, words: int, percent: int, frequent: bool) -> tuple[DataFrame, list[DataFrame]]:
    """What groups() returns, and the tables that it reads."""
    small_batches(documents.sparkSession)
    hot = _hot_terms(documents, words) if frequent else None
    sets = _sets_table(documents, words, percent, hot)
    edges = _candidates(sets)
    roots = components(reduce(DataFrame.unionByName, edges))
    whole, sets = sets, cut(sets.drop("sigs"), "sets")
    drop(whole, *edges)
    links = components(_exact(documents, sets, roots, words, percent))
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"))
    joined = classes.join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(joined.join(joined.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "component_id"), "classes", free=True)
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(least, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, [sets, least]


def groups(documents: DataFrame, words: int = 5, percent: int = 80, frequent: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents.

    Words are lower-cased (A-Z) and split at ASCII white space; a set has the distinct shingles of so many words, or the
    whole text's words as one if there are fewer. Sets link when 100 * common >= percent * united; component_id is the
    least doc_id reachable. Texts without words, or null, have an empty set, link with nothing and keep their own id.
    Rows with a null id get the least id of their group, if any. Repeated rows are kept; extra columns are ignored.
    frequent: whether frequent shingles get a part of their own, for a pass over the texts; the result is the same.
    """
    return _groups(documents, words, percent, frequent)[0]


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents of which doc_id is the least of its group, with their columns; texts without words stay, as do rows with null ids.

    The ids that go are broadcast up to BROADCAST_GONE; beyond, documents are shuffled by id.
    """
    found, tables = _groups(documents, words, percent, True)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone", free=True)
    drop(*tables)
    hint = F.broadcast if gone.count() <= BROADCAST_GONE else lambda df: df
    return documents.alias("d").join(hint(gone).alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")
