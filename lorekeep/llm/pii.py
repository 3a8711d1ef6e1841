"""Operator 9: personal data by candidate gradient boosting, in DataFrame functions alone.

Generators with high recall propose spans, which may overlap. Base kinds count if they pass their checks; candidates of
the further kinds are judged by boosted trees over features of format and context, whose scores are calibrated and cut
at each kind's threshold. The trees are grown on the driver, from made-up examples whose features the same expressions
compute, and become an expression of the plan.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, drop

#: The base kinds' patterns, written such that a long run of characters is read once. \G is the end of the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of the further kinds.
_TOKEN = "[A-Za-z0-9_+/-]"
MORE = {
    "secret": rf"(?<!{_TOKEN})(?=[A-Za-z_+/-]*+[0-9]){_TOKEN}{{12,}}+={{0,2}}",
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?(?i:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?i:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "number": r"(?<![A-Za-z0-9+.-])\(?[0-9]{2,4}\)?(?:[\x20.-]{1,2}[0-9]{2,4}){2,4}+(?![A-Za-z0-9-])",
}
KINDS = [*BASE, *MORE]
#: Text before and after a candidate that is looked at.
BEFORE, AFTER = 24, 8
#: Spans and texts with spans that are broadcast by redact(); beyond, documents are shuffled by a hash of the text.
BROADCAST_MARKS = 500_000
EXAMPLES, TREES, DEPTH, RATE, LEAST_PRECISION = 900, 16, 3, 0.4, 0.97


def _features(kind: Column, m: Column, before: Column, after: Column) -> dict[str, Column]:
    count = lambda p: F.length(F.regexp_replace(m, p, "")).cast("double")
    flag = lambda c: c.cast("double")
    n = F.greatest(F.length(m), F.lit(1)).cast("double")
    return {
        "kind": F.array_position(F.array(*(F.lit(k) for k in MORE)), kind).cast("double"),
        "chars": n,
        "digits": count("[^0-9]"),
        "digit_share": count("[^0-9]") / n,
        "upper_share": count("[^A-Z]") / n,
        "lower_share": count("[^a-z]") / n,
        "groups": F.size(F.split(m, "[^0-9A-Za-z]+")).cast("double"),
        "turns": F.size(F.regexp_extract_all(m, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"), F.lit(0))).cast("double"),
        "vowels": count("[^aeiouAEIOU]") / n,
        "hex": flag(m.rlike(r"\A[0-9a-f]+\z")),
        "says_secret": flag(before.rlike(r"(?i)(?:pass\w{0,5}|pwd|secret|token|key|auth|bearer|credential\w?)\W{0,6}\z")),
        "says_contact": flag(before.rlike(r"(?i)(?:call|phone|tel|mobile|cell|fax|contact|mail|reach|write|whatsapp)\b.{0,10}\z")),
        "says_id": flag(before.rlike(r"(?i)(?:ssn|social|passport|iban|account|acct|licen[cs]e no|id)\b.{0,10}\z")),
        "says_other": flag(before.rlike(r"(?i)(?:isbn|version|page|pp|vol|price|eur|usd|order|figure|section|since|between|score|no|http\S*|www\S*)\b.{0,6}\z|[$€£/]\z")),
        "quoted": flag(before.rlike("[\"'=:]\\s?\\z")),
        "unit_after": flag(after.rlike(r"(?i)\A\s?(?:%|km|kg|eur|usd|m\b|px|years?|pages?|million)")),
        "at_words": flag(m.rlike(r"(?i)[(\[]")),
        "date": flag(m.rlike(r"\A(?:(?:19|20)[0-9]{2}[-. /][01]?[0-9][-. /][0-3]?[0-9]|[0-3]?[0-9][-. /][01]?[0-9][-. /](?:19|20)[0-9]{2})\z")),
        "shape_324": flag(m.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z")),
        "shape_334": flag(m.rlike(r"\A\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}\z")),
    }


def _made_up(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """(kind, candidate, before, after, private) of random candidates in random contexts."""
    r, out = random.Random(seed), []
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    chars = lambda a, k: "".join(r.choice(a) for _ in range(k))
    word = lambda: "".join(r.choice("th er an on re he in ed nd ha at en es of la de le ou ai que ch ge ver sch ción".split()) for _ in range(r.randint(1, 4)))
    plain = lambda: (" ".join(word() for _ in range(6)) + r.choice([" ", ". ", ", ", ": ", "\n", " ("]))[-BEFORE:]
    alnum, upper, hexa = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    for _ in range(n):
        k, good = r.choice(list(MORE)), r.random() < 0.5
        before, after = plain(), r.choice([" ", ".", ",", "\n", '"', ""]) + word()[:6]
        if k == "secret":
            if good:
                m = r.choice([lambda: chars(upper, 20), lambda: chars(hexa, r.choice((18, 32, 40, 64))), lambda: chars(alnum, r.randint(16, 48)), lambda: chars(alnum + "+/", 40)])()
                if not any(c.isdigit() for c in m):
                    m = m[:5] + digits(2) + m[7:]
                if r.random() < 0.6:
                    before = plain()[:8] + r.choice(["password=", "token = \"", "key: ", "secret=", "api_key=", "Authorization: Bearer ", "pwd:"])
                    if r.random() < 0.2:
                        m = word() + word() + digits(r.randint(3, 6)) + "x" * 4
            else:
                m = r.choice([lambda: "-".join(word() for _ in range(3)) + "-" + digits(r.randint(1, 4)), lambda: word() + "_" + word() + "_" + word() + digits(1), lambda: digits(r.randint(12, 14)), lambda: "/".join(word() for _ in range(3)) + "/" + digits(3), lambda: word() + word() + word() + word() + digits(r.randint(1, 2)), lambda: "-" * 11 + digits(2), lambda: "-".join([digits(4), digits(2), digits(2), word()])])()
                m = m if len(m) >= 12 else m + "abcdefghijkl"
        elif k == "contact":
            if good:
                at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
                m = word() + r.choice(["", ".", "_"]) + word() + at + word() + dot + r.choice(["com", "org", "net", "de", "fr", "example" + dot + "com"])
            else:
                m = word() + " at " + word() + " dot " + r.choice([word(), "the", "product"])
                before = plain()[:10] + r.choice(["draw ", "the ", "point ", "look "])
                m = m if r.random() < 0.7 else "dots at the dot product"
        else:
            if good:
                m = r.choice([lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"0{digits(2)} {digits(3)} {digits(4)}"])()
                if r.random() < 0.5:
                    before = plain()[:10] + r.choice(["call ", "phone: ", "tel. ", "SSN ", "social security ", "mobile ", "account "])
            else:
                m = r.choice([lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", lambda: f"1{digits(1)}.0{r.randint(1, 9)}.19{digits(2)}", lambda: f"{digits(2)} {digits(3)} {digits(3)}", lambda: f"{digits(2)}.{digits(2)}.{digits(2)}", lambda: f"978-{digits(2)}-{digits(4)}-{digits(3)}", lambda: f"{digits(2)}-{digits(2)}-{digits(2)}"])()
                if r.random() < 0.4:
                    before = plain()[:10] + r.choice(["version ", "ISBN ", "pages ", "$", "order ", "since "])
                after = r.choice([after, " %", " km", " years"])
        out.append((k, m, before, after, int(good)))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree as nested (feature, cut, left, right), or a leaf's value: the split of the largest gain over midpoints."""
    leaf = float(-g.sum() / (h.sum() + 1))
    if not depth or len(g) < 8:
        return leaf
    best, whole = (1e-3, None, None), g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, a, b = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - whole
        gain[v[1:] == v[:-1]] = -1
        if len(gain) and gain.max() > best[0]:
            k = int(gain.argmax())
            best = (float(gain[k]), f, float(v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] < best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] < tree[1], _value(tree[2], x), _value(tree[3], x))


def _column(tree, names: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(round(tree, 6))
    return F.when(F.col(names[tree[0]]) < tree[1], _column(tree[2], names)).otherwise(_column(tree[3], names))


class Model:
    """Boosted trees, slope and offset of the calibration, and each further kind's threshold of probability."""

    _made: Model | None = None

    @classmethod
    def made(cls, spark: SparkSession) -> Model:
        """The model of the standard examples, which are the same each time: it is fitted once."""
        if cls._made is None:
            cls._made = cls(spark)
        return cls._made

    def __init__(self, spark: SparkSession, examples: int = EXAMPLES, seed: int = 5):
        rows = _made_up(examples, seed)
        data = json.dumps([{"kind": k, "m": m, "before": b, "after": a, "y": y} for k, m, b, a, y in rows])
        made = spark.range(1).select(F.explode(F.from_json(F.lit(data), "array<struct<kind:string,m:string,before:string,after:string,y:int>>")).alias("e")).select("e.*")
        cols = _features(F.col("kind"), F.col("m"), F.col("before"), F.col("after"))
        self.names = list(cols)
        got = made.select("y", *(c.alias(n) for n, c in cols.items())).collect()
        x, y = np.array([list(r)[1:] for r in got], float), np.array([r.y for r in got], float)
        fit = np.arange(len(y)) % 3 > 0
        self.trees, z = [], np.zeros(len(y))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            t = _grow(x[fit], (p - y)[fit], (p * (1 - p))[fit], DEPTH)
            self.trees.append(t)
            z += RATE * _value(t, x)
        a, b = 1.0, 0.0  # Platt's calibration on the third that no tree has seen
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z[~fit] + b)))
            a -= 0.1 * float(((p - y[~fit]) * z[~fit]).mean())
            b -= 0.1 * float((p - y[~fit]).mean())
        self.slope, self.offset = a, b
        prob, self.thresholds = 1 / (1 + np.exp(-(a * z + b))), {}
        for i, kind in enumerate(MORE):
            own = ~fit & (x[:, 0] == i + 1)
            steps = [t for t in np.linspace(0.5, 0.99, 50) if (prob[own] >= t).any() and y[own][prob[own] >= t].mean() >= LEAST_PRECISION]
            self.thresholds[kind] = float(min(steps, default=0.99))

    def probability(self) -> Column:
        z = F.lit(0.0)
        for t in self.trees:
            z = z + F.lit(RATE) * _column(t, self.names)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * z + F.lit(self.offset))))


def _found(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """Matches in order, with the length of the gap before each, its end, and the beginning of the gap after."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.transform(
        matches,
        lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m.alias("m"), F.length(F.get(F.col(f"g_{kind}"), i)).alias("gap"), F.right(F.get(F.col(f"g_{kind}"), i), F.lit(BEFORE)).alias("before"), F.left(F.get(F.col(f"g_{kind}"), i + 1), F.lit(AFTER)).alias("after")),
    )
    return F.when(gate, gaps).alias(f"g_{kind}"), F.when(gate, each)


def candidates(documents: DataFrame, model: Model, keys: tuple[Column, ...] = ()) -> DataFrame:
    """row, doc_id, keys and, in each generator's order, what it proposes: kind, i, gap, chars and p, or one row without; as a table.

    p is 2 for base kinds that pass their check and the probability, from the kind's threshold on, for others; else null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", *keys, text.alias("text"))
    base = base.withColumn("has_digits", F.col("text").rlike("[0-9]"))
    gates = {"email": F.col("text").contains("@"), "contact": F.col("text").rlike("(?i)dot[)\\] ]"), "phone": F.col("has_digits") & F.col("text").contains("+")}
    parts = {k: _found(F.col("text"), k, p, gates.get(k, F.col("has_digits"))) for k, p in (BASE | MORE).items()}
    base = base.select("*", *(g for g, _ in parts.values()))
    none = F.array().cast("array<struct<kind:string,i:int,m:string,gap:int,before:string,after:string>>")
    every = F.concat(*(F.coalesce(e, none) for _, e in parts.values()))
    # a number of one digit, and numbers that can't be cards, are no candidates but count as length before the next
    names = [c for c in base.columns if c not in ("text", "has_digits") and not c.startswith("g_")]
    rows = base.select(*names, F.explode_outer(every).alias("c")).select(*names, "c.*")
    # judged before any exchange: the trees are a large expression, which plans of several stages would make again for each
    cols = _features(F.col("kind"), F.col("m"), F.col("before"), F.col("after"))
    rows = rows.select(*names, F.col("kind").alias("name"), "i", "gap", "m", *(c.alias(n) for n, c in cols.items()))
    limit = F.create_map(*(x for k, t in model.thresholds.items() for x in (F.lit(k), F.lit(t))))
    rows = rows.select(*names, F.col("name").alias("kind"), "i", "gap", F.length("m").alias("chars"), F.when(F.col("name").isin(*BASE), F.when(_valid(F.col("name"), F.col("m")), 2.0)).otherwise(model.probability()).alias("p"))
    return cut(rows.withColumn("p", F.when(F.col("kind").isin(*BASE) | (F.col("p") >= limit[F.col("kind")]), F.col("p"))), "candidates")


def _valid(kind: Column, m: Column) -> Column:
    """Whether a base candidate passes its kind's check."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, r"\A0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.expr("cast(null as int)"), F.try_to_number(p, F.lit("999"))) <= 255))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    luhn = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)
    card = F.when((n >= 14) & (n <= 19), luhn % 10 == 0).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", (n >= 10) & (n <= 15)).otherwise(False)


def spans(rows: DataFrame) -> DataFrame:
    """row, kind, start, stop, base of all chosen spans of a table of candidates(): base ones that pass, and of the further
    kinds, from the likeliest on (ties: the first, then the longest), those that overlap no chosen span."""
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.where("kind is not null").select("row", "kind", "chars", "p", F.sum(F.col("gap") + F.col("chars")).over(order).alias("stop"))
    both = placed.where("p is not null").select("row", "kind", (F.col("stop") - F.col("chars")).alias("start"), "stop", "p")
    # islands of overlapping spans: one begins where no span before reaches
    order = Window.partitionBy("row").orderBy("start", "stop", "kind")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    isles = both.withColumn("reach", reach).withColumn("isle", isle)
    one = F.struct((-F.col("p")).alias("less"), "start", (-F.col("stop")).alias("last"), "kind")
    isles = isles.groupBy("row", "isle").agg(F.array_sort(F.collect_list(one)).alias("own"))

    def step(taken, s):
        clash = F.exists(taken, lambda t: (t["start"] < -s["last"]) & (s["start"] < -t["last"]))
        return F.when((s["less"] == -2.0) | ~clash, F.concat(taken, F.array(s))).otherwise(taken)

    chosen = F.when(F.size("own") == 1, F.col("own")).otherwise(F.aggregate("own", F.slice("own", 1, 0), step))
    return isles.select("row", F.explode(chosen).alias("s")).select("row", "s.kind", "s.start", (-F.col("s.last")).alias("stop"), (F.col("s.less") == -2.0).alias("base"))


def _joined(own: Column) -> Column:
    """kind:start:stop of structs (start, rank, kind, stop), by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(own), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of documents.

    A null text counts as empty; positions are code points, ends exclusive. Repeated rows and null ids are kept; extra
    columns are ignored.
    """
    spark = documents.sparkSession
    rows = candidates(documents, Model.made(spark))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "kind", "stop")
    chosen = spans(rows).groupBy("row").agg(F.collect_list(F.when(F.col("base"), one)).alias("base"), F.collect_list(one).alias("every"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE))
    texts = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    out = texts.join(chosen, "row", "left")
    listed = lambda c: F.coalesce(_joined(F.col(c)), F.lit(""))
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("every").alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The rows of documents with each chosen span replaced by its kind in brackets; overlapping spans are replaced together, under the first's kind. n_chars, if there is one, counts the new text."""
    spark = documents.sparkSession
    key = (F.xxhash64("text").alias("lk_a"), F.xxhash64(F.lit(1), F.reverse("text")).alias("lk_b"))
    rows = candidates(documents.where(F.col("text").isNotNull()), Model.made(spark), key)
    chosen = spans(rows).join(rows.groupBy("row").agg(F.first("lk_a").alias("lk_a"), F.first("lk_b").alias("lk_b")), "row")
    marks = chosen.groupBy("row").agg(F.first("lk_a").alias("lk_a"), F.first("lk_b").alias("lk_b"), F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("marks"))
    marks = cut(marks.groupBy("lk_a", "lk_b").agg(F.first("marks").alias("marks")), "marks")
    drop(rows)
    if (marks.agg(F.sum(F.size("marks") + 1)).first()[0] or 0) <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    text, found = F.col("d.text"), F.col("m.marks")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def step(acc, s):
        ahead = F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        within = F.struct(F.greatest(acc["at"], s["stop"].cast("long")).alias("at"), acc["done"].alias("done"))
        return F.when(s["start"] < acc["at"], within).otherwise(F.struct(s["stop"].cast("long").alias("at"), ahead.alias("done")))

    new = F.aggregate(found, start, step, lambda acc: F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    changed = {"text": F.when(found.isNull(), text).otherwise(new)}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(found.isNull(), F.col("d.n_chars")).otherwise(F.length(changed["text"])).cast(dict(documents.dtypes)["n_chars"])
    same = (F.xxhash64("d.text") == F.col("m.lk_a")) & (F.xxhash64(F.lit(1), F.reverse("d.text")) == F.col("m.lk_b"))
    return documents.alias("d").join(marks.alias("m"), same, "left").select(*(changed.get(c, F.col(f"d.`{c}`")).alias(c) for c in documents.columns))
