"""Personal data by candidate gradient boosting, in SQL functions only.

Patterns of four kinds find the base spans, which are always kept. High-recall generators propose
further, overlapping candidates: addresses with their signs in brackets or as words, host addresses
with colons, shortened ones too, and runs of digits, each of which is proposed as a card and as a phone number. Boosted trees on the candidate's
format and on the words before it give a probability, and a calibrated threshold for each kind
selects. The trees are fitted on made-up sentences, as real ones can't be shipped, with the same
expressions that score the corpus, and are compiled to ``CASE`` expressions.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")

# What the base patterns match, leftmost and without overlap. A look-behind or \G,
# the end of the match before, only spares the engine starts that can't succeed or that repeat a
# run; possessive repetition keeps long runs from filling the stack.
_START = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
BASE = {
    "email": _START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this have no match.
GATE = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Generators: kinds that a match is proposed as, its pattern and what a text must hold.
GENERATORS = {
    "spelled": (("email",), r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?+[\[({]\s?+(?:at|AT|a)\s?+[\])}]\s?+[A-Za-z0-9-]++(?:(?:\s?+[\[({]\s?+(?:dot|DOT)\s?+[\])}]\s?+|\.)[A-Za-z0-9-]++)++", r"[\[({]\s?(?:at|AT|a)\s?[\])}]"),
    "worded": (("email",), r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20(?:at|arroba|chez)\x20[A-Za-z0-9-]++(?:\x20(?:dot|punto|point|punkt)\x20[A-Za-z0-9-]++)++", r"(?i)\x20(?:dot|punto|point|punkt)\x20"),
    "colons": (("ip",), r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "shortened": (("ip",), r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+(?![0-9A-Za-z:])", "[0-9A-Fa-f]::[0-9A-Fa-f]"),
    "digits": (("card", "phone"), r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])", r"[0-9]"),
}

#: Words before a candidate that speak for a kind.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write|reach|send|inbox|schreib\w*|escrib\w*|.crire)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bips?\b|\bipv6\b|host|server|address|adresse|node|client|gateway|router|login|connect\w*|ping|dns|from)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:cards?|visa|amex|mastercard|credit|debit|kreditkarte|karte|carte|tarjeta|payment|paid|charged?)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|t.l.phone|tel.fono|llamar?|ring|dial|hotline|sms|whatsapp|handy|portable|m.vil|number|nummer|n.mero|reach)\W*(?:\w+\W+){0,2}$",
}
#: Characters before a candidate that are looked at.
BEFORE = 32
FEATURES = ("digits", "letters", "separators", "length", "luhn", "parenthesis", "groups", "longest", "context", "other", "zero", "end", "dots", "hex", "shape")


def prefix_sums(values: Column) -> Column:
    """Sums of all elements before each, in blocks, so that the work doesn't grow with the square."""
    zero = F.lit(0).cast("long")
    block = 256
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))
    scan = lambda xs: F.aggregate(xs, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    scans = F.transform(blocks, scan)
    starts = lambda s: scan(F.transform(s, lambda x: F.element_at(x, -1)))
    one = F.element_at(F.transform(F.array(scans), lambda s: F.element_at(F.transform(F.array(starts(s)), lambda o: F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get(o, i))))), 1)), 1)
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(one)


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """All matches as ``array<struct<s, e, m>>``: start, end (exclusive) in code points, and the text."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return F.when(F.lit(True) if gate is None else gate, _placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))).otherwise(empty)


def _placed(found: Column, gaps: Column) -> Column:
    length = lambda xs: F.transform(xs, lambda x: F.char_length(x).cast("long"))
    pair = F.struct(found.alias("m"), gaps.alias("g"))

    def place(p: Column) -> Column:
        own = F.zip_with(length(p["m"]), F.slice(length(p["g"]), 1, F.size(p["m"])), lambda m, g: F.struct(g.alias("g"), (m + g).alias("n")))
        before = prefix_sums(F.transform(own, lambda x: x["n"]))
        spans = lambda b: F.zip_with(F.zip_with(own, b, lambda o, s: s + o["g"]), p["m"], lambda s, m: F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m")))
        return F.element_at(F.transform(F.array(before), spans), 1)

    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return F.element_at(F.transform(F.array(pair), lambda p: F.when(F.size(p["m"]) == 0, none).otherwise(place(p))), 1)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    odd = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, odd(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """What a base match must fulfil besides its pattern."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(only_digits(m))
    if kind == "phone":
        return F.char_length(only_digits(m)).between(8, 15)
    return F.lit(True)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda x: passes(kind, x["m"])


def _proposed(kind: str, text: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), measured(kind, x, F.col(text)).alias("f"))


def _no_longer(x: Column) -> Column:
    """Whether a run of digits is no longer than any phone number."""
    return F.char_length(only_digits(x["m"])) <= 15


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base_<kind>``, the base spans of each kind."""
    for kind in KINDS:
        gate = F.contains(text, F.lit(GATE[kind])) if GATE[kind] else None
        if kind in ("ip", "card"):
            gate = F.col(text).rlike("[0-9]") if gate is None else gate & F.col(text).rlike(r"[0-9]\.[0-9]")
        df = df.withColumn(f"_base_{kind}", matches(F.col(text), BASE[kind], gate))
        df = df.withColumn(f"_base_{kind}", F.filter(f"_base_{kind}", _passing(kind)))
    return df


def measured(kind: str, span: Column, text: Column) -> Column:
    """The features of a candidate, as an array of doubles in the order of ``FEATURES``."""
    m, n = span["m"], lambda c: F.char_length(c).cast("double")
    before = F.substring(text, F.greatest(F.lit(1), span["s"] - BEFORE + 1).cast("int"), F.least(span["s"], F.lit(BEFORE)).cast("int"))
    others = "|".join(f"(?:{CONTEXT[k].removeprefix('(?i)')})" for k in KINDS if k != kind)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    return F.array(
        n(only_digits(m)),
        n(F.regexp_replace(m, "[^A-Za-z]", "")),
        n(F.regexp_replace(m, r"[^\x20.:-]", "")),
        n(m),
        flag(luhn(only_digits(m))),
        flag(m.rlike(r"\([0-9]+\)")),
        F.size(parts).cast("double"),
        F.coalesce(F.array_max(F.transform(parts, lambda x: F.char_length(x))), F.lit(0)).cast("double"),
        flag(before.rlike(CONTEXT[kind])),
        flag(before.rlike(f"(?i){others}")),
        flag(m.rlike("^[(]?0")),
        flag(before.rlike(r"[#=_/\\.,:-]$")),
        n(F.regexp_replace(m, "[^.]", "")),
        n(F.regexp_replace(m, "[^A-Fa-f]", "")),
        flag(m.rlike(r"^(?:\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-]?[0-9]{3,5}|0[0-9]{1,4}[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})$")),
    )


def with_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_candidates``: what the generators propose, with kind and features, apart from base spans."""
    lists = []
    for name, (kinds, pattern, gate) in GENERATORS.items():
        df = df.withColumn(f"_{name}", matches(F.col(text), pattern, F.col(text).rlike(gate)))
        for kind in kinds:
            own = F.filter(f"_{name}", _no_longer) if kind == "phone" else F.col(f"_{name}")
            lists.append(F.transform(own, _proposed(kind, text)))
    df = df.withColumn("_candidates", F.concat(*lists))
    return df.drop(*[f"_{x}" for x in GENERATORS])


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth three, and a threshold of the probability for each kind."""

    start: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, f: Column) -> Column:
        """The log odds as an expression over an array of features."""
        at = lambda i: F.get(f, F.lit(i))

        def leaf(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            i, cut, low, high = t
            return F.when(at(i) <= cut, leaf(low)).otherwise(leaf(high))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + leaf(t)
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        def leaf(t, rows: np.ndarray) -> np.ndarray:
            if isinstance(t, float):
                return np.full(len(rows), t)
            i, cut, low, high = t
            return np.where(rows[:, i] <= cut, leaf(low, rows), leaf(high, rows))

        return self.start + sum((leaf(t, x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3) -> tuple[float, tuple]:
    """Gradient boosting with logistic loss: Newton leaves, splits at midpoints, depth three."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, trees = np.full(len(y), start), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0) * rate)
        if depth == 0 or len(rows) < 20:
            return value
        best, base = None, g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for i in range(x.shape[1]):
            values = np.unique(x[rows, i])
            for cut in ((values[1:] + values[:-1]) / 2)[: 24]:
                low = x[rows, i] <= cut
                gl, hl = g[rows][low].sum(), h[rows][low].sum()
                gain = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - base
                if best is None or gain > best[0]:
                    best = (gain, i, float(cut), low)
        if best is None or best[0] < 1e-6:
            return value
        return (best[1], best[2], split(rows[best[3]], g, h, depth - 1), split(rows[~best[3]], g, h, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = split(np.arange(len(y)), y - p, p * (1 - p), 3)
        trees.append(tree)
        score += Trees(0.0, (tree,), ()).log_odds(x)
    return start, tuple(trees)


def sentences(count: int, seed: int) -> list[dict]:
    """Made-up texts with one item each: personal data of a kind (with its place) or something alike."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    sep = lambda: rng.choice(" -.")

    def card(n: int) -> str:
        body = d(n - 1)
        total = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def phone() -> str:
        s = sep()
        return rng.choice([f"({d(3)}) {d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}", f"0{d(3)}{s}{d(3)}{s}{d(4)}", f"00{d(2)} {d(3)} {d(4)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"({d(2)}) {d(4)}-{d(4)}"])

    def grouped(digits: str) -> str:
        return digits if rng.random() < 0.5 else f"{digits[:4]} {digits[4:10]} {digits[10:]}"

    def spelled() -> str:
        a, b = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", "."), (" (at) ", " (dot) "), (" at ", " dot ")])
        return f"{word()}{a}{word()}{b}{rng.choice(['com', 'org', 'net', 'de'])}"

    def colons() -> str:
        parts = [f"{rng.randrange(65536):x}" for _ in range(8)]
        cut = rng.randint(1, 4)
        return ":".join(parts) if rng.random() < 0.6 else ":".join(parts[:cut]) + "::" + ":".join(parts[5 : 5 + rng.randint(1, 3)])

    good = {
        "email": (spelled, ["email", "write to", "contact", "mail me", "kontakt", "correo", "send it to"]),
        "ip": (colons, ["ip", "server", "host", "the address", "node", "client", "connected to"]),
        "card": (lambda: grouped(card(rng.choice([13, 14, 15]))), ["card", "visa", "credit card no", "amex", "carte", "tarjeta", "paid with"]),
        "phone": (phone, ["phone", "call", "tel", "fax", "mobile", "telefon", "my number", "ring"]),
    }
    clock = lambda: f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"
    bad = [lambda: d(rng.randint(7, 19)), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{clock()}:{d(2)}", lambda: f"f(a)x.{word()}", lambda: card(15), lambda: f"{d(3)} {d(3)} {d(4)}", lambda: " ".join(d(2) for _ in range(6)), lambda: f"{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"{d(4)}-{d(2)}-{d(2)} {clock()}", lambda: f"{word()} at {word()} point", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{word()}::{word()}"]
    lead = ["order", "id", "version", "isbn", "at", "in", "no", "sum", "dated", "item", "lot", "total", "page", "ref"]
    out = []
    for _ in range(count):
        before = " ".join(word() for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.5:
            kind = rng.choice(KINDS)
            make, words = good[kind]
            hint = rng.choice(words) + rng.choice([" ", ": ", " is ", f" {word()} "])
        else:
            kind, make = None, rng.choice(bad)
            hint = rng.choice([*lead, word(), word()]) + rng.choice([" ", ": ", " = ", " #"])
        item = make()
        if kind not in (None, "card") and rng.random() < (0.4 if kind == "phone" else 0.2):  # formats that speak for themselves
            hint, item = word() + " ", rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"({d(2)}) {d(4)}-{d(4)}"]) if kind == "phone" else item
        text = f"{before} {hint}{item} {word()} {word()}."
        start = text.rindex(item)
        out.append({"text": text, "k": -1 if kind is None else KINDS.index(kind), "s": start, "e": start + len(item)})
    return out


_models: dict[tuple, Trees] = {}


def model(spark: SparkSession, count: int = 3_000, seed: int = 11, precision: float = 0.97) -> Trees:
    """Fits the trees on two thirds of made-up sentences and calibrates thresholds on the rest.

    A kind's threshold is the smallest probability from which on so large a share of its held-out
    candidates is right, and at least 0.9.
    """
    if (count, seed, precision) in _models:
        return _models[count, seed, precision]
    rows = F.from_json(F.lit(json.dumps(sentences(count, seed))), "array<struct<text:string,k:int,s:long,e:long>>")
    made = with_candidates(spark.range(1).select(F.explode(rows).alias("r")).select("r.*"))
    one = made.select("k", "s", "e", F.posexplode("_candidates").alias("i", "c"))
    got = one.select("c.k", "c.f", ((F.col("c.k") == F.col("k")) & (F.col("c.s") <= F.col("s")) & (F.col("c.e") >= F.col("e")) & (F.col("c.e") - F.col("c.s") <= F.col("e") - F.col("s") + 2)).alias("y")).collect()
    kinds, x, y = np.array([r.k for r in got]), np.array([[r.k, *r.f] for r in got], float), np.array([r.y for r in got], float)
    fit = np.random.default_rng(seed).random(len(y)) < 2 / 3
    start, trees = boost(x[fit], y[fit])
    odds = Trees(start, trees, ()).log_odds(x)
    cuts = []
    for k in range(len(KINDS)):
        held = ~fit & (kinds == k)
        order = np.argsort(-odds[held])
        right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
        fine = np.flatnonzero(right >= precision)
        at = float(odds[held][order][fine[-1]]) if len(fine) else math.inf
        cuts.append(max(at, math.log(0.9 / 0.1)))
    _models[count, seed, precision] = Trees(start, trees, tuple(cuts))
    return _models[count, seed, precision]


#: Spans of a block, which is passed over whole where a candidate does not meet it.
SPANS = 32


def find(docs: DataFrame, trees: Trees | None = None, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``found``, arrays of ``struct<k, s, e>`` ordered by kind and start.

    ``k`` is the index in ``KINDS``, places are code points, ends exclusive. ``found`` holds all of
    ``base`` and the selected candidates that overlap no base span and no likelier candidate.
    Null texts are empty and have none; rows that repeat an id stay as
    they are. Columns of these names in ``docs`` are replaced; columns of any other name stay.
    """
    trees = trees or model(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("base", "found")]
    df = with_candidates(with_base(docs.select(F.struct(*kept).alias("row"), text_of(text).alias("_text")), "_text"), "_text")
    df = df.withColumn("base", F.concat(*[F.transform(f"_base_{kind}", _of_kind(k)) for k, kind in enumerate(KINDS)]))
    scored = F.transform("_candidates", lambda c: F.struct(c["s"], c["e"], c["k"], trees.score(F.concat(F.array(c["k"].cast("double")), c["f"])).alias("p")))
    cut = F.lit(math.inf)
    over = lambda c: F.get(F.array(*[F.lit(t) for t in trees.thresholds]), c["k"]) <= c["p"]
    df = df.withColumn("_chosen", F.filter(scored, over))
    sure = F.transform("base", lambda b: F.struct(b["s"], b["e"], b["k"], cut.alias("p")))
    df = df.withColumn("_all", F.when(F.size("_chosen") > 0, F.array_sort(F.concat("_chosen", sure))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,k:int,p:double>>")))

    block = lambda xs: F.struct(F.array_min(F.transform(xs, lambda o: o["s"])).alias("s"), F.array_max(F.transform(xs, lambda o: o["e"])).alias("e"), xs.alias("xs"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / SPANS).cast("int")), lambda b: block(F.slice("_all", b * SPANS + 1, SPANS)))
    df = df.withColumn("_blocks", F.when(F.size("_all") > 0, blocks))
    meets = lambda o, x: (o["s"] < x["e"]) & (x["s"] < o["e"])

    def beaten(x: Column) -> Column:
        better = lambda o: meets(o, x) & ((o["p"] > x["p"]) | ((o["p"] == x["p"]) & (o["k"] < x["k"])))
        return F.exists("_blocks", lambda b: meets(b, x) & F.exists(b["xs"], better))

    added = F.filter("_all", lambda x: (x["p"] < cut) & ~beaten(x))
    found = F.concat("base", F.transform(added, lambda x: F.struct(x["k"], x["s"], x["e"])))
    df = df.withColumn("found", F.when(F.size("_all") == 0, F.col("base")).otherwise(F.array_sort(found)))
    return df.select(*[F.col("row")[c].alias(c) for c in kept], "base", "found")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["e"], x["k"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"])), F.lit("]"))
        kept = F.substring(text, (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int"))
        return F.when(x["s"] < a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(kept, tag)).alias("out")))

    done = F.aggregate(by_start, start, step)
    return F.element_at(F.transform(F.array(done), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, (d["at"] + 1).cast("int"), F.char_length(text)))), 1)
