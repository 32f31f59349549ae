"""Personal data: fixed patterns, and candidates accepted by gradient-boosted trees. DataFrame functions only.

Fixed patterns give the base spans of every text. Wider generators (numbers with any of the usual separators, each as a card, a
phone and an address; e-mail addresses with "at" and "dot" spelled out) propose overlapping candidates. A candidate's features
describe its normalised form (check digit, digit count, octets, grouping, domain) and its context (characters on either side, a cue
word before), not the notation by which the fixed patterns know theirs. No rule says which candidates count: boosted trees of depth two learn it
from base spans as positives and all other candidates as negatives, those that can't be of the kind (a wrong check digit, octet or count of digits) with
weight 1, the others, unlabelled, with weight UNLABELLED, since some of them are of the kind in another notation. Spark counts the feature
combinations over all rows, of which there are at most CELLS, and the driver boosts over those counts. For each kind the threshold is the lowest
at which PRECISION of the accepted labelled candidates of the held-out fold are positive, and not under the log-odds of PROBABILITY. The second pass
looks a candidate's margin up by its combination, in an array that the driver works out from the trees. That pass proposes candidates in what
base spans leave of a text, addresses before numbers; a number gets the kind by which it passes best, so spans that are added overlap nothing.

Positions come from running sums over chunks, and texts are cut by chunks, so work grows with the length of a text and the spans in it.

Defined cases: null texts count as empty; a text without candidates has an empty span list; positions count code points; repeated
rows get the same spans; texts of any length are searched whole; without a single base span of a kind nothing of it is added; other columns
pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out_sql

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Possessive, and anchored at the start of a run (or the end of the match before), so that long runs stay linear.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Wider generators.
NUMBER = r"(?<![A-Za-z0-9])\+?[(]?[0-9](?:[\x20().\-/ ‐-―]{0,3}[0-9]){6,}+"
ADDRESS = rf"(?<!{LOCAL}){LOCAL}{{1,64}}+\x20?(?:@|[(\[{{](?i:at)[)\]}}]|\x20(?i:at)\x20)\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{{](?i:dot)[)\]}}]\x20?|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++"
SPELLED = r"@|(?i:[(\[{]at[)\]}]|\x20at\x20[a-z0-9-]+(?:\.|\x20dot\x20|\x20?[(\[{]dot[)\]}]))"
KNOWN_TOP = "(?i)^(?:com|net|org|edu|gov|io|info|biz|eu|de|at|ch|uk|fr|es|it|pt|nl|be|pl|cz|se|no|dk|fi|ru|ua|us|ca|mx|br|ar|in|cn|jp|kr|au|nz|za)$"
#: Base notation of a whole candidate, by kind. Possessive too: a group that may give back recurses once a repeat, and some thousand repeats overflow the stack, which ends the executor.
WRITTEN = (rf"^{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z", r"^[0-9]+(?:\.[0-9]+){3}\z", r"^[0-9](?:[\x20-]?[0-9])++\z", r"^\+[0-9][\x20().0-9-]+[0-9]\z")
CUE = r"(?i)(?:tel|phone|call|fax|mobil|mail|contact|card|visa|master|server|host|\bip\b|address)"

#: Features and how many values each has; a candidate is one of CELLS combinations.
FEATURES = {"kind": 4, "luhn": 2, "digits": 8, "octets": 2, "parens": 2, "groups": 4, "before": 3, "after": 3, "cue": 2, "domain": 3}
CELLS = int(np.prod(list(FEATURES.values())))
#: The features that vary among candidates of each generator; margins are looked up by their combination.
VARYING = {"addresses": ("before", "after", "cue", "domain"), "numbers": tuple(n for n in FEATURES if n != "domain")}
#: Values that a running sum takes at once, and code points of the pieces a text is cut from.
CHUNK, PIECE, FILLER = 64, 512, "\ue000"
MATCHES = "array<struct<start:long,stop:long,value:string,before:string,after:string>>"
SPANS = "array<struct<start:long,kind:int,stop:long>>"
ROUNDS, RATE, RIDGE, PRECISION, LEAST, PROBABILITY = 80, 0.3, 1.0, 0.98, 5, 0.8
#: What an unlabelled candidate weighs as a negative: at 0.1 and a probability of 0.8, other notations may be 2.5 times as frequent as the base one among candidates alike.
UNLABELLED = 0.1


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, join) -> Column:
    """For each of an array of longs what join makes of all before it, from 0 on. By chunks, since appending copies an array."""
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def along(array: Column, of) -> Column:
        return F.aggregate(array, start, lambda acc, x: F.struct(join(acc["at"], of(x)).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined_up(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, along(parts, lambda p: p["at"])["out"], lambda p, b: F.transform(p["out"], lambda x: join(x, b))))

    def over(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda j: F.slice(v, j * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(v) > 0, let(F.transform(chunks, lambda c: along(c, lambda x: x)), joined_up)).otherwise(none)

    # Bound, so that the values are worked out once and not for each chunk.
    return let(values, over)


def matches(text: Column, pattern: str) -> Column:
    """MATCHES of all leftmost matches, which don't overlap. Text between matches comes from split with the same pattern."""

    def placed(b: Column) -> Column:
        n = F.size(b["found"])
        each = F.arrays_zip(F.slice(b["gaps"], 1, n).alias("gap"), b["found"].alias("value"), F.slice(b["gaps"], 2, n).alias("next"))
        ends = running(F.transform(each, lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long")), lambda a, x: a + x)

        def one(x: Column, at: Column) -> Column:
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("stop"), x["value"].alias("value"), F.right(x["gap"], F.lit(20)).alias("before"), F.left(x["next"], F.lit(1)).alias("after"))

        return F.zip_with(each, ends, one)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(F.expr("0") + c.cast("int"), i))
    return (F.length(digits) > 0) & (F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0)


def octets(value: Column) -> Column:
    """Whether a dotted value is four numbers up to 255."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,3}\z") & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, stop>> of the fixed patterns, by start, then kind as in KINDS."""
    none = F.array().cast(MATCHES)
    at, digit, plus = F.contains(text, F.lit("@")), text.rlike("[0-9]"), F.contains(text, F.lit("+"))
    n = lambda v: F.length(digits_of(v))
    kept = [
        F.when(at, matches(text, EMAIL)).otherwise(none),
        F.filter(F.when(digit, matches(text, IP)).otherwise(none), lambda m: octets(m["value"])),
        F.filter(F.when(digit, matches(text, CARD)).otherwise(none), lambda m: n(m["value"]).between(12, 19) & F.when(n(m["value"]).between(12, 19), luhn(digits_of(m["value"]))).otherwise(False)),
        F.filter(F.when(plus & digit, matches(text, PHONE)).otherwise(none), lambda m: n(m["value"]).between(9, 15)),
    ]
    tagged = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["stop"].alias("stop"))
    return F.array_sort(F.concat(*[F.transform(m, tagged(k)) for k, m in enumerate(kept)]))


def _context(c: Column) -> Column:
    """0 at an end of the text or white space, 1 at a mark or another match, 2 at a letter or digit."""
    return F.when(c.rlike(r"\s"), 0).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(1)


def possible(kind: int, value: Column, digits: Column, domain: Column) -> Column:
    """Whether a candidate may be of the kind at all, for labels: an address ends like a domain, and numbers have the kind's digits, octets and check digit."""
    n = F.length(digits)
    if kind == 0:
        return domain > 0
    if kind == 1:
        return octets(F.regexp_replace(value, "[^0-9]+", "."))
    return n.between(12, 19) & F.when(n.between(12, 19), luhn(digits)).otherwise(False) if kind == 2 else n.between(9, 15)


def _candidate(m: Column, kind: int, value: Column, domain: Column) -> Column:
    """A struct of span, features, and whether it is written in base notation and possible."""
    digits = digits_of(value)
    n, k, cue, written = F.length(digits), F.lit(kind), m["before"].rlike(CUE), m["value"].rlike(WRITTEN[kind])
    number = lambda x: F.lit(0) if kind == 0 else x
    return F.struct(
        m["start"].alias("start"), k.alias("kind"), m["stop"].alias("stop"),
        number(F.when(n.between(12, 19), luhn(digits).cast("int")).otherwise(0)).alias("luhn"),
        number(F.when(n < 9, 0).when(n < 12, 1).when(n == 12, 2).when(n < 15, 3).when(n == 15, 4).when(n == 16, 5).when(n < 20, 6).otherwise(7)).alias("digits"),
        number(octets(F.regexp_replace(value, "[^0-9]+", ".")).cast("int")).alias("octets"),
        number(F.contains(value, F.lit("(")).cast("int")).alias("parens"),
        number(F.least(F.size(F.split(value, "[^0-9]+")) - 1, F.lit(3))).alias("groups"),
        F.when(m["before"] == "", F.when(m["start"] == 0, 0).otherwise(1)).otherwise(_context(F.right(m["before"], F.lit(1)))).alias("before"),
        F.when(m["after"] == "", 0).otherwise(_context(m["after"])).alias("after"),
        cue.cast("int").alias("cue"), domain.alias("domain"), written.alias("written"), (possible(kind, value, digits, domain) | (written & (k == 0))).alias("possible"),
    )


def addresses(text: Column) -> Column:
    """Candidates for e-mail addresses, spelled or plain."""
    found = F.when(text.rlike(SPELLED), matches(text, ADDRESS)).otherwise(F.array().cast(MATCHES))
    of = lambda m: F.regexp_replace(F.regexp_replace(m["value"], r"(?i)\x20dot\x20|\x20?[(\[{]dot[)\]}]\x20?", "."), r"(?i)\x20at\x20|\x20?[(\[{]at[)\]}]\x20?", "@")
    top = lambda m: F.regexp_extract(of(m), r"\.([A-Za-z0-9-]+)\z", 1)
    # With "at" spelled bare and a plain dot, as where a sentence ends without a space, the domain counts as unknown.
    bare = lambda m: m["value"].rlike(r"(?i)\x20at\x20[A-Za-z0-9-]+\.") & ~m["value"].rlike(r"(?i)dot")
    domain = lambda m: F.when(top(m).rlike("^[A-Za-z]{2,12}$"), F.when(top(m).rlike(KNOWN_TOP) & ~bare(m), 2).otherwise(1)).otherwise(0)
    return F.transform(found, lambda m: _candidate(m, 0, of(m), domain(m)))


def numbers(text: Column) -> Column:
    """array<array<candidate>>: each number as address, card and phone."""
    found = F.when(text.rlike(r"[0-9](?:[^0-9]{0,3}[0-9]){6}"), matches(text, NUMBER)).otherwise(F.array().cast(MATCHES))
    return F.transform(found, lambda m: F.array(*[_candidate(m, k, m["value"], F.lit(0)) for k in (1, 2, 3)]))


def candidates(text: Column) -> Column:
    """Every number as address, card and phone, and every spelled or plain e-mail address."""
    return F.concat(addresses(text), F.flatten(numbers(text)))


@dataclass
class Trees:
    """Boosted trees of depth two, (root, left, right, leaves) with splits (feature, greatest value that goes left), and a threshold on the log-odds for each kind (None: nothing is accepted)."""

    bias: float
    trees: list[tuple]
    thresholds: list[float | None]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for (f, t), (lf, lt), (rf, rt), leaves in self.trees:
            left = x[:, f] <= t
            out += np.where(left, np.where(x[:, lf] <= lt, leaves[0], leaves[1]), np.where(x[:, rf] <= rt, leaves[2], leaves[3]))
        return out

    def margins(self, kind: int | None) -> np.ndarray:
        """By combination of the varying features, how far the score is above the kind's threshold; -1 below. kind: 0 for addresses, None for numbers."""
        names = VARYING["numbers" if kind is None else "addresses"]
        combinations = np.indices([FEATURES[n] for n in names]).reshape(len(names), -1)
        x = np.zeros((combinations.shape[1], len(FEATURES)), int)
        x[:, [list(FEATURES).index(n) for n in names]] = combinations.T
        limits = np.array([np.inf if t is None else t for t in self.thresholds])[x[:, 0]]
        above = self.raw(x) - limits
        return np.where((above >= 0) & (x[:, 0] == 0 if kind == 0 else (above >= 0) & (x[:, 0] > 0)), above, -1.0)

    def margin(self, c: Column, names: tuple[str, ...], kind: int | None) -> Column:
        """The margin of a candidate, looked up; the array is one constant."""
        cell = F.lit(0)
        for n in names:
            cell = cell * FEATURES[n] + c[n]
        values = F.split(F.lit(",".join(f"{v:.4g}" for v in self.margins(kind))), ",").cast("array<double>")
        return F.get(values, cell)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """The split with most gain; (0, 99), which sends all left, if none gains."""
    best, where = (g.sum() ** 2 / (h.sum() + RIDGE)) + 1e-9, (0, 99)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            gain = g[left].sum() ** 2 / (h[left].sum() + RIDGE) + g[~left].sum() ** 2 / (h[~left].sum() + RIDGE)
            if gain > best:
                best, where = gain, (f, int(t))
    return where


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray, check_positive: np.ndarray, check_total: np.ndarray) -> Trees:
    """x: one row for each feature combination, with the weight of its candidates and how many of them are base spans, in the fitting folds, and those of the labelled ones in the held-out fold."""
    none = Trees(0.0, [], [None] * len(KINDS))
    if not total.sum():
        return none
    rate = (positive.sum() + 0.5) / (total.sum() + 1)
    model = Trees(float(np.log(rate / (1 - rate))), [], [None] * len(KINDS))
    score = np.full(len(x), model.bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        root = _split(x, g, h)
        left = x[:, root[0]] <= root[1]
        sides = [_split(x[s], g[s], h[s]) if s.any() else (0, 99) for s in (left, ~left)]
        leaves = []
        for s, (f, t) in zip((left, ~left), sides, strict=True):
            for own in (s & (x[:, f] <= t), s & (x[:, f] > t)):
                leaves.append(float(RATE * g[own].sum() / (h[own].sum() + RIDGE)))
        model.trees.append((root, *sides, leaves))
        score = model.raw(x)
    for k in range(len(KINDS)):
        own = np.flatnonzero((x[:, 0] == k) & (check_total > 0))
        if positive[x[:, 0] == k].sum() == 0:
            continue
        own = own[np.argsort(-score[own], kind="stable")]
        hits, seen = np.cumsum(check_positive[own]), np.cumsum(check_total[own])
        last = np.append(score[own][1:] != score[own][:-1], True) if len(own) else np.zeros(0, bool)
        good = np.flatnonzero(last & (seen >= LEAST) & (hits >= PRECISION * seen))
        if len(good):
            model.thresholds[k] = max(float(score[own][good[-1]]), float(np.log(PROBABILITY / (1 - PROBABILITY))))
    return model


def fit(docs: DataFrame) -> Trees:
    """Boosted over counts of feature combinations from every row of docs; the driver receives at most twice CELLS rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.expr(f"coalesce({held_out_sql()}, false)").alias("held_out"), text.alias("text")).where(F.col("text").rlike(r"[0-9]") | F.col("text").rlike(SPELLED))
    rows = rows.select("held_out", F.explode(candidates(F.col("text"))).alias("c"))
    counted = rows.select("held_out", F.expr("c.written AND c.possible").cast("long").alias("hit"), F.expr("c.written OR NOT c.possible").cast("long").alias("sure"), *[F.col(f"c.{n}").alias(n) for n in FEATURES])
    cells = counted.groupBy("held_out", *FEATURES).agg(F.sum("hit").alias("hits"), F.sum("sure").alias("sure"), F.count(F.lit(1)).alias("n")).collect()
    index: dict[tuple, int] = {}
    for r in cells:
        index.setdefault(tuple(r[n] for n in FEATURES), len(index))
    counts = np.zeros((4, len(index)))
    for r in cells:
        i = index[tuple(r[n] for n in FEATURES)]
        counts[0 + 2 * r.held_out, i], counts[1 + 2 * r.held_out, i] = r.hits, r.sure if r.held_out else r.sure + UNLABELLED * (r.n - r.sure)
    order = sorted(index, key=lambda k: k)
    at = [index[k] for k in order]
    return boost(np.array(order, int).reshape(-1, len(FEATURES)), *counts[:, at])


def with_spans(docs: DataFrame, model: Trees, text: str = "text", name: str = "pii") -> DataFrame:
    """docs with struct<base, added>, each array<struct<start, kind, stop>> by start, then kind; added ones overlap nothing else."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast(SPANS)
    base = F.when(t.rlike("[0-9@]"), base_spans(t)).otherwise(none)
    if all(x is None for x in model.thresholds):
        return docs.withColumn(name, F.struct(base.alias("base"), none.alias("added")))
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))
    of = {kind: lambda c, k=kind: model.margin(c, VARYING[k], 0 if k == "addresses" else None) for kind in VARYING}
    good = lambda c: of["addresses"](c) >= 0

    def added(free: Column) -> Column:
        spelled = F.transform(F.filter(addresses(free), good), span)

        def with_numbers(own: Column) -> Column:
            best = F.transform(numbers(F.when(F.size(own) > 0, masked(free, own)).otherwise(free)), lambda kinds: F.array_max(F.transform(kinds, lambda c: F.struct(of["numbers"](c).alias("margin"), span(c).alias("span")))))
            return F.array_sort(F.concat(own, F.transform(F.filter(best, lambda x: x["margin"] >= 0), lambda x: x["span"])))

        return let(spelled, with_numbers)

    held = docs.withColumn(name, base)
    own = F.col(name)
    free = F.when(F.size(own) > 0, masked(t, own)).otherwise(t)
    wide = t.rlike(r"[0-9](?:[^0-9]{0,3}[0-9]){6}") | t.rlike(SPELLED)
    return held.withColumn(name, F.struct(own.alias("base"), F.when(wide, let(free, added)).otherwise(none).alias("added")))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, first, more) -> Column:
    """The text with first(span) for each span that begins no earlier than all before it end, and more(span, where those end) for others."""

    def whole(x: Column) -> Column:
        last = running(F.transform(x["spans"], lambda s: s["stop"]), lambda a, b: F.greatest(a, b))

        def piece(a: Column, b: Column) -> Column:
            """Code points a to b."""
            chunk, count = F.floor(a / PIECE).cast("int"), (F.floor(b / PIECE) - F.floor(a / PIECE) + 1).cast("int")
            return F.substring(F.array_join(F.slice(x["pieces"], chunk + 1, count), ""), (a % PIECE + 1).cast("int"), (b - a).cast("int"))

        parts = F.zip_with(x["spans"], last, lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), first(s))).otherwise(more(s, at)))
        rest = piece(F.array_max(F.transform(x["spans"], lambda s: s["stop"])), F.length(text).cast("long"))
        return F.concat(F.array_join(parts, ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))
    return let(F.struct(F.array_sort(spans).alias("spans"), pieces.alias("pieces")), whole)


def masked(text: Column, spans: Column) -> Column:
    """The text, as long as before, with a filler that no pattern knows in place of all that spans cover."""
    fill = lambda n: F.repeat(F.lit(FILLER), F.greatest(n, F.lit(0)).cast("int"))
    return _replaced(text, spans, lambda s: fill(s["stop"] - s["start"]), lambda s, at: fill(s["stop"] - at))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by the kind of its first span, in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return F.when(F.size(spans) > 0, _replaced(text, spans, lambda s: F.get(names, s["kind"]), lambda s, at: F.lit(""))).otherwise(text)
