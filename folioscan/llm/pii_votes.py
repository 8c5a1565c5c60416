"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of four base patterns (e-mail, IP address, card, phone), valid or not, and of looser patterns.
Five labelers vote 1, 0 or -1 on each: the strict pattern with its checks, a gazetteer (top-level domains, issuer prefixes,
calling codes), cue words before the span, the characters around it, and its format. Over all candidates of the corpus the
vote patterns are counted; on these counts expectation-maximisation estimates how reliable each labeler is for each kind. A
logistic span classifier is trained on the resulting probabilities. It sees the span itself (length, share of digits,
separators, the characters on both sides, in bins) and all votes but the strict one, which it has to make up for from these.
Valid base spans stay whatever it says; other candidates are added where it gives at least ``threshold`` and no base span
overlaps. What the driver gets are counts of patterns, at most 4 x 3^5 x 720 rows however large the corpus is; some hundreds
occur.

Positions are code points, end exclusive. Defined results: a null text is an empty one and has no spans; repeated rows are
searched each; null ids stay; an empty table gives an empty result; without candidates there is nothing to learn or add.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import pick, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "listed", "cued", "parted", "shaped")
#: What the classifier sees of a span, and the number of bins of each.
FEATURES = {"size": 5, "share": 4, "parts": 4, "left": 3, "right": 3}
THRESHOLD = 0.5

#: Same matches as the plain forms below; possessive parts and the look-behinds only spare the engine repeated scans.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
NEEDS = {"email": "@", "phone": "+"}
LOOSE_NEEDS = {"email": "dot", "ip": ":", "phone": "-|.| "}
DOMAINS = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "pl", "us", "ca", "jp", "cn", "in", "br", "ru", "se")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6(?:011|4|5|2))"
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\W{0,3}\w{0,8}\W{0,3}$",
    "ip": r"(?i)(?:ip|addr|address|host|server|client|from)\W{0,3}\w{0,8}\W{0,3}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment)\W{0,3}\w{0,8}\W{0,3}$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|cell|telefon|teléfono|whatsapp|sms)\W{0,3}\w{0,8}\W{0,3}$",
}
AGAINST = r"(?i)(?:order|invoice|version|isbn|serial|sku|ref|build|ticket|item|page|doi|id)\W{0,3}\w{0,3}\W{0,3}$"
SHAPES = {
    "email": r"^[^@]{1,64}@[^@]{3,255}$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{16}|[0-9]{15}|[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})$",
    "phone": r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}$",
}
CONTEXT = 32


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a string of digits."""

    def add(total, i):
        x = F.substring(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(text, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        n = digits(text)
        return F.length(n).between(12, 19) & luhn(F.substring(n, 1, 19))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it inside of its own functions on arrays."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers (from 0) the fold of all before it. Blocks of about n^(1/3) keep this far from quadratic."""

    def blocks(v: Column) -> Column:
        n, zero = F.size(v), F.lit(0)
        width = F.greatest(F.lit(1), F.cbrt(n).cast("int"))
        folded = F.transform(F.sequence(zero, ((n - 1) / width).cast("int")), lambda b: F.aggregate(F.slice(v, b * width + 1, width), zero, fold))
        before = let(folded, lambda f: F.transform(f, lambda _, b: F.aggregate(F.slice(f, F.lit(1), b), zero, fold)))
        each = let(F.struct(width.alias("w"), before.alias("before")), lambda x: F.transform(v, lambda _, i: F.aggregate(F.slice(v, i - i % x["w"] + 1, i % x["w"]), F.element_at(x["before"], (i / x["w"]).cast("int") + 1), fold)))
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(each)

    return let(values, blocks)


def hits(text: Column, pattern: str, needs: str | None) -> Column:
    """Matches in order: start, end, text, up to CONTEXT characters before, one after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def spans(x: Column) -> Column:
        steps = F.transform(x["found"], lambda h, i: F.length(F.element_at(x["pieces"], i + 1)) + F.length(h))

        def span(h: Column, i: Column, at: Column) -> Column:
            before, after = F.element_at(x["pieces"], i + 1), F.element_at(x["pieces"], i + 2)
            a = F.element_at(at, i + 1) + F.length(before)
            return F.struct(a.alias("start"), (a + F.length(h)).alias("end"), h.alias("hit"), F.substring(before, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, 1).alias("after"))

        return let(running(steps, lambda n, v: n + v), lambda at: F.transform(x["found"], lambda h, i: span(h, i, at)))

    there = F.lit(True)
    if needs:
        there = F.lit(False)
        for n in needs.split("|"):
            there = there | F.contains(text, F.lit(n))
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    return F.when(there & F.rlike(text, F.lit(pattern)), let(F.struct(found.alias("found"), pieces.alias("pieces")), spans)).otherwise(none)


def votes(kind: str, x: Column, strict: Column) -> list[Column]:
    hit = x["hit"]
    sign = lambda c: F.when(c, 1).otherwise(-1)
    if kind == "email":
        listed = sign(F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS))
    elif kind == "ip":
        listed = F.when(F.rlike(hit, F.lit(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")), 1).when(F.rlike(hit, F.lit(r"^0")), -1).otherwise(0)
    elif kind == "card":
        listed = sign(F.rlike(digits(hit), F.lit(ISSUERS)))
    else:
        listed = F.when(F.startswith(hit, F.lit("+")), sign(F.rlike(hit, F.lit(CALLING)))).otherwise(sign(F.rlike(hit, F.lit(r"^\(?[2-9]"))))
    cued = F.when(F.rlike(x["before"], F.lit(CUES[kind])), 1).when(F.rlike(x["before"], F.lit(AGAINST)), -1).otherwise(0)
    parted = sign(~F.rlike(F.concat(F.substring(x["before"], -1, 1), F.lit("|"), x["after"]), F.lit(r"[\p{L}\p{N}_]")))
    shaped = F.when(F.rlike(hit, F.lit(SHAPES[kind])), 1).otherwise(0)
    return [sign(strict), listed, cued, parted, shaped]


def _binned(value: Column, *edges) -> Column:
    """How many of the edges the value reaches."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return out


def features(x: Column) -> list[Column]:
    hit, beside = x["hit"], lambda c: F.when(c == "", 0).when(F.rlike(c, F.lit(r"[\p{L}\p{N}_]")), 2).when(F.rlike(c, F.lit(r"\s")), 0).otherwise(1)
    n, bare = F.length(hit), F.length(F.regexp_replace(hit, r"[^\p{L}\p{N}]", ""))
    return [_binned(n, 8, 13, 17, 25), _binned(F.length(digits(hit)) / n, 0.25, 0.6, 0.9), _binned(n - bare, 1, 3, 5), beside(F.substring(x["before"], -1, 1)), beside(x["after"])]


def _voter(k: int, loose: bool):
    def span(x: Column) -> Column:
        strict = F.lit(False) if loose else valid(KINDS[k], x["hit"])
        named = [v.cast("int").alias(n) for n, v in zip([*LABELERS, *FEATURES], [*votes(KINDS[k], x, strict), *features(x)], strict=True)]
        return F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), *named)

    return span


def candidates(docs: DataFrame) -> DataFrame:
    """docs with a column cands: kind (its number), start, end, a vote of each labeler and the features."""
    docs = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    parts = []
    for k, kind in enumerate(KINDS):
        for loose, pattern in ((False, BASE[kind]), (True, LOOSE.get(kind))):
            if pattern is None:
                continue

            parts.append(F.transform(hits(F.col("_t"), pattern, (LOOSE_NEEDS if loose else NEEDS).get(kind)), _voter(k, loose)))
    return docs.withColumn("cands", F.concat(*parts)).drop("_t")


def estimate(counts: list[tuple], rounds: int = 40) -> dict[tuple, float]:
    """Expectation-maximisation per kind on rows (kind, votes..., n): the probability that a vote pattern marks personal data."""
    out: dict[tuple, float] = {}
    for kind in sorted({c[0] for c in counts}):
        rows = [(c[1:-1], c[-1]) for c in counts if c[0] == kind]
        p = [1 / (1 + math.exp(-sum(v))) for v, _ in rows]
        for _ in range(rounds):
            share = {}
            prior = [1.0, 1.0]
            for (v, n), q in zip(rows, p, strict=True):
                for y, w in ((1, q * n), (0, (1 - q) * n)):
                    prior[y] += w
                    for i, x in enumerate(v):
                        share[i, x, y] = share.get((i, x, y), 0.0) + w
            new = []
            for v, _ in rows:
                s = [math.log(prior[y]) + sum(math.log((share.get((i, x, y), 0.0) + 1) / (prior[y] + 2)) for i, x in enumerate(v)) for y in (0, 1)]
                new.append(1 / (1 + math.exp(max(-60.0, min(60.0, s[0] - s[1])))))
            p = new
        out |= {(kind, *v): q for (v, _), q in zip(rows, p, strict=True)}
    return out


class SpanClassifier:
    """Logistic weights for each (kind, input, value), trained on the estimated probabilities; inputs are INPUTS.

    counts: rows (kind, votes..., features..., n)."""

    INPUTS = (*LABELERS[1:], *FEATURES)

    def __init__(self, counts: list[tuple], rounds: int = 150, rate: float = 0.6, ridge: float = 1e-3):
        nv, per_votes = len(LABELERS), {}
        for c in counts:
            per_votes[c[: 1 + nv]] = per_votes.get(c[: 1 + nv], 0) + c[-1]
        target = estimate([(*k, n) for k, n in per_votes.items()])
        self.weights: dict[tuple, float] = {}
        for kind in sorted({c[0] for c in counts}):
            wanted: dict[tuple, list[float]] = {}
            for c in counts:
                if c[0] == kind:
                    at = wanted.setdefault(c[2:-1], [0.0, 0.0])
                    at[0] += c[-1] ** 0.5
                    at[1] += c[-1] ** 0.5 * target[c[: 1 + nv]]
            total = sum(n for n, _ in wanted.values())
            rows = [([(kind, i, x) for i, x in enumerate(v)], n / total, q / n) for v, (n, q) in wanted.items()]
            w = {(kind,): 0.0} | dict.fromkeys((k for keys, _, _ in rows for k in keys), 0.0)
            for _ in range(rounds):
                slope = {k: ridge * x for k, x in w.items()}
                for keys, n, q in rows:
                    s = w[kind,] + sum(w[k] for k in keys)
                    d = n * (1 / (1 + math.exp(max(-60.0, min(60.0, -s)))) - q)
                    slope[kind,] += d
                    for k in keys:
                        slope[k] += d
                w = {k: x - rate * slope[k] for k, x in w.items()}
            self.weights |= w

    def probability(self, kind: int, values: tuple) -> float:
        """As score, for one span; values in the order of INPUTS."""
        s = self.weights.get((kind,), -60.0) + sum(self.weights.get((kind, i, x), 0.0) for i, x in enumerate(values))
        return 1 / (1 + math.exp(max(-60.0, min(60.0, -s))))

    def score(self, cand: Column) -> Column:
        """Probability as an expression on a candidate; 0 for kinds never seen."""
        out = F.lit(0.0)
        for k in range(len(KINDS)):
            if (k,) in self.weights:
                s = F.lit(self.weights[k,])
                for i, name in enumerate(self.INPUTS):
                    for x in range(FEATURES[name]) if name in FEATURES else (-1, 0, 1):
                        if (k, i, x) in self.weights:
                            s = s + F.when(cand[name] == x, self.weights[k, i, x]).otherwise(0.0)
                out = F.when(cand["kind"] == k, 1 / (1 + F.exp(-s))).otherwise(out)
        return out


def fit(found: DataFrame) -> SpanClassifier:
    """From the patterns of all candidates of a table with cands; their number is bounded by the bins."""
    names = [*LABELERS, *FEATURES]
    c = found.select(F.explode("cands").alias("c")).select("c.kind", *[f"c.{n}" for n in names])
    return SpanClassifier([tuple(r) for r in c.groupBy("kind", *names).agg(F.count("*").alias("n")).orderBy("kind", *names).collect()])


def decide(found: DataFrame, model: SpanClassifier, threshold: float = THRESHOLD) -> DataFrame:
    """Columns base and spans: arrays of (start, kind, end) in order, instead of cands."""
    bare = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    rows = found.withColumn("base", F.array_sort(F.transform(F.filter("cands", lambda c: c["strict"] == 1), bare)))
    more = F.filter("cands", lambda c: (c["strict"] == -1) & (model.score(c) >= threshold))
    for k in range(len(KINDS)):
        own = F.filter("base", lambda b: b["kind"] == k)  # noqa: B023
        more = let(F.struct(own.alias("base"), more.alias("cands")), lambda x: F.when(F.size(x["base"]) == 0, x["cands"]).otherwise(F.filter(x["cands"], lambda c: ~meets(c, x["base"]))))
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.array_distinct(F.transform(more, bare))))).drop("cands")


def meets(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of a non-empty array of spans that are in order and apart: it can only be the last that starts
    before the span's end, found by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(others) + 1)).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = ((at["low"] + at["high"]) / 2).cast("int")
        left = F.element_at(others, middle + 1)["start"] < span["end"]
        more = at["low"] < at["high"]
        return F.struct(F.when(more & left, middle + 1).otherwise(at["low"]).alias("low"), F.when(more & ~left, middle).otherwise(at["high"]).alias("high"))

    before = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(others).alias("high")), halve, lambda at: at["low"])
    return let(before, lambda n: F.when(n == 0, F.lit(False)).otherwise(F.element_at(others, F.greatest(n, F.lit(1)))["end"] > span["start"]))


def listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans of every row."""
    found = written(candidates(pick(docs, doc_id="long", text="string")).select("doc_id", "cands"), "candidates")
    return decide(found, fit(found), threshold)


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def masked(text: Column, spans: Column, width: int = 1024) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    names = F.array(F.lit(""), *[F.lit(f"[{k.upper()}]") for k in KINDS])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))

    def piece(x: Column, a: Column, b: Column) -> Column:
        """Characters from a to b, out of the blocks that hold them."""
        first, last = (a / width).cast("int"), (F.greatest(b - 1, a) / width).cast("int")
        return F.substring(F.array_join(F.slice(x["blocks"], first + 1, last - first + 1), ""), a % width + 1, b - a)

    def joined(x: Column) -> Column:
        # x.spans: those that begin a run, with stop, where the run before ends; a last one, of kind -1, closes the text
        put = F.transform(x["spans"], lambda s: F.concat(piece(x, s["stop"], s["start"]), F.element_at(names, s["kind"] + 2)))
        return F.array_join(put, "")

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    with_stops = let(ends, lambda at: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.element_at(at, i + 1).alias("stop"))))
    opening = F.filter(with_stops, lambda s: s["start"] >= s["stop"])
    final = F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("stop"))
    return let(F.struct(blocks.alias("blocks"), F.concat(opening, F.array(final)).alias("spans")), joined)
