"""Personal data by weak supervision, in DataFrame expressions throughout.

Base rules find e-mail addresses, IP addresses, card and phone numbers exactly. Wider
patterns propose further spans: the base kinds in other spellings, social security
numbers and names. Labelers vote on every candidate, for, against or not at all: its
regular form, a gazetteer (domains, prefixes, given names), and the words around it.
Expectation-maximisation estimates how reliable each labeler is for each kind, with
base spans known to be right; a logistic classifier over the votes and the length is
then fitted to the posteriors, and candidates it accepts are added to the base spans.
Both fits use counts of vote patterns over all rows, at most a few hundred numbers
whatever the size of the table; scoring is an expression again.

Positions are code points, end exclusive. Edges: a null text counts as empty and has no
spans; a candidate that overlaps a base span is not added; without candidates nothing
is. Repeated rows have the same spans. An empty table gives no rows. A text is one row; work
on it grows with its length, and with its n matches as n times the square root of n.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecite.functions.text import let
from tablecite.llm.storage import written

#: Kinds in the order they are listed. Patterns give the leftmost matches that do not
#: overlap. Possessive repeats and the look-behinds keep a search linear: a match that
#: fails at the start of a run of its characters fails inside of it too.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*BASE, "name", "ssn"]
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": r"(?<=\b(?:Mr|Ms|Mrs|Dr)\.? |\b[Nn]ame is |\bDear )[A-Z][a-z]+(?: [A-Z][a-z]+)?",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Fixed values of the gazetteer: top-level domains, then common given names.
DOMAINS = "com org net edu gov info io de fr es uk eu ch at it nl".split()
NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan "
    "Joseph Jessica Thomas Sarah Charles Karen Anna Maria Peter Hans Klaus Pierre Marie Jean Carlos Juan"
).split()
FORM = {
    "email": r"^[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)* ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}$",
    "phone": r"^(?:\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4})$",
    "name": r"^[A-Z][a-z]+ [A-Z][a-z]+$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
LISTED = {
    "email": r"(?i)(?:\.|[\[(]dot[\])]) ?(?:" + "|".join(DOMAINS) + ")$",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^\+(?:1|[2-9][0-9])|^\(?[2-9]",
    "name": "^(?:" + "|".join(NAMES) + r")\b",
}
AROUND = {
    "email": r"e-?mail|mail|contact|write|address",
    "ip": r"\bip\b|address|server|host|login|client",
    "card": r"card|visa|credit|debit|payment|account",
    "phone": r"phone|call|tel\b|mobile|fax|dial|sms|whatsapp",
    "name": r"\bi am|signed|regards|contact|born|name|dear|mr\b|ms\b|mrs\b|dr\b",
    "ssn": r"ssn|social|security|tax id",
}
LABELERS = ["form", "listed", "around"]
WINDOW = 32
#: Beyond any place in a text.
FAR = 2**31 - 1


#: Code points of a piece of text that is looked at for what stands around a match.
PAGE = 1024


def _running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of integers what all earlier ones combine to.

    Arrays are built block by block of the square root of their length, so that no more than that is copied per value.
    """

    def prefix(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

        return F.aggregate(part, state, step, lambda acc: acc["out"])

    def in_blocks(all_: Column) -> Column:
        def cut(width: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(all_) - 1, width), lambda at: F.slice(all_, at + 1, width))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda a, x: combine(a, x)))
            return F.flatten(F.zip_with(blocks, prefix(totals, zero), prefix))

        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return F.when(F.size(all_) > 0, let(width, lambda w: let(cut(w), joined))).otherwise(F.array().cast("array<int>"))

    return let(values, in_blocks)


def _found(text: Column, pattern: str) -> Column:
    """Matches with their code-point positions, from the lengths of matches and of what is between."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(matches, F.split(text, pattern, -1), lambda m, g: F.struct(g.alias("gap"), m.alias("span")))

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: F.char_length(p["gap"]) + F.char_length(p["span"]))

        def item(pair: Column, at: Column) -> Column:
            begin = at + F.char_length(pair["gap"])
            return F.struct(begin.alias("start"), (begin + F.char_length(pair["span"])).alias("end"), pair["span"].alias("span"))

        return F.zip_with(pairs, _running(lengths, F.lit(0), lambda a, b: a + b), item)

    # The last piece between matches has no match behind it.
    return let(F.filter(pairs, lambda p: p["span"].isNotNull()), placed)


def _around(pages: Column, start: Column, end: Column) -> Column:
    """The text before and after a match, from pages of the text: a whole text would be walked through for each."""

    def page(i: Column) -> Column:
        return F.coalesce(F.get(pages, i), F.lit(""))

    def page_of(at: Column) -> Column:
        return F.floor(at / PAGE).cast("int")

    from_ = F.greatest(start - WINDOW, F.lit(0))
    base = F.greatest((page_of(start) - 1) * PAGE, F.lit(0))
    left = F.when(base == 0, F.concat(page(F.lit(0)), page(F.lit(1)))).otherwise(F.concat(page(page_of(start) - 1), page(page_of(start))))
    right = F.concat(page(page_of(end)), page(page_of(end) + 1))
    before = F.substring(left, from_ - base + 1, start - from_)
    return F.lower(F.concat_ws(" ", before, F.substring(right, end - page_of(end) * PAGE + 1, F.lit(WINDOW))))


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (1 + (i + 1) % 2)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    n = F.char_length(_digits(span))
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(span))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _plausible(kind: str, span: Column) -> Column:
    """Whether a match that fails the base rules may still be a mistyped span of its kind."""
    n = F.char_length(_digits(span))
    if kind == "ip":
        return span.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return n.between(13, 19) if kind == "card" else n.between(7, 15) if kind == "phone" else F.lit(True)


def _vote(pattern: str | None, value: Column) -> Column:
    return F.lit(-1) if pattern is None else value.rlike(pattern).cast("int")


def _judged(pages: Column, kind: str, spans: Column, form: str | None, base: bool) -> Column:
    """Candidates of one kind with their votes (1, 0, or -1 for none) and whether the base rules accept them."""

    def judge(s: Column) -> Column:
        around = _around(pages, s["start"], s["end"])
        valid = _valid(kind, s["span"]) if base else F.lit(False)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            valid.alias("base"),
            (valid.cast("int") if base else _vote(form, s["span"])).alias("form"),
            _vote(LISTED.get(kind), s["span"]).alias("listed"),
            _vote(AROUND[kind], around).alias("around"),
            F.least(F.char_length(s["span"]).cast("int"), F.lit(31)).alias("length"),
        )

    if base:
        spans = F.filter(spans, lambda s: _valid(kind, s["span"]) | _plausible(kind, s["span"]))
    return F.transform(spans, judge)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: all candidates with votes; those of the base rules have ``base`` set."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Most texts lack the one character a kind needs: they are not searched for it.
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "name": None, "ip": None, "card": None}
    none = F.array().cast("array<struct<start:int,end:int,span:string>>")
    found = {}
    for prefix, patterns in (("b", BASE), ("w", WIDE)):
        for kind, pattern in patterns.items():
            need = needs.get(kind) if prefix == "b" else None
            need = text.rlike(pattern) if need is None else need
            found[f"{prefix}_{kind}"] = F.when(need, _found(text, pattern)).otherwise(none)
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)).alias("pages")
    spans = rows.select("doc_id", pages, *(c.alias(n) for n, c in found.items()))
    judged = [_judged(F.col("pages"), k, F.col(f"b_{k}"), None, True) for k in BASE]
    judged += [_judged(F.col("pages"), k, F.col(f"w_{k}"), FORM[k], False) for k in WIDE]
    return spans.select("doc_id", F.concat(*judged).alias("spans"))


def reliabilities(patterns: list[dict], rounds: int = 60) -> list[float]:
    """EM over counted vote patterns: for each, the probability that its candidates are right.

    Every kind has a prior and, for each labeler, rates of each vote given the truth.
    """
    p = [1.0 if r["base"] else (1 + sum(r[v] == 1 for v in LABELERS)) / (2 + sum(r[v] >= 0 for v in LABELERS)) for r in patterns]
    for _ in range(rounds):
        prior, rate, mass = defaultdict(float), defaultdict(float), defaultdict(float)
        for r, x in zip(patterns, p):
            for y, w in ((1, x * r["n"]), (0, (1 - x) * r["n"])):
                prior[r["kind"], y] += w
                for v in LABELERS:
                    rate[r["kind"], v, y, r[v]] += w
                    mass[r["kind"], v, y] += w
        new = []
        for r in patterns:
            logs = []
            for y in (1, 0):
                log = math.log(prior[r["kind"], y] + 1)
                for v in LABELERS:
                    # A labeler is taken to be right more often than not, until counts say otherwise.
                    fair = {1: 2.0, 0: 1.0, -1: 1.5}[r[v]] if y else {1: 1.0, 0: 2.0, -1: 1.5}[r[v]]
                    log += math.log((rate[r["kind"], v, y, r[v]] + fair) / (mass[r["kind"], v, y] + 4.5))
                logs.append(log)
            new.append(1.0 if r["base"] else 1 / (1 + math.exp(min(logs[1] - logs[0], 500))))
        p = new
    return p


def _features(r: dict) -> list[tuple]:
    return [("kind", r["kind"]), *((v, r[v]) for v in LABELERS), ("length", r["length"] // 8)]


def classifier(patterns: list[dict], p: list[float], rounds: int = 300) -> dict[tuple, float]:
    """Weights of a logistic regression of the posteriors on votes, kind and length."""
    weights: dict[tuple, float] = defaultdict(float)
    total = sum(math.log1p(r["n"]) for r in patterns) or 1.0
    for _ in range(rounds):
        grad: dict[tuple, float] = defaultdict(float)
        for r, x in zip(patterns, p):
            z = sum(weights[f] for f in _features(r))
            g = (1 / (1 + math.exp(-max(min(z, 30.0), -30.0))) - x) * math.log1p(r["n"]) / total
            for f in _features(r):
                grad[f] += g
        for f, g in grad.items():
            weights[f] -= 4.0 * (g + 1e-4 * weights[f])
    return dict(weights)


def _accepted(span: Column, weights: dict[tuple, float]) -> Column:
    """Whether the classifier gives a candidate half or more; the weights become a literal table each."""
    z = F.lit(0.0)
    for name in ("kind", *LABELERS, "length"):
        value = F.floor(span["length"] / 8) if name == "length" else span[name]
        own = {k: w for (n, k), w in weights.items() if n == name}
        part = F.lit(0.0)
        for k, w in own.items():
            part = F.when(value == k, w).otherwise(part)
        z = z + part
    return z >= 0


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: (kind, start, end, base) of all spans, by kind as listed, then start."""
    found = written(candidates(docs), "pii-candidates")
    votes = found.select(F.explode("spans").alias("s")).select("s.*").withColumn("length", (F.floor(F.col("length") / 8) * 8).cast("int"))
    columns = ["kind", "base", *LABELERS, "length"]
    patterns = [r.asDict() for r in votes.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns).collect()]
    weights = classifier(patterns, reliabilities(patterns))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("from"), (~s["base"]).alias("late"), s.alias("s"))))

    def kept(spans: Column) -> Column:
        """Base spans, and accepted ones that overlap none: neither one that starts before, nor the next that starts."""
        reach = _running(F.transform(spans, lambda x: F.when(x["late"], -1).otherwise(x["s"]["end"])), F.lit(-1), F.greatest)
        starts = F.transform(F.reverse(spans), lambda x: F.when(x["late"], FAR).otherwise(x["from"]))
        following = F.reverse(_running(starts, F.lit(FAR), F.least))
        near = F.zip_with(reach, following, lambda r, f: F.struct(r.alias("reach"), f.alias("next")))
        judged = F.zip_with(
            spans,
            near,
            lambda x, n: F.when(
                x["s"]["base"] | (_accepted(x["s"], weights) & (n["reach"] <= x["from"]) & (n["next"] >= x["s"]["end"])), x["s"]
            ),
        )
        return F.filter(judged, lambda s: s.isNotNull())

    narrow = F.transform(
        let(ordered, kept),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")),
    )
    return found.select("doc_id", F.array_sort(narrow).alias("spans"))


def named(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def of(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    counts = {f"n_{k}": of(k) for k in BASE}
    return found.select(
        "doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans")
    )
