"""Personal data by weak supervision. DataFrame functions only.

Base kinds (email, ip, card, phone) come from their patterns. Beyond these, candidates for secrets are voted on by
regex, gazetteer and context labelers; expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is, and the resulting posteriors train a span classifier (naive Bayes over shape and context
features), which decides. Only counts of vote patterns and of feature values reach the driver: fewer than 3**5 rows and
fewer than 100.

The patterns are possessive where that changes nothing, so that Java's matcher neither recurses nor scans twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.session import written

#: Where a match may begin is where its run of characters does, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")

#: Words before a secret, and words before other codes.
SECRET_WORDS = "password|passwd|passphrase|pwd|secret|token|credential|bearer|api[_-]?key|access[_-]?key|private[_-]?key"
OTHER_WORDS = "isbn|issn|doi|page|figure|version|chapter|section|order|invoice|serial|commit|revision|checksum|sha1|md5"
#: Forms of keys that well-known services give out.
KNOWN_FORMS = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk-[A-Za-z0-9]{20,}$|^[0-9a-f]{32}$|^[0-9a-f]{40}$|^[0-9a-f]{64}$"

#: Runs of 12 and more letters, digits, _ and - with a digit in them.
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{12,}+"
#: Values of 4 and more characters that are given a secret's name.
NAMED = rf"(?i)(?:{SECRET_WORDS})[\"']?\x20?[=:]\x20?[\"']?([^\s\"',;]{{4,}}+)"
#: So many characters before a candidate are its context.
CONTEXT = 24
#: Beyond all positions, negated.
FAR = -(2**31) + 1
ROUNDS = 50
ACCEPT = 0.5


def nothing() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,text:string,before:string>>)")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though the result names it more often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(numbers: Column, join=lambda a, x: a + x, first: int = 0) -> Column:
    """Running sums of an array of numbers, or what else ``join`` makes of them from ``first`` on. A fold copies what it has
    gathered at each step; it runs over pieces of about the square root of the array's size and over their totals, so that
    very many numbers do not cost their square."""
    gather = lambda seen, x: F.struct(join(seen["at"], x).alias("at"), F.concat(seen["found"], F.array(join(seen["at"], x))).alias("found"))
    start = lambda at: F.struct(at.alias("at"), F.expr("cast(array() as array<int>)").alias("found"))
    scan = lambda values, at: F.aggregate(values, start(at), gather)["found"]

    def over(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(first), join))
        before = F.slice(F.concat(F.array(F.lit(first)), scan(totals, F.lit(first))), F.lit(1), F.size(pieces))
        return F.flatten(F.zip_with(pieces, before, scan))

    def cut(values: Column) -> Column:
        n = F.greatest(F.size(values), F.lit(1))
        return bound(F.ceil(F.sqrt(n)).cast("int"), lambda size: F.transform(F.sequence(F.lit(1), n, size), lambda at: F.slice(values, at, size)))

    return bound(bound(numbers, cut), over)


def apart(found: Column, spans: Column) -> Column:
    """The located matches of ``found`` that overlap none of ``spans``: both in one order of start, each is held against
    the farthest end so far and the next start."""
    marked = lambda of, yes: F.transform(of, lambda c: F.struct(*[c[k].alias(k) for k in ("start", "end", "text", "before")], F.lit(yes).alias("span")))

    def most(a: Column, x: Column) -> Column:
        return F.greatest(a, x)

    def left(every: Column) -> Column:
        ends = running(F.transform(every, lambda c: F.when(c["span"], c["end"]).otherwise(0)), most)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda c: F.when(c["span"], -c["start"]).otherwise(FAR))), most, FAR))
        held = F.arrays_zip(every.alias("c"), ends.alias("reached"), starts.alias("ahead"))
        free = F.filter(held, lambda x: ~x["c"]["span"] & (x["reached"] <= x["c"]["start"]) & (-x["ahead"] >= x["c"]["end"]))
        return F.transform(free, lambda x: F.struct(*[x["c"][k].alias(k) for k in ("start", "end", "text", "before")]))

    return F.when(F.size(spans) == 0, found).otherwise(bound(F.sort_array(F.concat(marked(spans, True), marked(found, False))), left))


def located(text: Column, pattern: str, value: int = 0) -> Column:
    """Matches of a pattern as structs start, end (code points, end exclusive), text, before (the CONTEXT characters
    ahead, as far as the last match); ``value``: the group that ends the match and is wanted, 0 for all of it.

    Positions are running sums of the lengths of what lies between matches and of the matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("text"))

    def match(part: Column, end: Column) -> Column:
        ahead = F.concat(part["gap"], F.left(part["whole"], F.length(part["whole"]) - F.length(part["text"])))
        return F.struct((end - F.length(part["text"])).alias("start"), end.alias("end"), part["text"].alias("text"), F.right(ahead, F.lit(CONTEXT)).alias("before"))

    def matches(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["whole"])))
        return F.zip_with(parts, ends, match)

    return bound(parts, matches)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Arrays of located matches by base kind."""

    def found(hint: Column, pattern: str, holds) -> Column:
        return F.when(hint, F.filter(located(text, pattern), lambda m: holds(m["text"]))).otherwise(nothing())

    def card(m: Column) -> Column:
        n = F.length(digits(m))
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)

    return {
        "email": found(F.contains(text, F.lit("@")), EMAIL, lambda m: F.lit(True)),
        "ip": found(text.rlike(r"[0-9]\.[0-9]"), IP, lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": found(text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, card),
        "phone": found(F.contains(text, F.lit("+")), PHONE, lambda m: F.length(digits(m)).between(9, 15)),
    }


def candidates(text: Column, base: Column) -> Column:
    """Located candidates outside the base spans (an array of all kinds)."""
    opaque = F.when(text.rlike(OPAQUE), located(text, OPAQUE)).otherwise(nothing())
    named = F.when(text.rlike(NAMED), located(text, NAMED, 1)).otherwise(nothing())
    # each once: array_distinct compares structs pair by pair, sorted ones need only be held against the one before
    once = lambda all_: F.filter(all_, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(all_, i - 1)))
    found = bound(F.sort_array(F.concat(opaque, named)), once)
    return bound(base, lambda spans: apart(found, spans))


def sign(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def votes(c: Column) -> Column:
    """One sign for each labeler: + secret, - other, 0 abstains."""
    text, before = c["text"], c["before"]
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", ""))
    n, d = F.length(text), count("0-9")
    word = r"(?i)^[a-zà-ÿ]+[-_]?[0-9]{0,4}$"
    return F.concat(
        sign(text.rlike(KNOWN_FORMS), text.rlike(word)),  # regex: forms of keys against word-like forms
        sign(before.rlike(rf"(?i)(?:{SECRET_WORDS})[\"']?[\x20]?[=:]?[\x20]?[\"']?$"), before.rlike(rf"(?i)(?:{OTHER_WORDS})[\x20:#.=]*$")),  # gazetteer
        sign(before.rlike(r"[=:][\x20]?[\"']?$"), before.rlike(r"[.,(]\x20?$")),  # context: assigned, or a sentence's start
        sign(text.rlike("(?:[0-9]+[A-Za-z]+){3}"), text.rlike("^[A-Za-z]*[-_]?[0-9]+$") | (d == 0)),  # regex: letters and digits by turns, against a number
        sign((count("A-Z") * 2 >= n) & (d > 0) | text.rlike("^(?=[0-9]*[a-f])[0-9a-f]{12,}$"), count("_-") * 6 >= n),  # regex: one case or hexadecimal, against compounds
    )


def features(c: Column) -> Column:
    """Values of the classifier's features, each with the feature's name."""
    text, before = c["text"], c["before"]
    n = F.length(text)
    tenths = F.floor(F.length(F.regexp_replace(text, "[^0-9]", "")) * 10 / n)
    case = F.when(text.rlike("^[0-9a-f]+$"), "hex").when(text.rlike("^[0-9A-Z]+$"), "upper").when(text.rlike("^[0-9a-z]+$"), "lower").otherwise("mixed")
    ahead = F.when(before.rlike(r"=[\x20]?[\"']?$"), "=").when(before.rlike(r":[\x20]?[\"']?$"), ":").when(before.rlike(r"\s$"), "blank").when(before == "", "none").otherwise("other")
    return F.array(
        F.concat(F.lit("length "), F.least(n, F.lit(64)).cast("string")),
        F.concat(F.lit("digits "), tenths.cast("string")),
        F.concat(F.lit("case "), case),
        F.concat(F.lit("ahead "), ahead),
        F.concat(F.lit("named "), before.rlike(rf"(?i)(?:{SECRET_WORDS})").cast("string")),
    )


def reliabilities(counts: dict[str, int]) -> dict[str, float]:
    """Posterior of + by vote pattern: expectation-maximisation of a mixture of two kinds of spans, in which each labeler
    votes by itself. It begins at the majority of the votes."""
    if not counts:
        return {}
    posterior = {p: {1: 0.9, -1: 0.1, 0: 0.5}[(x > 0) - (x < 0)] for p in counts for x in [p.count("+") - p.count("-")]}
    places = range(len(next(iter(counts))))
    for _ in range(ROUNDS):
        mass = {1: 1.0, 0: 1.0}
        # a prior vote: labelers are rather right than wrong
        seen = {(i, v, y): {"+": 2.0, "0": 1.0, "-": 0.5}[v] if y else {"+": 0.5, "0": 1.0, "-": 2.0}[v] for i in places for v in "+0-" for y in (0, 1)}
        for p, n in counts.items():
            for y, share in ((1, posterior[p]), (0, 1 - posterior[p])):
                mass[y] += n * share
                for i, v in enumerate(p):
                    seen[i, v, y] += n * share
        total = {(i, y): sum(seen[i, v, y] for v in "+0-") for i in places for y in (0, 1)}
        for p in counts:
            log = {y: math.log(mass[y]) + sum(math.log(seen[i, v, y] / total[i, y]) for i, v in enumerate(p)) for y in (0, 1)}
            posterior[p] = 1 / (1 + math.exp(min(700.0, log[0] - log[1])))
    return posterior


def literal_map(values: dict[str, float]) -> Column:
    if not values:
        return F.expr("cast(map() as map<string, double>)")
    return F.create_map(*[F.lit(x) for k, v in sorted(values.items()) for x in (k, float(v))])


class Classifier:
    """Naive Bayes over :func:`features`: log odds by value and ``base``."""

    def __init__(self, base: float, weights: dict[str, float]):
        self.base, self.weights = base, weights

    def accepts(self, c: Column) -> Column:
        weights = literal_map(self.weights)
        score = F.aggregate(features(c), F.lit(self.base), lambda s, f: s + F.coalesce(weights[f], F.lit(0.0)))
        return score >= math.log(ACCEPT / (1 - ACCEPT))


def learned(found: DataFrame) -> Classifier:
    """The classifier of all candidates (column c) of a corpus."""
    by_pattern = found.groupBy(votes(F.col("c")).alias("p"), features(F.col("c")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    by_pattern = by_pattern.persist()  # a row per pattern and feature values: few hundred
    try:
        counts = {r["p"]: r["n"] for r in by_pattern.groupBy("p").agg(F.sum("n").alias("n")).collect()}
        posterior = reliabilities(counts)
        share = literal_map(posterior)[F.col("p")]
        values = by_pattern.select("n", share.alias("share"), F.explode("f").alias("f"))
        sums = values.groupBy("f").agg(F.sum(F.col("n") * F.col("share")).alias("yes"), F.sum(F.col("n") * (1 - F.col("share"))).alias("no")).collect()
    finally:
        by_pattern.unpersist()
    yes = sum(n * posterior[p] for p, n in counts.items())
    no = sum(counts.values()) - yes
    if not counts:
        return Classifier(-1.0, {})
    weights = {r["f"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in sums}
    return Classifier(math.log((yes + 1) / (no + 1)), weights)


def listed(spans: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, comma-joined; each kind's in order of start."""

    def of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))

    return F.array_join(F.concat(*[of(kind, found) for kind, found in spans]), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of each row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans'
    list), spans (base and accepted ones, of kind ``secret``, listed), n_secret.

    Null text counts as empty and has no span. Rows repeated are judged each. An empty table gives no rows. Other columns are
    not looked at. The classifier is learned from all candidates of all rows; without any, nothing is accepted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    spans = rows.select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    # a text without a digit or a sign of assignment has no candidate
    spans = spans.withColumn("all", F.when(F.col("text").rlike("[0-9=:]"), candidates(F.col("text"), F.concat(*KINDS))))
    # the texts are read once: what was found, without them, is all that learning and judging need
    places = [F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k) for k in KINDS]
    spans = written(spans.select("doc_id", *places, "all"), "spans")
    judge = learned(spans.select(F.explode("all").alias("c")))
    accepted = F.filter(F.coalesce("all", nothing()), judge.accepts)
    coded = F.transform(accepted, lambda c: F.shiftleft(c["start"].cast("long"), 32) + c["end"])
    extra = F.transform(F.sort_array(F.array_distinct(coded)), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("start"), x.bitwiseAND(0x7FFFFFFF).cast("int").alias("end")))
    base = [(k, F.col(k)) for k in KINDS]
    return spans.withColumn("secret", extra).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed([*base, ("secret", F.col("secret"))]).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
    )
