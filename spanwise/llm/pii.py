"""Personal data in whole texts: exact base patterns, and spans added by weak supervision.

Only DataFrame functions. Candidates are found with regular expressions; three labelers
(format, gazetteer, context) vote on each; expectation-maximisation over the counts of vote
patterns estimates how far each labeler can be trusted; the resulting probabilities train a
naive Bayes classifier of span features, which decides on the candidates that are not base
spans. Base spans always stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import cut

# ---- Fixed values: span kinds in order, patterns, gazetteers, context words ----
BASE = ("email", "ip", "card", "phone")
ADDED = ("contact", "localphone", "iban", "secret")
KINDS = BASE + ADDED
#: Each pattern finds the leftmost, longest matches without going back over what it has read:
#: a match starts only where no earlier start could reach the same end.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "contact": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{1,63}+)++",
    "localphone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)[ \t]{0,4}[=:][ \t]{0,4}[\"']?[A-Za-z0-9_+/=-]{8,256}",
}
#: A text without this has no match of the kind; searched for before the pattern runs.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "contact": None, "card": None, "localphone": None, "iban": None, "secret": None}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu", "us")
COUNTRY_CALLS = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
IBAN_LANDS = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
POSITIVE = "mail|contact|call|phone|tel|fax|mobile|reach|card|visa|master|payment|account|iban|bank|address|host|login|user|key|token|secret|password"
NEGATIVE = "version|release|isbn|order no|invoice|part no|serial|example|section|chapter|dummy|placeholder"
# ---- end of fixed values ----

#: Entries of a block in running sums over the spans of one text.
RUN = 256
#: After every position.
LONGEST = 2**31 - 1
BEFORE = 40
CONTEXTS = 64
SPAN = "array<struct<start:int,end:int,what:string,before:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima or minima of an array of ints, the own entry included.

    Entries are folded in blocks of RUN and the blocks' last values folded in turn, so the
    arrays that grow entry by entry stay short and the work linear.
    """

    def folded(items: Column) -> Column:
        grow = lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x))
        first = lambda part: F.slice(part, 1, 1)
        return let(items, lambda part: F.aggregate(F.slice(part, F.lit(2), F.greatest(F.size(part) - 1, F.lit(0))), first(part), grow))

    def joined(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int"))
        blocks = F.transform(starts, lambda b: folded(F.slice(values, b * RUN + 1, F.lit(RUN))))

        def carried(parts: Column) -> Column:
            ends = folded(F.transform(parts, lambda p: F.element_at(p, -1)))
            return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: combine(F.get(e, i - 1), v))))))

        return let(blocks, carried)

    return F.when(F.size(values) == 0, values).otherwise(let(values, joined))


def find(text: Column, pattern: str) -> Column:
    """Start, end (code points, end exclusive) and string of each match, and up to BEFORE characters before it.

    These reach back over at most two earlier matches; they are cut from the pieces between the
    matches, since a substring of the whole text costs its whole length each time.
    """
    none = F.array().cast(SPAN)

    def placed(m: Column) -> Column:
        def near(p: Column, i: Column) -> Column:
            far = [F.coalesce(F.get(a, i - k), F.lit("")) for k in (2, 1) for a in (p, m)]
            own = F.get(p, i)
            return F.when(F.length(own) >= BEFORE, F.right(own, F.lit(BEFORE))).otherwise(F.right(F.concat(*[F.right(x, F.lit(BEFORE)) for x in far], own), F.lit(BEFORE)))

        def walk(p: Column) -> Column:
            ends = running(F.transform(m, lambda x, i: F.length(x) + F.length(F.get(p, i))), lambda a, b: a + b)
            return let(ends, lambda e: F.transform(m, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("what"), near(p, i).alias("before"))))

        return F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(what: Column) -> Column:
    return F.translate(what, " ().+-", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    n = F.length(number)

    def part(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_test(kind: str, what: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(what, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.lit(3)) & F.forall(F.split(what, r"\."), lambda p: F.lpad(F.right(p, F.lit(3)), 3, "0") <= "255")
    if kind == "card":
        return luhn(F.translate(what, " -", ""))
    if kind == "phone":
        return F.length(digits(what)).between(9, 15)
    return F.lit(True)


def candidates(text: Column, kind: str) -> Column:
    found = F.filter(find(text, PATTERNS[kind]), lambda s: base_test(kind, s["what"]))
    need = NEEDS[kind]
    return found if need is None else F.when(F.contains(text, F.lit(need)), found).otherwise(F.array().cast(SPAN))


# ---- labelers ----------------------------------------------------------------------------


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def format_vote(kind: Column, what: Column) -> Column:
    number = F.length(digits(what))
    mixed = what.rlike("[0-9]") & what.rlike("[=:][^=:]*[A-Za-z]")
    return (
        F.when(kind.isin("email", "contact"), vote(what.rlike("[A-Za-z]{2,24}$"), F.lit(True)))
        .when(kind == "ip", vote(~what.rlike(r"^0|\.0[0-9]"), F.lit(True)))
        .when(kind == "phone", vote(number.between(10, 13), number < 10))
        .when(kind == "localphone", vote(number == 10, F.lit(True)))
        .when(kind == "secret", vote(mixed, ~what.rlike("[0-9]")))
        .otherwise(F.lit(1))
    )


def gazetteer_vote(kind: Column, what: Column) -> Column:
    listed = lambda c, names: c.isin(*names)
    code = F.greatest(*[F.when(listed(F.substring(digits(what), 1, n), COUNTRY_CALLS), 1).otherwise(0) for n in (1, 2)]) == 1
    return (
        F.when(kind.isin("email", "contact"), vote(listed(F.lower(F.regexp_extract(what, "([A-Za-z0-9-]+)$", 1)), TOP_LEVEL), F.lit(False)))
        .when(kind == "ip", vote(F.lit(False), what.rlike(r"^(10|127|0|255)\.|^192\.168\.|^169\.254\.")))
        .when(kind == "card", vote(what.rlike("^[3-6]"), F.lit(True)))
        .when(kind == "phone", vote(code, F.lit(False)))
        .when(kind == "localphone", vote(what.rlike(r"^\(?[2-9]"), F.lit(True)))
        .when(kind == "iban", vote(listed(F.substring(what, 1, 2), IBAN_LANDS), F.lit(True)))
        .otherwise(vote(F.lit(False), F.lower(what).rlike("changeme|example|xxxx|0000")))
    )


def context_vote(before: Column) -> Column:
    return vote(before.rlike(POSITIVE) & ~before.rlike(NEGATIVE), before.rlike(NEGATIVE))


RICH = "array<struct<start:int,end:int,kind:int,votes:int,shape:int,context:int>>"


def enrich(kind: str, spans: Column) -> Column:
    """Spans with their vote pattern (base 3), shape and hashed context word."""
    k = F.lit(kind)

    def rich(s: Column) -> Column:
        def with_before(before: Column) -> Column:
            pattern = (format_vote(k, s["what"]) + 1) * 9 + (gazetteer_vote(k, s["what"]) + 1) * 3 + context_vote(before) + 1
            shape = F.least(F.floor(F.length(s["what"]) / 4), F.lit(15)) * 2 + F.when(s["what"].rlike("[ .()-]"), 1).otherwise(0)
            word = F.pmod(F.xxhash64(F.regexp_extract(before, "([\\p{L}]+)[^\\p{L}]*$", 1)), F.lit(CONTEXTS))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), pattern.cast("int").alias("votes"), shape.cast("int").alias("shape"), word.cast("int").alias("context"))

        return let(F.lower(s["before"]), with_before)

    return F.transform(spans, rich)


# ---- estimation --------------------------------------------------------------------------


def votes_of(pattern: int) -> tuple[int, int, int]:
    return pattern // 9, pattern // 3 % 3, pattern % 3


def expectation_maximisation(counts: Sequence[tuple[int, int, int]], rounds: int = 30) -> dict[tuple[int, int], float]:
    """Probability that a span is personal data, for each (kind, vote pattern).

    ``counts`` has one (kind, pattern, number) for each combination seen, at most 8 x 27. Votes
    are independent given the truth; each labeler's vote distribution and each kind's rate
    are estimated with one pseudo-count.
    """
    post = {(k, p): 1 / (1 + exp(-(sum(votes_of(p)) - 3))) for k, p, _ in counts}
    for _ in range(rounds):
        rate: dict[int, list[float]] = {}
        like = [[[1.0] * 3 for _ in range(2)] for _ in range(3)]
        for k, p, n in counts:
            q = post[k, p]
            r = rate.setdefault(k, [1.0, 1.0])
            r[1] += n * q
            r[0] += n * (1 - q)
            for labeler, v in enumerate(votes_of(p)):
                like[labeler][1][v] += n * q
                like[labeler][0][v] += n * (1 - q)
        for k, p, _ in counts:
            odds = log(rate[k][1] / rate[k][0])
            for labeler, v in enumerate(votes_of(p)):
                yes, no = like[labeler][1], like[labeler][0]
                odds += log(yes[v] / sum(yes)) - log(no[v] / sum(no))
            post[k, p] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return post


@dataclass(frozen=True)
class SpanModel:
    """Log odds: of each kind, and of each feature number."""

    prior: dict[int, float]
    weight: dict[int, float]


#: Numbers of features: shapes of each kind, then context words.
SHAPES = 32


def shape_feature(kind, shape):
    return kind * SHAPES + shape


def context_feature(context):
    return len(KINDS) * SHAPES + context


def fit(spans: DataFrame) -> SpanModel:
    """Two grouped counts of the candidates; their sizes are fixed by the method (kinds, patterns, features)."""
    counts = [tuple(r) for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()]
    post = expectation_maximisation(counts)
    feature = F.explode(F.array(shape_feature(F.col("kind"), F.col("shape")), context_feature(F.col("context"))))
    rows = spans.select("kind", "votes", feature.alias("f")).groupBy("kind", "votes", "f").agg(F.count("*").alias("n")).orderBy("kind", "votes", "f").collect()
    rate: dict[int, list[float]] = {}
    total, per = [1.0, 1.0], {}
    for k, p, n in counts:
        q = post[k, p]
        r = rate.setdefault(k, [0.5, 0.5])
        r[1] += n * q
        r[0] += n * (1 - q)
        total[1] += n * q
        total[0] += n * (1 - q)
    for r in rows:
        q = post[r["kind"], r["votes"]]
        f = per.setdefault(r["f"], [1.0, 1.0])
        f[1] += r["n"] * q
        f[0] += r["n"] * (1 - q)
    return SpanModel({k: log(r[1] / r[0]) for k, r in rate.items()}, {f: log(v[1] / total[1]) - log(v[0] / total[0]) for f, v in per.items()})


def lookup(values: dict[int, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])[key], F.lit(0.0))


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "personal", limit: float = 0.0) -> DataFrame:
    """``docs`` without ``text``, with a struct column: base and all spans, each (start, kind, end), sorted.

    Kinds are numbers of KINDS; positions count code points. Added spans are candidates whose
    log odds reach ``limit`` and that overlap no base span. A null text counts as empty and has
    none; equal rows get equal spans; other columns stay as they are. Candidates are cut to
    the checkpoint folder once, without texts, and read for the two counts and the result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[enrich(k, candidates(whole, k)) for k in KINDS]).cast(RICH)
    kept = cut(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], found.alias(into)))
    model = fit(kept.select(F.explode(F.col(into)).alias("s")).select("s.*"))
    score = lambda s: lookup(model.prior, s["kind"]) + lookup(model.weight, shape_feature(s["kind"], s["shape"])) + lookup(model.weight, context_feature(s["context"]))
    slim = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    is_base = lambda s: s["kind"] < len(BASE)

    def free(every: Column) -> Column:
        """Spans in order, without those added ones that overlap a base span before or after them."""
        reach = running(F.transform(every, lambda s: F.when(is_base(s), s["end"]).otherwise(-1)), F.greatest)
        ahead = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(is_base(s), s["start"]).otherwise(LONGEST))), F.least))
        clear = lambda r, n: F.filter(every, lambda s, i: is_base(s) | ((F.get(r, i) <= s["start"]) & (F.get(n, i) >= s["end"])))
        return let(reach, lambda r: let(ahead, lambda n: clear(r, n)))

    chosen = F.array_sort(F.filter(F.col(into), lambda s: is_base(s) | (score(s) >= limit)))
    both = lambda x: F.struct(F.array_sort(F.transform(F.filter(x, is_base), slim)).alias("base"), F.array_sort(F.transform(x, slim)).alias("all"))
    return kept.withColumn(into, let(let(chosen, free), both))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))
