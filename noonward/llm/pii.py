"""Personal data: candidate spans judged by boosted trees, on DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; these spans always stay.
Wider patterns propose further, overlapping candidates: addresses with written-out signs, numbers with other
separators, numbers without a country code, and runs of letters and digits that may be keys or tokens. What fails a
check of its kind (octets, check digit, number of digits) is out. Gradient-boosted trees, fitted on all
labelled candidates, score the rest by format and context.

Numbers and addresses are right on a base span of their kind and wrong if they fail a check or lie on a base span of
another kind; the features leave out the signs that the base patterns hang on, so that the trees carry over to other
spellings. Keys and tokens are right where an assignment to such a name stands before them, wrong inside a URL, path
or address; their features are those of format alone, so that the trees carry over to other places. All others have no
label, and count neither as right nor as wrong. Per kind, a threshold is set on held-out candidates at which nearly
all are right; a kind with too few examples gets none and adds nothing. The trees run as SQL expressions.

All patterns are possessive or bounded, so that long runs of one character are read in linear time.
"""

from dataclasses import dataclass, field
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonward.llm.common import unused, without
from noonward.session import store

#: In the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+"
    r"(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+"
    r"(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?[.,:_]\x20?[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}+[0-9]){12,18}+(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,256}+(?![A-Za-z0-9_+/-])",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[\x20()./-]{1,2}+[0-9]{2,5}+){1,5}+(?![0-9])",
}
#: A text without this holds no match, so that the longer patterns can be left out.
HINT = {"email": "@|[(\\[ ]at[)\\] ]", "ip": "[0-9][.,:_ ]", "card": "[0-9]", "phone": "[0-9]", "secret": "[A-Za-z0-9_+/-]{16}"}
SPAN = "array<struct<kind:string,start:int,end:int,match:string>>"
CONTEXT = {
    "email": "(?i)e-?mail|contact|write|courriel|correo",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "(?i)phone|tel|call|mobile|fax|whatsapp",
}
#: What stands before a key or token that is assigned to a name, and around one that is a part of something else.
ASSIGNED = r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|bearer|auth|credentials?)[A-Za-z0-9_-]{0,16}[\"']?\s{0,3}[=:]\s{0,3}[\"']?$"
INSIDE_BEFORE, INSIDE_AFTER = r"[/@.?&#%]$", r"^[/@.%]"
#: Numbers that are dates, with dots as separators.
DATE = r"^(?:(?:19|20)[0-9]{2}\.[01]?[0-9]\.[0-3]?[0-9]|[0-3]?[0-9]\.[0-3]?[0-9]\.(?:19|20)[0-9]{2})$"
#: Characters before and after a span that make up its context.
AROUND = 32


def _found(text: Column, kind: str, pattern: str) -> Column:
    """All matches, leftmost and without overlap, with their places in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

    def step(a, p):
        low = a.at + F.length(p.g)
        high = low + F.length(p.m)
        span = F.struct(F.lit(kind).alias("kind"), low.alias("start"), high.alias("end"), p.m.alias("match"))
        return F.struct(high.alias("at"), F.array_append(a.out, span).alias("out"))

    found = F.aggregate(pairs, zero, step, lambda a: a.out)
    return F.when(text.rlike(HINT[kind]), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; for up to 19 digits, else false."""
    size = F.length(digits)
    each = F.when(size.between(2, 19), F.sequence(F.lit(1), size))

    def add(total, i):
        d = F.substr(digits, size - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.coalesce(F.aggregate(each, F.lit(0), add) % 10 == 0, F.lit(False))


def _octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.regexp_replace(match, r"[^0-9]+", ".").rlike(rf"^{part}(?:\.{part}){{3}}$")


def _base_holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the base patterns that pass their checks, by kind and start."""

    def of(kind):
        return F.filter(_found(text, kind, BASE[kind]), lambda s: _base_holds(kind, s.match))

    return F.concat(*[of(k) for k in BASE_KINDS])


def of_kind(spans, kind: str) -> Column:
    return F.filter(spans, lambda s: s.kind == kind)


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _with_context(text: Column, s: Column) -> Column:
    """A candidate with what its features are taken from, worked out once."""
    low = F.greatest(s.start - AROUND, F.lit(0))
    # written-out signs become dots, as do the separators of numbers, so that spellings of one address or number look alike
    numbers = F.regexp_replace(F.regexp_replace(s.match, r"^\+", ""), r"[\x20.,:_/-]+", ".")
    written = r"\x20?[\[(]\x20?(?:at|dot)\x20?[\])]\x20?|\x20(?:at|dot)\x20|@"
    return F.struct(
        s.kind.alias("kind"),
        s.start.alias("start"),
        s.end.alias("end"),
        s.match.alias("match"),
        F.substr(text, low + 1, s.start - low).alias("before"),
        F.substr(text, s.end + 1, F.lit(AROUND)).alias("after"),
        _digits(s.match).alias("digits"),
        F.when(s.kind == "email", F.regexp_replace(s.match, written, "."))
        .when(s.kind == "secret", s.match)
        .otherwise(numbers)
        .alias("plain"),
    )


def _features(s: Column) -> dict[str, Column]:
    """Format and context of a candidate, as doubles; of keys and tokens, whose label is their context, format alone."""
    m, digits, plain, before, after = s.match, s.digits, s.plain, s.before, s.after
    last = F.regexp_extract(plain, r"([A-Za-z0-9-]*)$", 1)
    secret = s.kind == "secret"
    share = lambda kept: F.when(secret, F.length(F.regexp_replace(m, f"[^{kept}]+", "")) / F.length(m)).otherwise(0.0)
    other = lambda c: F.when(secret, F.lit(0.0)).otherwise(c)
    made = {f"is_{k}": _yes(s.kind == k) for k in KINDS}
    made |= {
        "size": other(F.length(plain)),
        "digits": other(F.length(digits)),
        "groups": F.size(F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")),
        "letters": other(F.length(F.regexp_replace(plain, "[^A-Za-z]+", ""))),
        "parts": F.size(F.split(plain, r"\.")),
        "last_part": other(F.length(last)),
        "last_lower": _yes(last.rlike("^[a-z]{2,6}$")),
        "brackets": _yes(plain.rlike(r"[()]")),
        "luhn": _yes(_luhn(digits)),
        "octets": _yes(_octets(m)),
        "listed": _yes(m.rlike(r",\x20")),
        "date": _yes(plain.rlike(DATE)),
        "mixing": F.when(secret, F.size(F.split(m, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")) / F.length(m)).otherwise(0.0),
        "digit_share": share("0-9"),
        "upper_share": share("A-Z"),
        "hex_share": share("0-9A-Fa-f"),
        "digit_before": other(_yes(before.rlike(r"[0-9][.,:/\x20-]?$"))),
        "digit_after": other(_yes(after.rlike(r"^[.,:/\x20-]?[0-9]"))),
        "letter_before": other(_yes(before.rlike(r"\p{L}$"))),
        "letter_after": other(_yes(after.rlike(r"^\p{L}"))),
        "digits_around": other(F.length(_digits(before)) + F.length(_digits(after))),
    }
    made |= {f"says_{k}": other(_yes(before.rlike(CONTEXT[k]))) for k in BASE_KINDS}
    return {name: value.cast("double") for name, value in made.items()}


FEATURES = (
    *[f"is_{k}" for k in KINDS],
    *"size digits groups letters parts last_part last_lower brackets luhn octets listed date".split(),
    *"mixing digit_share upper_share hex_share".split(),
    *"digit_before digit_after letter_before letter_after digits_around".split(),
    *[f"says_{k}" for k in BASE_KINDS],
)


def _fails(s: Column) -> Column:
    """Whether a candidate off the base spans cannot be of its kind: last part of an address, octets, digits, check
    digit; for keys and tokens, whether they are a part of a URL, path or address."""
    n = F.length(s.digits)
    return (
        F.when(s.kind == "email", ~F.regexp_extract(s.plain, r"([A-Za-z0-9-]*)$", 1).rlike("^[a-z]{2,24}$"))
        .when(s.kind == "ip", ~_octets(s.match) | s.match.rlike(r",\x20"))
        .when(s.kind == "card", ~n.between(13, 19) | ~_luhn(s.digits))
        .when(s.kind == "secret", s.before.rlike(INSIDE_BEFORE) | s.after.rlike(INSIDE_AFTER))
        .otherwise(~n.between(8, 15) | s.plain.rlike(DATE))
    )


def _overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with base (spans) and candidates (spans with features, on_base and label) of each whole text.

    The label is 1 on a base span of the kind, or after an assignment, 0 where the candidate cannot be right, and
    else missing.
    """
    rest = without(docs, "base", "candidates")
    held = unused(rest, "_text")
    rest, whole = rest.withColumn(held, F.coalesce(F.col(text), F.lit(""))), F.col(held)
    wide = F.concat(*[_found(whole, k, WIDE[k]) for k in KINDS])
    found = rest.withColumns({"base": base_spans(whole), "candidates": wide})

    def told(s):
        values = [v.alias(n) for n, v in _features(s).items()]
        on_base = F.exists("base", lambda b: (b.kind == s.kind) & _overlap(b, s))
        wrong = F.exists("base", lambda b: (b.kind != s.kind) & _overlap(b, s)) | _fails(s)
        assigned = (s.kind == "secret") & s.before.rlike(ASSIGNED)
        label = F.when(on_base, 1.0).when(wrong, 0.0).when(assigned, 1.0).alias("label")
        return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), on_base.alias("on_base"), label, *values)

    in_context = F.transform("candidates", lambda s: _with_context(whole, s))
    return found.withColumn("candidates", F.transform(in_context, told)).drop(held)


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or leaf values, with weights; a threshold per kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    least: dict[str, float] = field(default_factory=dict)


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _value(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, at, low, high = tree
    return F.when(c.getField(name) <= at, _value(low, c)).otherwise(_value(high, c))


def probability(model: Model, c: Column) -> Column:
    margin = F.lit(0.0)
    for tree, weight in zip(model.trees, model.weights):
        margin += _value(tree, c) * weight
    return 1 / (1 + F.exp(-2 * margin))


def fit(detected: DataFrame, rounds: int = 10, depth: int = 3, precision: float = 0.99) -> Model:
    """Trees and thresholds from all labelled candidates of all documents.

    Each kind weighs as much as the largest, so that a rare one is learned as well. A quarter, by a hash of place and features, is held out for the thresholds: per
    kind the least of 100 levels from which on `precision` of the held-out candidates are right, with 20 right ones at
    least. Where none of them is wrong, it is the level that 95 % of the right ones reach. Without candidates of both
    sorts there is no model.
    """
    each = detected.select(F.explode("candidates").alias("c")).select("c.*").filter("label is not null")
    held_out = F.pmod(F.xxhash64("kind", "start", "end", *FEATURES), F.lit(4)) == 0
    rows = store(each.select("kind", "label", *FEATURES, held_out.alias("held_out")))
    training = rows.filter("not held_out")
    sizes = training.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    if len({r["label"] for r in sizes}) < 2:
        return Model()
    of_kind = {k: sum(r["n"] for r in sizes if r["kind"] == k) for k in KINDS}
    most = max(of_kind.values())
    share = F.create_map(*[F.lit(v) for k, n in of_kind.items() if n for v in (k, most / n)])
    weighed = training.withColumn("weight", share[F.col("kind")])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(weighed)
    # MLlib looks for split points in as many rows as the square of the bins: so many bins that this is all of them
    bins = max(32, isqrt(sum(r["n"] for r in sizes)) + 1)
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, minInstancesPerNode=10, maxBins=bins, weightCol="weight", seed=1)
    trained = gbt.fit(vectors)
    trees = tuple(_tree(t._call_java("rootNode")) for t in trained.trees)
    model = Model(trees, tuple(trained.treeWeights))
    scored = rows.filter("held_out").select("kind", "label", probability(model, F.struct(*FEATURES)).alias("p"))
    levels = scored.groupBy("kind", F.floor(F.col("p") * 100).alias("level"))
    counts = levels.agg(F.sum("label").alias("right"), F.count("*").alias("all")).collect()  # 101 levels per kind
    least = {}
    for kind in KINDS:
        own = sorted(((r["level"], r["right"], r["all"]) for r in counts if r["kind"] == kind), reverse=True)
        right = total = 0
        for level, good, n in own:
            right, total = right + good, total + n
            if right >= 20 and right >= precision * total:
                least[kind] = max(0.5, level / 100)
        if own and right == total >= 20:  # nothing to be wrong about: do not go below what the right ones score
            reached = 0
            for level, good, _ in own:
                reached += good
                if reached >= 0.95 * right:
                    least[kind] = max(0.5, level / 100)
                    break
    return Model(model.trees, model.weights, least)


def _chosen(model: Model) -> Column:
    """Candidates above their threshold that fail no check and touch no base span; of overlapping ones the more probable."""
    if not model.least:
        return F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    free = F.filter("candidates", lambda c: ~c.label.eqNullSafe(F.lit(0.0)) & ~F.exists("base", lambda b: _overlap(b, c)))
    scored = F.transform(
        free,
        lambda c: F.struct((-probability(model, c)).alias("p"), c.start.alias("start"), c.end.alias("end"), c.kind.alias("kind")),
    )
    least = F.create_map(*[F.lit(v) for k, t in model.least.items() for v in (k, t)])
    enough = F.filter(scored, lambda s: F.coalesce(-s.p >= F.element_at(least, s.kind), F.lit(False)))
    zero = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    plain = lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))
    add = lambda out, s: F.when(F.exists(out, lambda o: _overlap(o, s)), out).otherwise(F.array_append(out, plain(s)))
    return F.aggregate(F.sort_array(enough), zero, add)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by kind as in KINDS, then start, joined by commas."""
    number = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s.kind)
    keyed = F.transform(spans, lambda s: F.struct(number(s).alias("n"), s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def find_spans(detected: DataFrame, **options) -> DataFrame:
    """Detected documents with spans: the base spans and those that the trees add.

    A missing or empty text has no spans; rows stay as they are, repeated ones too. Columns base, candidates and
    spans are replaced. `options` are those of `fit`. The detected rows are written to the shared folder once, since they are read twice; drop
    texts that are not needed before.
    """
    kept = store(without(detected, "spans"))
    model = fit(kept, **options)
    plain = F.transform("base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    return kept.withColumn("spans", F.concat(plain, _chosen(model))).drop("candidates")


def redacted(text, spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, lengthened."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    text = F.col(text)

    def step(a, s):
        gap = F.substr(text, a.at + 1, F.greatest(s.start - a.at, F.lit(0)))
        mark = F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        added = F.concat(a.out, F.array(gap, mark))
        return F.struct(F.greatest(a.at, s.end).alias("at"), F.when(s.start < a.at, a.out).otherwise(added).alias("out"))

    end = lambda a: F.concat(F.array_join(a.out, ""), F.substr(text, a.at + 1))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, zero, step, end)).otherwise(text)
