"""Personal data and secrets by weak supervision, with DataFrame functions alone.

Candidates are what the base patterns and wider ones find, whether they pass the base rules or not. Labelers vote on each
candidate: +1, -1 or 0 (no opinion). They go by the base rule, by gazetteers, by the words before, by shape and by how
letters and digits mix. Expectation-maximisation over how often each row of votes occurs (one count for each possible
row of votes, so a small table) estimates how reliable every labeler is and the probability of each row of votes; half of
each estimate is the labeler's reliability as it is known beforehand, which ties the two classes to their meaning. The final
classifier never sees votes: it is a logistic regression from features of the span and of what is next to it to these
probabilities, it learns from the candidates that no base rule finds, and it alone decides on them. It starts from stated
weights and all candidates together weigh as much as STRENGTH examples, whatever the input's size, so a kind that a corpus
hardly shows is decided by the stated weights and not by chance. Base spans always stay.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import Kept

#: The first four have base rules.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE_KINDS = KINDS[:4]

# A run of a pattern's first class is entered at its beginning or where the last match ended (\G), and kept whole
# (possessive): the matches are those of the plain patterns, and long runs cost one pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that lack this can't hold a match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
#: Wider forms: addresses with the signs spelt out, other separators, numbers without the country's plus, account and
#: person numbers, and long runs that mix letters and digits.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?+(?:\[at\]|\(at\))\x20?+[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\[dot\])){3}[0-9]{1,3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?:\G|(?<![0-9A-Za-z+.,:/$-]))(?:\([0-9]{2,5}+\)|[0-9]{2,5}+)(?:[\x20.-][0-9]{2,5}+){2,5}+(?![0-9A-Za-z:/])",
    "id": r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+",
}
WIDE_NEEDS = {"email": r"[\[(]at[\])]", "ip": r"[0-9][\[(]\.|[0-9]\[dot\]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[._/][0-9]{4}[._/]", "phone": r"[0-9)][\x20.-][0-9]", "id": r"[0-9]-[0-9]{2}-[0-9]|[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z][+/_-]*[0-9]|[0-9][+/_-]*[A-Za-z]"}

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP_PARTS = rf"^(?:{_PART}\.){{3}}{_PART}$"
#: Gazetteers (fixed values).
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "ch", "at", "eu", "us", "ca", "br", "jp", "cn", "ru", "in")
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "971")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)\b(?:ip|host|address|server|adresse|from)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|anrufen|appelez|llame)\W*(?:\w+\W+){0,2}$",
    "id": r"(?i)\b(?:iban|account|konto|compte|cuenta|ssn|social|passport|security)\W*(?:\w+\W+){0,2}$",
    "secret": r"(?i)(?:password|passwd|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|bearer|auth|credential)s?\W{0,4}$",
}
AGAINST = r"(?i)(?:\b(?:isbn|issn|order|invoice|version|page|figure|table|price|total|year|chapter|ref|serial|commit|sha|doi|url)s?\W*(?:no\W*)?|[$€£#]|[/\\\\.?&])$"
KEY_STARTS = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|eyJ)"
LABELERS = ("rule", "gazetteer", "context", "shape", "mix")
#: How often each labeler votes -1, 0 and 1 on what isn't personal and on what is, as known beforehand.
RELIABILITY = {
    "rule": ((0.60, 0.35, 0.05), (0.03, 0.37, 0.60)),
    "gazetteer": ((0.35, 0.50, 0.15), (0.05, 0.50, 0.45)),
    "context": ((0.35, 0.60, 0.05), (0.02, 0.58, 0.40)),
    "shape": ((0.30, 0.40, 0.30), (0.10, 0.40, 0.50)),
    "mix": ((0.30, 0.65, 0.05), (0.05, 0.65, 0.30)),
}
#: Share of the known reliability in each estimate.
ANCHOR = 0.5
#: All candidates together weigh so much against the weights that the classifier starts from.
STRENGTH = 10.0
#: Features of a candidate and how many values each has; no vote is among them.
FEATURES = {"length": 6, "digits": 5, "switches": 3, "letters": 4, "before": 4, "after": 4, "word": 3, "check": 3, "key": 2}
#: Weights that the classifier starts from: by kind (a form that is rarely anything else counts for, one that is often
#: something else against), and by the value of a feature, for all kinds or for one; all others start from 0.
KIND_START = {"email": 1.0, "ip": 1.0, "card": 0.0, "phone": -1.5, "id": -0.5, "secret": -3.0}
START = {("word", 1): 4.0, ("word", 2): -4.0, ("check", 1): 1.0, ("check", 2): -5.0, ("key", 1): 5.0}
START_OF_KIND = {("secret", "switches", 2): 1.0, ("id", "letters", 2): 1.0}


def found(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Leftmost matches that don't overlap: array of (kind, start, end, value, left, right), in code points.

    The lengths of matches and of the pieces between them, added up, are the positions.
    """
    k = F.lit(KINDS.index(kind))
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        one = F.struct(k.alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def listed(s: Column) -> Column:
        # each match with the piece before it, and with the one after; there is one piece more
        before = F.zip_with(s["m"], s["p"], lambda m, p: F.struct(m.alias("value"), F.char_length(p).alias("gap"), F.right(p, F.lit(40)).alias("left")))
        steps = F.zip_with(before, F.slice(s["p"], F.lit(2), F.size(s["m"])), lambda x, q: F.struct(x["value"].alias("value"), x["gap"].alias("gap"), x["left"].alias("left"), F.left(q, F.lit(1)).alias("right")))
        return F.aggregate(F.filter(steps, lambda x: x["value"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    # an array of one binds matches and pieces, which are worked out once
    bound = F.transform(F.array(F.struct(matches.alias("m"), pieces.alias("p"))), listed)
    return F.when(text.rlike(needs), F.get(bound, 0)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, c: Column) -> Column:
    """The base rule's check of a match."""
    digits = F.regexp_replace(c["value"], "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return c["value"].rlike(IP_PARTS)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def switches(value: Column) -> Column:
    """How often letters and digits change over."""
    return F.size(F.regexp_extract_all(value, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), F.lit(0)))


def votes(c: Column) -> list[Column]:
    """The labelers' votes on a candidate (with its field `base`), in the order of LABELERS."""
    kind, value, left = c["kind"], c["value"], c["left"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    n, size = F.char_length(digits), F.char_length(value)
    is_kind = [kind == k for k in range(len(KINDS))]
    email, ip, card, phone, number, secret = is_kind
    ends = F.regexp_extract(F.lower(value), r"([a-z0-9-]+)$", 1)
    code = r"^(?:" + "|".join(DIAL_CODES) + ")"
    known = (email & ends.isin(*TOP_DOMAINS)) | (ip & ~value.rlike(r"^(?:0|255)\.")) | (card & digits.rlike("^[3-6]")) | (phone & (F.when(value.startswith("+"), digits.rlike(code)).otherwise(digits.rlike("^0[1-9]")))) | (secret & value.rlike(KEY_STARTS))
    unknown = (email & ~ends.rlike("^[a-z]{2,}$")) | (card & digits.rlike("^[01789]")) | (phone & ~value.startswith("+") & digits.rlike("^(?:19|20)[0-9]{2}"))
    cue = any_of([is_kind[i] & left.rlike(CUES[k]) for i, k in enumerate(KINDS)])
    tidy = (email & (size <= 64)) | ip | (card & value.rlike(r"^[0-9]{4}([ ._/-]?)(?:[0-9]{4}\1){2}[0-9]{1,7}$")) | (phone & value.rlike(r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,5}\)?[ .-][0-9]{3}[ .-]?[0-9]{2,4}")) | number | (secret & value.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[A-Z0-9]{20,})$"))
    untidy = (phone & (~n.between(9, 15) | value.rlike(r"\.[0-9]{1,2}$|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4}$"))) | (secret & value.rlike(r"[A-Za-z]{7}|(?:[A-Za-z]{3,}[/_-]){2}|[0-9]{12}"))
    mixed = secret & (switches(value) >= 4)
    plain = (secret & (switches(value) <= 2)) | ((card | phone) & digits.rlike(r"^(.)\1*$"))
    # of a kind with a base rule, a match of its pattern that fails the rule counts against it
    return [vote(c["base"], F.coalesce(c["failed"], F.lit(False))), vote(known, unknown), vote(cue, left.rlike(AGAINST)), vote(tidy, untidy), vote(mixed, plain)]


def features(c: Column) -> list[Column]:
    """The values of FEATURES of a candidate, each from 0."""
    kind, value, left, right = c["kind"], c["value"], c["left"], c["right"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    n, size, turns = F.char_length(digits), F.char_length(value), switches(value)
    upper, lower = value.rlike("[A-Z]"), value.rlike("[a-z]")
    share = n / F.greatest(size, F.lit(1))

    def steps(x: Column, *ends: float) -> Column:
        return reduce(lambda a, b: a + b, [(x >= e).cast("int") for e in ends])

    cue = any_of([(kind == i) & left.rlike(CUES[k]) for i, k in enumerate(KINDS)])
    beside = lambda x: F.when(x == "", 0).when(x.rlike(r"^\s"), 1).when(x.rlike("""^[=:"'<>(\\[]"""), 2).otherwise(3)
    numeric = kind.isin(KINDS.index("card"), KINDS.index("ip"), KINDS.index("phone"))
    check = F.when(kind == KINDS.index("card"), F.when(n.between(12, 19), F.when(luhn(digits), 1).otherwise(2)).otherwise(2)).when(kind == KINDS.index("ip"), F.when(F.regexp_replace(value, r"\[\.\]|\(\.\)|\[dot\]", ".").rlike(IP_PARTS), 1).otherwise(2)).when(kind == KINDS.index("phone"), F.when(n.between(9, 15), 1).otherwise(2))
    return [
        steps(size, 8, 12, 16, 20, 40),
        steps(share, 0.001, 0.3, 0.7, 1.0),
        steps(turns, 1, 4),
        upper.cast("int") * 2 + lower.cast("int"),
        beside(F.right(left, F.lit(1))),
        beside(right),
        F.when(cue, 1).when(left.rlike(AGAINST), 2).otherwise(0),
        F.when(numeric, check).otherwise(0),
        value.rlike(KEY_STARTS).cast("int"),
    ]


def candidate(c: Column, base: bool, failed: bool = False) -> Column:
    return F.struct(*[c[f].alias(f) for f in ("kind", "start", "end", "value", "left", "right")], F.lit(base).alias("base"), F.lit(failed).alias("failed"))


def meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def passed(k: str) -> Column:
    """Base spans of a kind."""
    return F.transform(F.filter(F.col(f"_m_{k}"), lambda c: valid(k, c)), lambda c: candidate(c, True))


def refused(k: str) -> Column:
    """Matches of a base pattern that its rule refuses; of the card's pattern those with a card's number of digits."""

    def counts(c: Column) -> Column:
        return F.char_length(F.regexp_replace(c["value"], "[^0-9]", "")).between(12, 19) if k == "card" else F.lit(True)

    return F.transform(F.filter(F.col(f"_m_{k}"), lambda c: ~valid(k, c) & counts(c)), lambda c: candidate(c, False, True))


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with _every (base spans) and _wide (all other candidates; no base span touches them)."""
    x = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    one = docs.select("*", *[found(x, k, BASE[k], NEEDS[k]).alias(f"_m_{k}") for k in BASE_KINDS], *[found(x, k, WIDE[k], WIDE_NEEDS[k]).alias(f"_w_{k}") for k in WIDE])
    every = F.concat(*[passed(k) for k in BASE_KINDS])
    failed = [refused(k) for k in BASE_KINDS]
    wide = [F.transform(f"_w_{k}", lambda c: candidate(c, False)) for k in WIDE]
    free = F.filter(F.concat(*failed, *wide), lambda w: ~F.exists(F.col("_every"), lambda b: meet(w, b)))
    one = one.select(*[F.col(f"`{c}`") for c in docs.columns], every.alias("_every"), *[F.col(f"_m_{k}") for k in BASE_KINDS], *[F.col(f"_w_{k}") for k in WIDE])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns], "_every", free.alias("_wide"))


def candidates(docs: DataFrame, kept: Kept, text: str = "text") -> DataFrame:
    """Votes and features of every candidate of all whole texts, one row for each that occurs with its count; kept as a table."""
    return kept.keep(tally(with_candidates(docs.select(F.col(f"`{text}`").alias("text")), "text")), "candidates")


def tally(one: DataFrame) -> DataFrame:
    """How often each row of votes and features occurs among the candidates of `with_candidates`, base spans marked.

    There are at most as many rows as combinations of votes and features, whatever the input.
    """
    c = F.col("c")
    names = [*LABELERS, *FEATURES]
    rows = one.select(F.explode(F.concat("_every", "_wide")).alias("c")).select(c["kind"].alias("kind"), c["base"].alias("base"), *[v.alias(n) for v, n in zip([*votes(c), *features(c)], names, strict=True)])
    return rows.groupBy("kind", "base", *names).agg(F.count("*").alias("n"))


def fit_votes(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[list[list[float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation for two classes: (prior, P(vote | class) by labeler and class, posterior of each row (kind, votes)).

    Each P(vote | class) is ANCHOR parts RELIABILITY and the rest what the rows show; so is the prior, known as a half.
    """
    rows = [(key, n, key[1:]) for key, n in counts]
    total = sum(n for _, n, _ in rows) or 1
    known = [RELIABILITY[name] for name in LABELERS]
    like = [[list(k[0]), list(k[1])] for k in known]
    prior, post = 0.5, {}
    for _ in range(rounds):
        for key, _, v in rows:
            logs = [math.log(p) + sum(math.log(like[j][c][x + 1]) for j, x in enumerate(v)) for c, p in ((0, 1 - prior), (1, prior))]
            post[key] = 1 / (1 + math.exp(max(-500.0, min(500.0, logs[0] - logs[1]))))
        prior = ANCHOR * 0.5 + (1 - ANCHOR) * sum(n * post[key] for key, n, _ in rows) / total
        for j in range(len(LABELERS)):
            for c in (0, 1):
                seen = [0.0, 0.0, 0.0]
                for key, n, v in rows:
                    seen[v[j] + 1] += n * (post[key] if c else 1 - post[key])
                mass = sum(seen)
                like[j][c] = [ANCHOR * k + (1 - ANCHOR) * x / mass for k, x in zip(known[j][c], seen, strict=True)] if mass > 0 else list(known[j][c])
    return prior, like, post


#: Where each feature's values begin among the inputs, after a constant for each kind.
_OFFSET = dict(zip(FEATURES, np.cumsum([len(KINDS), *FEATURES.values()]).tolist(), strict=False))
_OWN = sum(FEATURES.values()) + len(KINDS)


def active(rows: np.ndarray) -> np.ndarray:
    """Indexes of the inputs that are 1 for rows (kind, features): the kind's constant and each feature's value; then those of one kind."""
    of_kind = [np.where((rows[:, 0] == KINDS.index(k)) & (rows[:, 1 + list(FEATURES).index(f)] == v), _OWN + i, -1) for i, (k, f, v) in enumerate(START_OF_KIND)]
    return np.stack([rows[:, 0], *[rows[:, 1 + j] + _OFFSET[f] for j, f in enumerate(FEATURES)], *of_kind], 1)


Weights = tuple[list[float], list[list[float]]]


def fit(found: DataFrame, rounds: int = 30, ridge: float = 1.0) -> Weights:
    """The span classifier from the table of candidates: a weight for each kind, and one for each (kind, value) of each feature.

    Counts weigh by their share of all candidates, so a multiple of a table gives the same weights. Without candidates all
    weights are 0 and nothing is accepted; without any that no base rule finds, they are those it starts from.
    """
    keys = ("kind", *LABELERS)
    counts = [(tuple(r[k] for k in keys), r["n"]) for r in found.groupBy(*keys).agg(F.sum("n").alias("n")).collect()]  # at most 6 * 3^5 rows
    if not counts:
        return [0.0] * len(KINDS), [[0.0] * (len(KINDS) * size) for size in FEATURES.values()]
    _, _, post = fit_votes(sorted(counts))
    spark = found.sparkSession
    believed = spark.createDataFrame([(*k, p) for k, p in sorted(post.items())], ", ".join(f"{k} int" for k in keys) + ", p double")
    shape = ("kind", *FEATURES)
    # a row for each combination of features that occurs: their number has a bound of its own
    table = found.where("not base").join(F.broadcast(believed), list(keys)).groupBy(*shape).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("mass")).orderBy(*shape).collect()
    start = np.array([KIND_START[k] for k in KINDS] + [START.get((f, v), 0.0) for f, size in FEATURES.items() for v in range(size)] + list(START_OF_KIND.values()))
    w = start.copy()
    at = active(np.array([[r[k] for k in shape] for r in table], np.int64).reshape(-1, len(shape)))
    on, at = at >= 0, np.maximum(at, 0)
    n, mass = np.array([r["n"] for r in table], float), np.array([r["mass"] for r in table], float)
    n, mass = (v * (STRENGTH / max(1.0, n.sum())) for v in (n, mass))
    for _ in range(rounds if len(table) else 0):  # Newton's method over index sums
        p = 1 / (1 + np.exp(-np.clip((w[at] * on).sum(1), -30, 30)))
        g, h = ridge * (w - start), ridge * np.eye(len(w))
        np.add.at(g, at, (n * p - mass)[:, None] * on)
        for j in range(at.shape[1]):
            for k in range(at.shape[1]):
                np.add.at(h, (at[:, j], at[:, k]), n * p * (1 - p) * on[:, j] * on[:, k])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    each = []
    for f, size in FEATURES.items():
        values = np.tile(w[_OFFSET[f] : _OFFSET[f] + size], (len(KINDS), 1))
        for i, (kind, name, v) in enumerate(START_OF_KIND):
            if name == f:
                values[KINDS.index(kind), v] += w[_OWN + i]
        each.append(values.ravel().tolist())
    return w[: len(KINDS)].tolist(), each


def score(c: Column, weights: Weights) -> Column:
    """The classifier's log odds of a candidate."""
    first, each = weights
    z = F.get(F.array(*[F.lit(float(w)) for w in first]), c["kind"])
    for w, value, size in zip(each, features(c), FEATURES.values(), strict=True):
        z = z + F.get(F.array(*[F.lit(float(v)) for v in w]), c["kind"] * size + value)
    return z


_OURS = {"base", "spans", "_every", "_wide", *[f"_m_{k}" for k in KINDS], *[f"_w_{k}" for k in KINDS]}


def searched(docs: DataFrame, kept: Kept, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with all candidates of their texts, written once: the classifier learns from them and decides on them.

    Columns named base, spans, _every, _wide, _m_* and _w_* are replaced; the text stays unless it is dropped.
    """
    found = with_candidates(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _OURS]), text)
    return kept.keep(found.drop(text) if drop_text else found, "searched", "zstd")


def find_spans(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """docs with base (array of (start, kind, end) of each base span) and spans (those and what the method adds), in order.

    Null texts are empty and have none. Of added spans that overlap, the one that begins first stays, of these the longest,
    of these the likeliest. Columns named base, spans, _every, _wide, _m_* and _w_* are replaced, others stay.
    Row by row: no shuffle, whole texts, repeated rows alike; an empty table gives an empty one.
    """
    return decided(with_candidates(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in _OURS]), text), weights)


def decided(found: DataFrame, weights: Weights) -> DataFrame:
    """base and spans, as in find_spans, from the candidates."""
    keep = [c for c in found.columns if c not in ("_every", "_wide")]

    def place(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))

    scored = F.transform("_wide", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), (-score(c, weights)).alias("less"), c["kind"].alias("kind"), c["end"].alias("end")))
    more = F.array_sort(F.filter(scored, lambda c: c["less"] < 0))
    apart = F.aggregate(more, F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,kind:int,end:int>>))"), lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(place(s))).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    base = F.array_sort(F.transform("_every", place))
    return found.select(*[F.col(f"`{c}`") for c in keep], base.alias("base"), F.array_sort(F.concat(F.transform("_every", place), apart)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <kind>; of spans that overlap, the first, and the longest that starts there."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def add(acc: Column, s: Column) -> Column:
        step = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])).alias("out"), s["end"].alias("at"))
        # a span inside what is already replaced only moves the end
        over = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], step).otherwise(over)

    done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1) - acc["at"] - 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = searched(docs, Kept(spark, "pii"), drop_text=True)
    out = decided(found, fit(tally(found)))
    n = [count_of(F.col("base"), name).alias(f"n_{name}") for name in BASE_KINDS]
    return out.select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
