"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are found by patterns: the strict ones whose checked matches are the base and always stay, and
looser ones. Five labelers vote on each candidate (yes, no or abstain): the strict shape, the checksum or
range, a gazetteer (domains, issuers, country codes, reserved networks), cue words before it, and its
borders. Votes and shape features take few values, so one count by pattern over all documents (at most
``PATTERNS`` rows) holds all there is to learn from: expectation-maximisation estimates on it how
reliable each labeler is and how likely each pattern is personal data, and a logistic span classifier is
trained on these likelihoods. It scores every candidate as a SQL expression; candidates beyond the base
are added from ``ACCEPT`` on where they overlap no base span.

The patterns are written so that Java's matcher needs no recursion and no second start in a run: groups are
possessive, and a match may start only where a run of its characters starts (or the last match ended).

Defined results: a null text is empty; a very long text with many candidates takes time in proportion to its length
(see ``places``); offsets are code points, end exclusive; spans are in the order of
start, then kind; rows are judged one by one, so ties, repeats and extra columns change nothing; an empty
table trains on nothing and returns nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import apart, chunked, found, places_of, replaced

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
LABELERS = ("shape", "check", "gazetteer", "context", "border")
#: Bound of the table of patterns: kinds * votes of five labelers * length classes * separator classes.
PATTERNS = 4 * 3**5 * 4 * 3

#: The base patterns, equal in their matches to the defined ones; runs of more than 19 or fewer
#: than 12 digits are no card candidates, whatever separates them.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The looser patterns.
HIDDEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+)++"
NATIONAL_PHONE = r"(?<![0-9+])(?<![0-9][\x20().-])(?<!\+[0-9][\x20(])(?<!\+[0-9] \()(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
#: Gazetteers, as patterns on the matched string.
GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|io|info|de|fr|es|it|nl|uk|us|eu|ch|at)$",
    "ip": r"^(?!(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|192\.168\.|169\.254\.)",
    "card": r"^(4|5[1-5]|3[47]|6011|65|35|36|38|2[2-7])",
    "phone": r"^(\+(1|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]) ?|\(?[2-9])",
}
#: Cue words before a candidate, for and against.
CUES = {
    "email": r"(e-?mail|mail|contact|write to|address|courriel|correo)",
    "ip": r"(\bip\b|host|server|client|login|from address|adresse)",
    "card": r"(card|visa|master|amex|credit|debit|carte|karte|tarjeta|payment)",
    "phone": r"(phone|tel|call|fax|mobile|whatsapp|ruf|llame)",
}
AGAINST = r"(version|\bv\.?$|isbn|issn|order|invoice|sku|serial|\bref|\bid\b|no\.|section|token|hash)"


#: name: (kind, pattern, what a text must have for it to be tried)
SOURCES = {
    "email": ("email", EMAIL, "instr(text, '@') > 0"),
    "ip": ("ip", IP, r"has_digit and text rlike '[0-9]\\.[0-9]'"),
    "card": ("card", CARD, "has_digit"),
    "phone": ("phone", PHONE, "has_digit and instr(text, '+') > 0"),
    "hidden": ("email", HIDDEN_EMAIL, r"text rlike '[\\[(] ?at ?[\\])]'"),
    "national": ("phone", NATIONAL_PHONE, "has_digit"),
    "ipv6": ("ip", IPV6, r"has_digit and text rlike ':[0-9A-Fa-f]+:'"),
}

_DIGITS = "regexp_replace(x.s, '[^0-9]', '')"
#: Sum of the digits, every second from the right doubled (less 9 above 9), divisible by ten.
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + case when i % 2 = 1 then cast(substr(d, -i, 1) as int) "
    "when cast(substr(d, -i, 1) as int) > 4 then 2 * cast(substr(d, -i, 1) as int) - 9 else 2 * cast(substr(d, -i, 1) as int) end) % 10 = 0"
)
_OCTETS = r"forall(split(x.s, '\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
BASE = {
    "email": "true",
    "ip": _OCTETS.replace("ltrim('0', p)", "trim(LEADING '0' FROM p)"),
    "card": f"exists(array({_DIGITS}), d -> length(d) between 12 and 19 and {_LUHN})",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "hidden": "false",
    "national": "false",
    "ipv6": "false",
}


def _vote(yes: str, no: str) -> str:
    return f"case when {yes} then 1 when {no} then 2 else 0 end"


def _candidate(name: str) -> str:
    """All that is known of one candidate x of a source: base or not, five votes and two shape classes."""
    kind = SOURCES[name][0]
    strict, loose_ip = name in KINDS, name == "ipv6"
    before, after, last = "lower(x.before)", "left(x.after, 1)", "right(x.before, 1)"
    base = BASE[name]
    check = {"email": "x.s rlike '[A-Za-z]{2,}$'", "ip": "true" if loose_ip else base, "card": base if strict else "false", "phone": f"length({_DIGITS}) between 10 and 15"}[kind]
    gazetteer = "x.s rlike '[0-9A-Fa-f]'" if loose_ip else "x.s rlike '" + GAZETTEER[kind].replace("\\", "\\\\") + "'"
    cue, against = (p.replace("\\", "\\\\") for p in (CUES[kind], AGAINST))
    border = f"{last} rlike '[\\\\p{{L}}\\\\p{{N}}_]' or {after} rlike '[\\\\p{{L}}\\\\p{{N}}_]'"
    votes = {
        "shape": _vote(base if strict else "true", "true"),
        "check": _vote(check, "true"),
        "gazetteer": _vote(gazetteer, "true"),
        "context": _vote(f"{before} rlike '{cue}'", f"{before} rlike '{against}'"),
        "border": _vote(f"not ({border})", "true"),
    }
    length = "case when length(x.s) < 10 then 0 when length(x.s) < 16 then 1 when length(x.s) < 24 then 2 else 3 end"
    marks = r"case when x.s rlike '^[0-9]+$' then 0 when x.s rlike '[ ()\\[\\]]' then 1 else 2 end"
    fields = ", ".join(f"'{k}', {v}" for k, v in votes.items())
    return f"transform({name}_at, x -> named_struct('kind', '{kind}', 'rank', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'base', {base}, {fields}, 'length', {length}, 'marks', {marks}))"


def candidates(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs) and found, the array of all candidates of the text."""
    # Digits are looked for once; most texts then need no pattern at all. Each pattern runs once for the
    # matches and once for the text between them, in a projection of its own, so that neither is repeated.
    text = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    flags = text.withColumn("has_digit", F.expr("text rlike '[0-9]'"))
    wanted = flags.select("*", *[F.expr(need).alias(f"{name}_if") for name, (_, _, need) in SOURCES.items()])
    pairs = {name: found(F.col("text"), pattern, F.col(f"{name}_if")) for name, (_, pattern, _) in SOURCES.items()}
    matched = wanted.select("row", "text", *[matches.alias(f"{name}_m") for name, (matches, _) in pairs.items()])
    parted = matched.select("*", *[gaps(F.col(f"{name}_m")).alias(f"{name}_g") for name, (_, gaps) in pairs.items()])
    # One expression for all patterns: analysing it takes a second.
    each = F.transform(F.array(*[F.struct(F.col(f"{name}_m").alias("m"), F.col(f"{name}_g").alias("g")) for name in SOURCES]), lambda x: places_of(x["m"], x["g"]))
    placed = parted.select("row", "text", each.alias("each")).select("row", "text", *[F.get("each", F.lit(i)).alias(f"{name}_at") for i, name in enumerate(SOURCES)])
    return placed.select("row", "text", F.concat(*[F.expr(_candidate(name)) for name in SOURCES]).alias("found"))


FEATURES = (*LABELERS, "length", "marks")


def patterns(judged: DataFrame) -> list[dict]:
    """How often each pattern of kind, votes and shape occurs in all documents: at most PATTERNS rows. The outer form of
    explode keeps Spark from deriving a filter of all patterns, which would run them a second time."""
    rows = judged.select(F.explode_outer("found").alias("c")).groupBy("c.kind", *[f"c.{f}" for f in FEATURES]).agg(F.count("*").alias("n"))
    return [r.asDict() for r in rows.collect() if r["kind"] is not None]


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (0 abstain, 1 yes, 2 no) with counts n: the posterior of
    each pattern and the table P(vote | class) of each labeler. It starts from labelers that are mostly right."""
    k = votes.shape[1]
    table = np.tile(np.array([[[0.2, 0.2, 0.6], [0.2, 0.6, 0.2]]]), (k, 1, 1))  # labeler, class (no, yes), vote
    prior = 0.5
    q = np.full(len(votes), 0.5)
    for _ in range(rounds):
        log = np.log(table)
        no, yes = (sum(log[j, c, votes[:, j]] for j in range(k)) + np.log(p) for c, p in ((0, 1 - prior), (1, prior)))
        q = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        prior = float((n @ q + 1) / (n.sum() + 2))
        for j in range(k):
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                counts = np.bincount(votes[:, j], w, 3) + np.array([1.0, 1.0, 1.0]) + 4 * np.eye(3)[2 - c]
                table[j, c] = counts / counts.sum()
    return q, table


def classifier(x: np.ndarray, q: np.ndarray, n: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of the soft labels q by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (q - p)) - ridge * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


#: One-hot columns of the classifier: each feature at each value but 0, and 1 for the bias.
COLUMNS = [(f, v) for f in FEATURES for v in range(1, 4 if f == "length" else 3)]


def train(rows: list[dict]) -> dict[str, list[float]]:
    """Weights of the span classifier of every kind that occurs: bias, then COLUMNS."""
    out = {}
    for kind in KINDS:
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: [r[f] for f in FEATURES])
        if own:
            n = np.array([r["n"] for r in own], float)
            q, _ = reliabilities(np.array([[r[f] for f in LABELERS] for r in own]), n)
            x = np.array([[1.0] + [float(r[f] == v) for f, v in COLUMNS] for r in own])
            out[kind] = classifier(x, q, n).tolist()
    return out


def spans(docs: DataFrame, weights: dict[str, list[float]] | None = None) -> DataFrame:
    """row, text and spans: an array of (kind, rank, start, end, base) in order of start and rank."""
    judged = candidates(docs)
    if weights is None:
        weights = train(patterns(judged))

    def score(c: Column) -> Column:
        out = F.lit(-30.0)
        for kind, w in weights.items():
            terms = F.lit(w[0])
            for (f, v), weight in zip(COLUMNS, w[1:]):
                terms = terms + F.when(c[f] == v, F.lit(weight)).otherwise(F.lit(0.0))
            out = F.when(c["kind"] == kind, terms).otherwise(out)
        return out

    least = float(np.log(ACCEPT / (1 - ACCEPT)))
    base = F.filter("found", lambda c: c["base"])
    more = F.filter("found", lambda c: ~c["base"] & (score(c) >= least))
    split = judged.select("row", "text", base.alias("sure"), more.alias("more"))
    added = F.when((F.size("more") > 0) & (F.size("sure") > 0), apart(F.col("more"), F.col("sure"))).otherwise(F.col("more"))
    slim = F.transform(F.concat("sure", added), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base")))
    return split.select("row", "text", F.array_sort(slim).alias("spans"))


def written(items: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(items, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(docs: DataFrame, weights: dict[str, list[float]] | None = None) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, and n_chars counted anew where there is
    such a column. Overlapping spans are replaced together, under the kind of the first."""
    cut = spans(docs, weights).withColumn("chunks", F.when(F.size("spans") > 0, chunked(F.col("text"))))
    clean = cut.withColumn("clean", F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("chunks"), F.col("spans"))).otherwise(F.col("row.text")))
    out = []
    for name, kind in docs.dtypes:
        column = F.col("row").getField(name)
        if name == "text":
            column = F.col("clean")
        elif name == "n_chars":
            column = F.when(F.size("spans") > 0, F.length("clean").cast(kind)).otherwise(column)
        out.append(column.alias(name))
    return clean.select(*out)
