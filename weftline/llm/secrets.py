"""Secret scans with a random forest against false positives, in DataFrame and SQL functions only.

Candidates are runs of at least ``LEAST`` characters of which one is a digit, as keys and tokens have, and, where a text has such
a cue, whatever is assigned to a name like password or secret or said to be one, the password in a URL, signed tokens as a whole, and
heads of private keys. Paths, hashes,
identifiers and numbers are candidates too. What tells them apart is learnt: a random forest on the
length, the shares of each change of character class, the share covered by dictionary words and by common pairs of letters, the
place in a path, and the words before and after, trained by Spark ML on labelled findings and written out as nested CASE
expressions, so that scoring is an expression over the array of candidates of a row, without a shuffle.

The tables have no labelled findings, so ``labelled_findings`` makes a fixed set of ``LABELLED`` rows: values from
hashes of a row number, of many kinds, each in a carrier (code, shell, prose, headers) drawn apart from its kind; ``fit``
takes any other set with the same columns. ``unseen`` kinds are never trained on and measure what is learnt.

Defined results: a null text is empty; offsets are code points, end exclusive; rows are judged one by one, so
ties, repeats and extra columns change nothing; a very long text with many candidates takes time in proportion to its
length (see ``places``); an empty table gives no rows; without both labels in the findings nothing is removed. A run
without a digit and without a cue is no candidate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .places import PLACE, apart, found, places_of

LEAST, LABELLED, TREES, DEPTH, ACCEPT = 16, 6000, 24, 8, 0.5
#: Tasks that make the findings.
PARTS = 8
#: Fixed value: the shape of a candidate. A run starts where no character of a run is before it, and is matched
#: without giving back, so each run is looked at once.
CANDIDATE = rf"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{{{LEAST},}}+"
#: What is assigned to a name that says secret, the password of a URL, the head of a private key; and what
#: a text must have for each to be tried.
ASSIGNED = r"(?i)(?<=(?:password|passwd|passphrase|pwd|secret|token|api[_-]key|apikey|access[_-]key)[\"']{0,1}[\x20]{0,1}[:=]{1,2}[\x20]{0,1}[\"']{0,1})[^\s\"'`,;:=<>(){}\[\]][^\s\"'`,;<>(){}\[\]]{5,}+"
IN_URL = r"(?<=://[A-Za-z0-9._-]{1,40}:)[^\s:/@]{4,}+(?=@)"
PRIVATE = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: A signed token of two or three parts, which is one finding; what is said to be a password, if it has a digit or a sign.
SIGNED = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+){1,2}+"
SPOKEN = r"(?i)(?<=(?:password|passphrase|passcode|pwd)[\x20](?:is|was)[\x20][\"']{0,1})(?=[^\s\"']*[0-9!#$%&*@^~])[^\s\"'`,;<>(){}\[\]]{6,}+"
CUED = r"(?i)(password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]key)[\"']?\x20?[:=]"
#: Frequent pairs of letters of English words, what stands for a value in examples.
PAIRS = "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur".split()
PLACEHOLDERS = r"(example|sample|dummy|changeme|change_me|your|placeholder|xxxx|0000|1234|redacted|\*\*\*|\$\{|required|optional|string|none|null|true|false)"
#: Dictionary words that names, paths and examples are made of.
DICTIONARY = (
    "account admin agent alpha android apple application array asset auth backup base batch beta block board bucket build bundle byte cache case center chart check class client cloud code column comment "
    "common compile component config connect console content context control core count create current data database date debug default demo deploy detail device dist docs document domain download driver "
    "element email engine entry error event example export factory field file filter folder font form format frame function global graph group guide handler hash header helper home host html http icon image "
    "import index info input install instance item java job json label layer layout level library license line link linux list load local locale lock logger login mail main manager map master media member memory "
    "menu message meta method model module monitor mount name native network node note number object offset option order output package page panel param parent parse part patch path pattern phone picture pipeline "
    "plugin point policy pool port post print process product profile program project property proxy public python query queue random range read record region release remote report request resource response "
    "result role root route row rule sample save schema scope screen script search section security select sender serial server service session setting shape share shell simple size slot sort source space "
    "stage start state static status step storage store stream string style submit suite summary support switch symbol sync system table target task team template test text theme thread time title tool "
    "topic total trace track train transport tree trigger type unit update upload user util value vector vendor version video view volume watch web widget window worker write zone"
).split()
SECRET_CUES = r"(token|secret|passw|pwd|api[_ -]?key|apikey|access[_ -]?key|private|auth|bearer|credential)"
OTHER_CUES = r"(commit|sha-?[0-9]|md5|checksum|digest|uuid|guid|order|invoice|isbn|version|revision|etag|card|phone|build|serial)"

#: Fixed value: how keys begin that say who has issued them, in letters and a mark.
ISSUED = r"^([A-Za-z]{2,8}_(live|test|prod|pat|v[0-9])_|(gh[a-z]|glpat|xox[a-z]|npm|pypi|rk|sk|pk|hf|shp[a-z]{2}|dop|sq0[a-z]{3})[_-]|AKIA|ASIA|AIza|eyJ|ya29)"

FEATURES = (
    "length", "lower_upper", "upper_lower", "letter_digit", "digit_letter", "symbols", "pairs", "dictionary", "digits", "distinct", "path", "secret_near", "other_near",
    "quoted", "hexadecimal", "dashed", "placeholder", "assigned", "closed", "data_after", "issued", "humps", "said",
)


def _features() -> str:
    def text(pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    before, last, after = "lower(x.before)", "right(x.before, 1)", "lower(x.after)"
    words = "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    yes = "cast({} as int)".format
    share = lambda pattern: f"regexp_count(x.s, {text(pattern)}) / length(x.s)"
    fields = {
        "length": "least(length(x.s), 200)",
        "lower_upper": share("(?<=[a-z])(?=[A-Z])"), "upper_lower": share("(?<=[A-Z])(?=[a-z])"), "letter_digit": share("(?<=[A-Za-z])(?=[0-9])"), "digit_letter": share("(?<=[0-9])(?=[A-Za-z])"),
        "symbols": share("[^A-Za-z0-9]"),
        "pairs": f"regexp_count(lower(x.s), {text('(?=(' + '|'.join(PAIRS) + '))')}) / length(x.s)",
        "dictionary": f"1 - length(regexp_replace(lower(x.s), {text(words)}, '')) / length(x.s)",
        "digits": "1 - length(regexp_replace(x.s, '[0-9]', '')) / length(x.s)",
        "distinct": "size(array_distinct(split(x.s, ''))) / least(length(x.s), 40)",
        "path": f"{yes('instr(x.s, \"/\") > 0')} + {yes(f'({last}) in (\".\", \"/\", \"~\")')} + {yes('left(x.after, 1) = \".\"')}",
        "secret_near": yes(f"{before} rlike {text(SECRET_CUES)}"),
        "other_near": f"{yes(f'{before} rlike {text(OTHER_CUES)}')} + {yes(f'{after} rlike {text(OTHER_CUES)}')}",
        "quoted": yes(f"({last}) in ('\"', '=', ':') or {before} rlike {text('[=:] ?$')}"),
        "hexadecimal": yes("x.s rlike '^[0-9a-f]+$'"),
        "dashed": yes("x.s rlike '^[0-9A-Fa-f]+(-[0-9A-Fa-f]+)+$'"),
        "placeholder": yes(f"lower(x.s) rlike {text(PLACEHOLDERS)}"),
        "assigned": yes(f"{before} rlike {text('(token|secret|passw|pwd|passphrase|key|credential|bearer)[a-z_]*[^a-z0-9]{0,4}$')}"),
        "closed": yes(f"left(x.after, 1) in ('\"', {text(chr(39))})"),
        "data_after": yes(f"{before} rlike {text('(base64,|sha[0-9]+[:-]|integrity=.?)$')} or x.s rlike '^sha[0-9]{{3}}-'"),
        "issued": yes(f"x.s rlike {text(ISSUED)}"),
        "humps": "regexp_count(x.s, '[A-Z]?[a-z]{2,}') * 4 / length(x.s)",
        "said": yes(f"{before} rlike {text('(password|passphrase|passcode|pwd) (is|was) .?$')}"),
    }
    return ", ".join(f"'{k}', cast({v} as double)" for k, v in fields.items())


#: name: (pattern, what a text must have for it to be tried)
SOURCES = {"set": (ASSIGNED, "text rlike '" + CUED.replace("\\", "\\\\").replace("'", "\\'") + "'"), "url": (IN_URL, "instr(text, '://') > 0"), "pem": (PRIVATE, "instr(text, '-----BEGIN') > 0"), "signed": (SIGNED, "instr(text, 'eyJ') > 0"), "spoken": (SPOKEN, "text rlike '(?i)(password|passphrase|passcode|pwd) (is|was) '"), "run": (CANDIDATE, r"text rlike '[0-9]'")}


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of all columns of docs), text and found: an array of (start, end, FEATURES), in order. A candidate of a
    later source that overlaps one before is left out."""
    whole = docs.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    wanted = whole.select("*", *[F.expr(need).alias(f"{name}_if") for name, (_, need) in SOURCES.items()])
    pairs = {name: found(F.col("text"), pattern, F.col(f"{name}_if")) for name, (pattern, _) in SOURCES.items()}
    matched = wanted.select("row", "text", *[matches.alias(f"{name}_m") for name, (matches, _) in pairs.items()])
    parted = matched.select("row", "text", F.array(*[F.struct(F.col(f"{name}_m").alias("m"), gaps(F.col(f"{name}_m")).alias("g")) for name, (_, gaps) in pairs.items()]).alias("each"))
    placed = parted.select("row", "text", F.transform("each", lambda x: places_of(x["m"], x["g"])).alias("each"))
    free = F.array().cast(f"array<{PLACE}>")
    both = F.aggregate("each", free, lambda done, more: F.when(F.size(more) == 0, done).when(F.size(done) == 0, more).otherwise(F.concat(done, apart(more, done))))
    ordered = placed.select("row", "text", F.array_sort(both).alias("at"))
    return ordered.select("row", "text", F.expr(f"transform(at, x -> named_struct('start', x.start, 'end', x.end, {_features()}))").alias("found"))


def labelled_findings(spark: SparkSession, rows: int = LABELLED, seed: str = "findings", unseen: bool = False) -> DataFrame:
    """text with one finding each, and secret (1 or 0); of the kinds that training sees, or of others."""
    h = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    b64 = F.translate(F.base64(F.unhex(h)), "=", "")
    mixed = F.translate(b64, "+/", "x9")
    b64_again = F.translate(F.base64(F.unhex(F.sha2(F.concat(h, F.lit("again")), 256))), "+/=", "")
    number = F.translate(F.substring(h, 1, 20), "abcdef", "123456")
    pick = lambda values, at: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.conv(F.substring(h, at, 4), 16, 10).cast("int") % len(values)) + 1)
    word, other, two = pick(DICTIONARY, 49), pick(DICTIONARY, 53), F.substring(number, 1, 2)
    cat = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    name = pick(["password", "secret", "token", "api_key", "API_KEY", "apiKey", "client_secret", "auth_token", "access_key", "private_key", "DB_PASSWORD", "credential"], 45)
    open_, close = pick(["=", ": ", ' = "', ": '", "='", '": "', " = "], 41), pick(['"', "'", "", ";", "", " "], 41)
    carried = lambda value: cat(name, open_, value, close)
    aside = lambda value, *leads: cat(pick(list(leads), 37), value)
    if not unseen:
        secret = [
            carried(F.substring(h, 1, 40)), carried(F.substring(h, 1, 32)), carried(cat("k1", F.substring(mixed, 1, 32))), carried(cat("7", F.substring(mixed, 1, 20))), carried(cat("9", b64)), carried(cat("a8", F.substring(mixed, 1, 26), "_", two)),
            cat(pick(["key id ", "aws ", "AWS_ACCESS_KEY_ID=", "credentials ", ""], 33), "AKIA", F.upper(F.translate(F.substring(mixed, 1, 16), "abc", "XQ7"))), cat(pick(["use ", "token ", "export GH=", "with ", ""], 33), "ghp_", F.substring(mixed, 1, 34), "4z"),
            cat("Authorization: Bearer 9", b64), carried(cat(F.substring(mixed, 1, 5), pick(["!", "#", "%", "&", "$"], 33), F.substring(mixed, 9, 4), two)), cat("postgres://", word, ":", F.substring(mixed, 1, 12), "@db.", other, ".net/x"), cat("-----BEGIN RSA PRIVATE KEY-----"),
            cat(pick(["", "paste ", "my key is ", "it says "], 33), "rk_", pick(["live", "prod"], 29), "_", F.substring(mixed, 1, 28), "6"),
            cat(pick(["", "use ", "git clone with ", "export T="], 33), pick(["ghp_", "gho_", "ghs_"], 29), F.substring(mixed, 5, 18), F.substring(b64_again, 2, 18)),
            cat(pick(["Authorization: Bearer ", "jwt ", "", "cookie session="], 33), "eyJ", F.substring(mixed, 1, 20), ".eyJ", F.substring(mixed, 9, 24), ".", F.substring(mixed, 2, 40)),
            cat(pick(["my password is ", "the passphrase was ", "her password is '", "pwd is "], 33), word, pick(["!", "#", "", "$", "@"], 29), two, pick(["", "'", "!"], 25)),
        ]
        plain = [
            aside(F.substring(h, 1, 40), "commit ", "merge ", "at revision ", "see ", "parent "), aside(uuid, "uuid ", "id ", "request ", "session id: ", "order token id ", "trace="), cat(pick(["see ", "in ", "at ", "from "], 33), "/usr/share/", word, "/", other, two, "/index.html"),
            cat("calls test_", word, "_", other, "_handler_v", two), aside(F.substring(number, 1, 18), "of ", "account ", "tracking ", "order "), aside(h, "sha256: ", "sha256:", "checksum ", "digest: "), cat("the token file is /etc/", word, "/", other, "_token_", two, ".json"),
            aside(F.substring(h, 1, 32), "md5 ", "ETag: ", "hash of the file ", "cache/"), cat(name, open_, pick(["changeme", "your_password_1", "example-token-1234", "required", "optional", "${SECRET_VALUE}", "xxxxxxxxxxxx", "string or none"], 33), close), cat("data:image/png;base64,", b64),
            cat(word, F.initcap(other), F.initcap(word), two, "Configuration"), cat("version ", two, "-", word, "-", other, "-20240101"), cat(name, " = get_", word, "_", other, "(", two, ")"),
            cat(pick(['integrity="', "integrity='", "integrity: "], 33), pick(["sha256-", "sha384-", "sha512-"], 29), b64, F.substring(mixed, 1, 20), pick(['"', "'", "=="], 25)),
            cat(pick(["get", "set", "load", "is", "handle"], 33), F.initcap(word), F.initcap(other), pick(["Settings", "Account", "2", "V2", ""], 29), two, pick(["From", "To", "By", "With"], 25), F.initcap(word), pick(["()", "", ".java", "Test"], 21)),
            cat(pick(["my password is ", "the password was "], 33), pick(["required", "changed 2 times", "too short", "on the note", "not stored"], 29)),
        ]
    else:
        secret = [
            cat(pick(["", "slack ", "use "], 33), "xoxb-", F.substring(number, 1, 12), "-", F.substring(mixed, 1, 24)), cat(pick(["", "key: ", "stripe = '"], 33), "sk_test_", F.substring(mixed, 3, 24)), cat(pick(["", "maps ", "key="], 33), "AIza", F.substring(mixed, 2, 35)), cat("glpat-", F.substring(mixed, 4, 20)),
            cat("AccountKey=", b64, "=="), cat("passphrase: ", F.substring(mixed, 5, 9), "~", two), cat("mysql://root:", F.substring(h, 3, 10), "@", word, ":3306"), cat("npm_", F.substring(mixed, 1, 36)),
        ]
        plain = [
            cat("image@sha256:", h), cat("Message-ID: <", F.substring(number, 1, 16), ".", two, "@mail>"), cat("build-", F.substring(h, 1, 24)), cat("parcel 1Z", F.substring(number, 1, 16)), cat("https://cdn.net/", word, "/", other, "-", two, "-800x600.jpg"),
            cat("password: must_", word, "_first"), cat("X-Request-Id: ", uuid), cat(F.upper(word), "_", F.upper(other), "_MAX_SIZE_", two),
        ]
    kinds = [(x, 1) for x in secret] + [(x, 0) for x in plain]
    text, label = F.lit(""), F.lit(0)
    for i, (made, y) in enumerate(kinds):
        hit = F.col("id") % len(kinds) == i
        text, label = F.when(hit, made).otherwise(text), F.when(hit, F.lit(y)).otherwise(label)
    lead, trail = pick(["", "and ", "then we have ", "# ", "note: ", "  "], 25), pick(["", " then ", "\n", " # ok", ", ", " and more of the "], 21)
    return spark.range(0, rows, 1, PARTS).select(F.concat(word, F.lit(" "), lead, text, trail, other).alias("text"), label.alias("secret"))


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
    """A random forest on the candidates of labelled texts (columns text and secret), or None without both labels."""
    rows = candidates(labelled).select(F.explode_outer("found").alias("c"), F.col("row.secret").cast("double").alias("label"))
    # Training reads its rows once a level; the features are computed once.
    rows = cut(rows.filter("c is not null").select("label", *[f"c.{f}" for f in FEATURES]).filter("label in (0, 1)"))
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors)


def probability(model) -> Callable[[Column], Column]:
    """The mean share of secrets in the leaves that a candidate falls into, as an expression of its struct."""

    def walk(node, c: Column) -> Column:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / max(sum(stats), 1e-9)))
        split = node.split()
        return F.when(c[FEATURES[split.featureIndex()]] <= float(split.threshold()), walk(node.leftChild(), c)).otherwise(walk(node.rightChild(), c))

    def score(c: Column) -> Column:
        total = F.lit(0.0)
        for tree in model.trees:
            total = total + walk(tree._java_obj.rootNode(), c)
        return total / len(model.trees)

    return score


def scan(docs: DataFrame, model, accept: float = ACCEPT) -> DataFrame:
    """row, text, found (all candidates with score) and secrets: those with a score of accept or more."""
    judged = candidates(docs)
    score = probability(model) if model is not None else lambda c: F.lit(1.0)
    scored = judged.select("row", "text", F.transform("found", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), score(c).alias("score"))).alias("found"))
    return scored.withColumn("secrets", F.filter("found", lambda c: c["score"] >= accept))
