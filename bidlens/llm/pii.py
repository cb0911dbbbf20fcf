"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give the base spans. Looser patterns give candidates, on which labelers
vote: by form, by a gazetteer of key words before the span, by context. Votes are counted
by pattern, expectation-maximisation estimates how reliable each labeler is, and a
logistic span classifier is trained on the resulting probabilities. Only the counts, whose
number is bounded by the numbers of votes and features, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from bidlens.llm.common import let
from bidlens.session import materialise

# A start inside a run of name characters has the same continuation as the run's start, so
# only the run's start and the place after the last match are tried.
_NAME = "[A-Za-z0-9._%+-]"
BASE = {
    "email": f"(?:(?<!{_NAME})|\\G){_NAME}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# Texts without this have no match; it is cheaper to look for. ``digit`` says whether a text has one.
_NEEDED = {
    "email": lambda t, digit: t.contains("@"), "ip": lambda t, digit: digit & t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t, digit: digit & t.rlike("[0-9](?:[\\x20-]?[0-9]){13}"), "phone": lambda t, digit: digit & t.contains("+"),
}
# Candidates by kind; the first that matches at a place is taken. They are looked for in texts
# with two digits in a row, a spelled dot or a run as long as a secret: each pattern implies one.
LOOSE = {
    "spelled_email": "(?<![A-Za-z0-9._])[A-Za-z0-9._]{2,64}+\\x20[\\[(]?at[\\])]?\\x20[A-Za-z0-9-]{2,64}+\\x20[\\[(]?dot[\\])]?\\x20[A-Za-z]{2,10}(?![A-Za-z])",
    "national_id": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": "(?<![0-9+)-])\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9])",
    "account": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){3,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": "(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
KINDS = [*BASE, *LOOSE]
CONTEXT = 32
# Words that stand before personal data, in the languages of the corpus.
KEY_WORDS = [
    "token", "secret", "password", "passwd", "pwd", "passwort", "contraseña", "mot de passe", "api key", "api_key", "apikey",
    "access key", "private key", "bearer", "auth", "credential", "phone", "tel", "telefon", "teléfono", "téléphone", "mobile",
    "fax", "call", "contact", "mail", "iban", "account", "konto", "compte", "cuenta", "ssn", "social security", "passport",
]
# What stands where no real value is meant.
PLACEHOLDERS = "(?i)example|sample|placeholder|xxxx|0000000|1234567|abcdef|your[_-]"
VOTES = ["by_form", "by_key_word", "by_assignment", "by_spread", "by_placeholder", "by_frame"]
FEATURES = ["f_hex", "f_digits", "f_letters", "f_long", "f_quoted", "f_assigned", "f_key_word", "f_fixed_form"]
EM_ROUNDS = 50
FIT_ROUNDS = 400
THRESHOLD = 0.5


def running(sizes: Column) -> Column:
    """Sum of all entries before each one, in blocks of 64 so that many entries stay cheap."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def body(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 64).cast("int")), lambda b: total(F.slice(s, b * 64 + 1, 64)))

        def with_blocks(bs: Column) -> Column:
            firsts = F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b)))
            return let(firsts, lambda fs: F.transform(
                s, lambda _, i: F.get(fs, F.floor(i / 64).cast("int")) + total(F.slice(s, F.floor(i / 64).cast("int") * 64 + 1, i % 64))
            ))

        return let(blocks, with_blocks)

    return let(sizes, body)


def located(text: Column, pattern: str) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches, in code points.

    The parts between matches and the matches themselves tell where each match starts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(m))
        places = let(gaps, lambda gap: F.zip_with(
            F.zip_with(running(F.zip_with(gap, m, lambda g, v: g + F.length(v))), gap, lambda a, b: a + b), m,
            lambda start, v: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")),
        ))
        return F.when(F.size(m) > 0, places).otherwise(_no_spans())

    return let(found, spans)


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.transform(F.split(v, "\\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255")),
    "card": lambda v: let(_digits(v), lambda d: F.length(d).between(14, 19) & _luhn(d)),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def base_spans(text: Column, kind: str, digit: Column) -> Column:
    found = F.filter(located(text, BASE[kind]), lambda s: VALID[kind](s["value"]))
    return F.when(_NEEDED[kind](text, digit), found).otherwise(_no_spans())


def candidates(text: Column, digit: Column) -> Column:
    """Spans of the loose patterns with their kind, the text before and the character after."""
    pattern = "|".join(LOOSE.values())
    needed = digit & text.rlike("[0-9]{2}") | text.rlike("\\x20[\\[(]?dot[\\])]?\\x20") | text.rlike("[A-Za-z0-9_+/=-]{20}")

    def described(s: Column) -> Column:
        kind = F.lit("secret")
        for name in reversed([k for k in LOOSE if k != "secret"]):
            kind = F.when(s["value"].rlike("^" + LOOSE[name] + "$"), F.lit(name)).otherwise(kind)
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.lower(F.substring(text, first + 1, s["start"] - first)).alias("before"),
            F.substring(text, s["end"] + 1, F.lit(1)).alias("after"),
        )

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>")
    return F.when(needed, F.transform(located(text, pattern), described)).otherwise(empty)


def judged(c: Column) -> Column:
    """A candidate with the labelers' votes (1 private, -1 not, 0 none) and the classifier's features."""
    v, n = c["value"], F.length(c["value"])
    secret = c["kind"] == "secret"
    digits = n - F.length(F.regexp_replace(v, "[0-9]", ""))
    letters = n - F.length(F.regexp_replace(v, "[A-Za-z]", ""))
    kinds = F.size(F.array_distinct(F.split(v, "")))
    hexes = v.rlike("^[0-9a-fA-F]{20,}$")
    assigned = c["before"].rlike("[=:]\\s*[\"'`]?$")
    quoted = c["before"].rlike("[\"'`]$") & c["after"].isin('"', "'", "`")
    key_word = c["before"].rlike("(?<![\\p{L}])(?:" + "|".join(KEY_WORDS) + ")(?![\\p{L}])")
    spread = (digits >= 3) & (letters >= 3) & (kinds >= 8)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    return F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        vote(~secret | hexes & (digits >= 4), secret & (digits == 0)).alias("by_form"),
        vote(key_word, F.lit(False)).alias("by_key_word"),
        vote(assigned, F.lit(False)).alias("by_assignment"),
        vote(secret & spread | ~secret & (kinds >= 4), kinds < 4).alias("by_spread"),
        vote(F.lit(False), v.rlike(PLACEHOLDERS) | c["before"].rlike("(?:://|www\\.)\\S*$")).alias("by_placeholder"),
        vote(quoted, secret & v.rlike("^[=_/+-]+$")).alias("by_frame"),
        *[f.cast("int").alias(name) for f, name in zip(
            (hexes, digits * 4 >= n, letters * 2 >= n, n >= 32, quoted, assigned, key_word, ~secret), FEATURES
        )],
    )


def estimate(rows: list) -> list[float]:
    """Probability that a span is private, per counted pattern: expectation-maximisation over the labelers.

    Each labeler has its own chances of each vote for private and for other spans; the start
    is the majority of the votes. All chances are smoothed by one row.
    """
    chance = [min(0.95, max(0.05, 0.5 + 0.25 * sum(r[v] for v in VOTES))) for r in rows]
    for _ in range(EM_ROUNDS):
        sides = []
        for side in (1, 0):
            weight = [r["n"] * (p if side else 1 - p) for r, p in zip(rows, chance)]
            total = sum(weight)
            votes = [{x: (sum(w for w, r in zip(weight, rows) if r[v] == x) + 1) / (total + 3) for x in (-1, 0, 1)} for v in VOTES]
            sides.append((math.log(total + 1), votes))
        logs = [[head + sum(math.log(votes[k][r[v]]) for k, v in enumerate(VOTES)) for head, votes in sides] for r in rows]
        chance = [1 / (1 + math.exp(min(50.0, max(-50.0, no - yes)))) for yes, no in logs]
    return chance


def fit(rows: list, chance: list[float]) -> tuple[float, dict[str, float]]:
    """Span classifier: logistic regression of the estimated probabilities on the features."""
    weights = {f: 0.0 for f in FEATURES}
    bias, total = 0.0, sum(r["n"] for r in rows)
    for _ in range(FIT_ROUNDS if total else 0):
        slope, slopes = 0.0, dict.fromkeys(FEATURES, 0.0)
        for r, target in zip(rows, chance):
            z = bias + sum(weights[f] for f in FEATURES if r[f])
            error = r["n"] / total * (1 / (1 + math.exp(-min(50.0, max(-50.0, z)))) - target)
            slope += error
            for f in FEATURES:
                if r[f]:
                    slopes[f] += error
        bias -= 2.0 * slope
        weights = {f: w - 2.0 * (slopes[f] + 1e-4 * w) for f, w in weights.items()}
    return bias, weights


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one array of base spans per kind, judged candidates that no base span touches), written once."""
    t = F.col("_text")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = texts.withColumn("_digit", t.rlike("[0-9]"))
    base = texts.select("doc_id", *[
        F.transform(base_spans(t, k, F.col("_digit")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in BASE
    ], candidates(t, F.col("_digit")).alias("_candidates"))
    touched = F.concat(*[F.col(k) for k in BASE])
    free = let(touched, lambda spans: F.filter(
        F.col("_candidates"), lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    ))
    return materialise(base.select("doc_id", *BASE, F.transform(free, judged).alias("judged")), "spans")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans) of every whole text, one row per input row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by kind in
    the order of ``KINDS``, joined by commas. The four counts and the hash are of the base
    spans; ``spans`` adds the candidates that the trained classifier takes for private.
    Null and empty texts have no spans (the hash is that of the empty string), repeated rows
    are read each, and without candidates nothing is trained or added. Very long texts are
    read whole; an empty table gives an empty one; further columns, whatever their names, are
    left behind.
    """
    found = found_spans(docs, id_col, text_col)
    spread = found.select(F.explode("judged").alias("c")).select("c.*")
    # At most 3 ** votes x 2 ** features rows, whatever the number of spans.
    rows = spread.groupBy(*VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: tuple(r))
    bias, weights = fit(rows, estimate(rows))

    def private(c: Column) -> Column:
        z = F.lit(bias)
        for name, w in weights.items():
            z = z + F.lit(w) * c[name]
        return z >= math.log(THRESHOLD / (1 - THRESHOLD))

    def ordered(kind: Column | str, number: Column, s: Column) -> Column:
        return F.struct(s["start"].alias("start"), number.alias("number"), s["end"].alias("end"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(k: str) -> Column:
        return F.transform(F.col(k), lambda s: ordered(k, F.lit(KINDS.index(k)), s))

    base = F.concat(*map(of_kind, BASE))
    added = F.transform(
        F.filter(F.col("judged"), private),
        lambda c: ordered(c["kind"], F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1, c),
    )
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.concat(base, added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"), F.size(F.concat(base, added)).cast("long").alias("n_spans"),
    )
