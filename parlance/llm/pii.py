"""Personal data by weak supervision, in DataFrame functions only.

Base spans follow four fixed rules and always stay. Looser patterns give candidate spans on top, on which four labelers
vote for, against or not at all: the strict form of the pattern, a gazetteer of key words before the span, the
punctuation around it, and its digits and letters. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is, and its posteriors train a logistic classifier of spans, which decides on the candidates.
Texts are read once, spans are kept in a small table, and only counts of vote patterns reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import materialize

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
# Longest runs never give back in these rules, so possessive quantifiers change no match; \G is the end of the last match,
# and no match starts inside a run whose first character failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tests that every text with a span that counts passes.
NEEDED = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,64}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,64}+)++",
    "card": r"(?<![0-9.+(-])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![0-9A-Za-z])(?=[A-Za-z]{0,64}+[0-9])(?=[0-9]{0,64}+[A-Za-z])[0-9A-Za-z]{16,}+",
}
CANDIDATE_NEEDED = {"email": r"[(\[]at[)\]]", "card": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}", "phone": r"[0-9][\x20.)-]", "secret": r"[0-9][A-Za-z]|[A-Za-z][0-9]"}
STRICT = {"email": r"^[^ ]+ ?[(\[]at[)\]]", "card": r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})$", "phone": r"^\(", "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[A-Za-z0-9]{24,64})$"}
GAZETTEER = {"email": r"(?i)\b(?:e-?mail|mail|contact|write)", "card": r"(?i)\b(?:card|visa|credit|debit|payment|account)", "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)", "secret": r"(?i)(?:token|passw(?:or)?d|secret|api[_-]?key|credential|auth)"}
BEFORE = 32
LABELERS = ("strict", "gazetteer", "context", "shape")


def found(text: Column, pattern: str, needed: str) -> Column:
    """All matches as structs of start, end (code points, end exclusive) and value; null and no match: empty."""
    places = F.aggregate(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"),
            F.when(x["value"].isNull(), acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))))
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(needed), places).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weighed(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^0*([0-9]{1,3})$", 1).try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _votes(kind: str, text: Column, span: Column) -> dict[str, Column]:
    value = span["value"]
    before = F.substring(text, F.greatest(span["start"] - BEFORE, F.lit(0)) + 1, span["start"] - F.greatest(span["start"] - BEFORE, F.lit(0)))
    digits = F.regexp_replace(value, r"[^0-9]", "")
    variety = F.size(F.array_distinct(F.split(value, "")))
    if kind == "card":
        shape = F.when(luhn(digits), 1).otherwise(-1)
    elif kind == "secret":
        shape = F.when(variety >= 10, 1).otherwise(-1)
    else:
        shape = F.when(F.length(digits) % 10 == 0, 1).otherwise(0)
    return {
        "strict": F.when(value.rlike(STRICT[kind]), 1).otherwise(0),
        "gazetteer": F.when(before.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind == "secret" else 0),
        "context": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[A-Za-z,]\x20$"), -1).otherwise(0),
        "shape": shape,
    }


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda s: holds(kind, s["value"])


def _candidate(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v.cast("int").alias(k) for k, v in _votes(kind, F.col("text"), s).items()))


def span_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, base (arrays of spans by kind) and candidates with votes that touch no base span, of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", whole.alias("text"))
    for kind in KINDS:
        spans = F.filter(found(F.col("text"), PATTERNS[kind], NEEDED[kind]), _valid(kind))
        rows = rows.withColumn(kind, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    every = F.concat(*KINDS)
    parts = []
    for kind in CANDIDATES:
        spans = F.filter(found(F.col("text"), CANDIDATES[kind], CANDIDATE_NEEDED[kind]), lambda s: ~F.exists(every, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        parts.append(F.transform(spans, _candidate(kind)))
    return rows.select("doc_id", *KINDS, F.concat(*parts).alias("candidates"))


def reliabilities(patterns: dict[tuple, float], rounds: int = 50) -> tuple[dict[str, float], dict[tuple, float], dict[tuple, float]]:
    """Share of true spans by kind, P(vote | true?) by (labeler, vote, truth), and P(true) of each vote pattern, by EM."""
    kinds = sorted({p[0] for p in patterns})
    share = dict.fromkeys(kinds, 0.5)
    vote = {(k, v, y): (0.5 if v == 0 else 0.35 if (v > 0) == y else 0.15) for k in range(len(LABELERS)) for v in (-1, 0, 1) for y in (True, False)}
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = share[p[0]], 1 - share[p[0]]
            for k, v in enumerate(p[1:]):
                yes, no = yes * vote[k, v, True], no * vote[k, v, False]
            posterior[p] = yes / (yes + no)
        for kind in kinds:  # one span for and one against keep shares and reliabilities off 0 and 1
            own = [(n, posterior[p]) for p, n in patterns.items() if p[0] == kind]
            share[kind] = (1 + sum(n * q for n, q in own)) / (2 + sum(n for n, _ in own))
        for k in range(len(LABELERS)):
            for y in (True, False):
                mass = {v: sum(n * (posterior[p] if y else 1 - posterior[p]) for p, n in patterns.items() if p[1 + k] == v) for v in (-1, 0, 1)}
                prior = {0: 1.0, 1: 0.7 if y else 0.3, -1: 0.3 if y else 0.7}
                for v in mass:
                    vote[k, v, y] = (mass[v] + 10 * prior[v]) / (sum(mass.values()) + 20)
    return share, vote, posterior


def fit_classifier(patterns: dict[tuple, float], posterior: dict[tuple, float], rounds: int = 400) -> dict[str, float]:
    """Logistic weights of kinds and votes, from posteriors as soft labels (L2-regularised gradient steps)."""
    names = [*(f"kind:{k}" for k in CANDIDATES), *LABELERS]
    rows = [({f"kind:{p[0]}": 1.0, **{name: float(v) for name, v in zip(LABELERS, p[1:])}}, n, posterior[p]) for p, n in patterns.items()]
    total = sum(n for _, n, _ in rows) or 1.0
    weights = dict.fromkeys(names, 0.0)
    for _ in range(rounds):
        gradient = {name: -0.001 * w for name, w in weights.items()}
        for x, n, q in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] * v for k, v in x.items())))))
            for k, v in x.items():
                gradient[k] += n / total * (q - p) * v
        for name in names:
            weights[name] += 1.0 * gradient[name]
    return weights


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row.

    Base spans are leftmost and do not overlap within a kind; spans are code points, end exclusive. Null, empty and clean
    texts have no spans and the hash of the empty string. Whole texts are read. Repeated rows give equal rows, a null
    doc_id stays null, an empty table gives no rows, other columns are not read.
    """
    table = materialize(span_table(docs, text), "spans")
    votes = table.select(F.explode("candidates").alias("c")).select("c.*").groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))
    patterns = {tuple(r[:-1]): float(r["n"]) for r in votes.collect()}  # at most 3 ** 4 for each kind
    _, _, posterior = reliabilities(patterns)
    weights = fit_classifier(patterns, posterior)

    def accepted(c: Column) -> Column:
        logit = F.lit(0.0)
        for kind in CANDIDATES:
            logit = F.when(c["kind"] == kind, F.lit(weights[f"kind:{kind}"])).otherwise(logit)
        for name in LABELERS:
            logit = logit + F.lit(weights[name]) * c[name]
        return logit >= 0

    def said(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    table = table.withColumn("added", F.filter("candidates", accepted))
    base = F.concat(*(said(k, F.col(k)) for k in KINDS))

    def with_added(kind: str) -> Column:
        extra = F.transform(F.filter("added", lambda c: c["kind"] == kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
        return said(kind, F.array_sort(F.concat(F.col(kind), extra)) if kind in KINDS else F.array_sort(extra))

    return table.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(with_added(k) for k in ALL_KINDS)), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
