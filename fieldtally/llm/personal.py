"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each one (for, against, or
abstaining): pattern labelers check validity and shape, gazetteers know cue words,
domains and names of secrets, context labelers look at what stands around the
span. Expectation maximisation estimates from their agreement how reliable each
labeler is, and the posteriors train a logistic classifier of spans. Valid spans
of the four base kinds are always kept; the classifier adds others.

Candidates, votes and the final decision are built-in expressions inside one row,
so texts are never shuffled. Estimation needs only the number of candidates of
each kind and combination of votes: ``KINDS * 3 ** LABELERS`` rows at most, whatever
the corpus holds, which is why they may come to the driver.

Defined results: a null text is empty; a text without candidates gives zeros and
an empty list; repeated rows stay repeated; extra columns are ignored or, in
``redacted``, kept; with an empty table or no candidates only base spans are kept.
Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns match what their plain greedy forms match, but in linear time: a match can only begin at the start of a run or where the last one ended,
# and parts that cannot be given back are possessive.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s{0,3}[:=]\s{0,3}\"?[^\s\"]{8,}",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "spelled_email": (
        r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,64}+\s?[\[(]at[\])]\s?[a-z0-9-]{1,63}"
        r"(?:\s?(?:[\[(]dot[\])]|\.)\s?[a-z0-9-]{1,63}){1,4}"
    ),
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A cheap test that texts with a match pass.
HINTS = {"email": "@", "ip": "[.]", "phone": "[+]", "spelled_email": "[aA][tT]"}

CUES = {
    "email": "mail|contact|write to|reach|courriel|correo|kontakt",
    "ip": r"\bip\b|host|server|address|adresse|login|logged",
    "card": "card|visa|mastercard|credit|payment|carte|tarjeta|karte",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "secret": "login|credential|access|auth|admin",
    "id_number": r"ssn|social|security|\bid\b|passport|tax",
    "local_phone": "phone|tel|call|mobile|fax|telefon|telefono",
    "spelled_email": "mail|contact|write to|reach|courriel|correo|kontakt",
}
DOMAIN = r"(?i)[.](?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu)$"
AGAINST = r"(?i)(?:version|release|chapter|section|figure|page|isbn|issn|rfc|order|invoice|license|\bno[.]|§)[^\n]{0,8}$"
CONTEXT = 40
LABELERS = ("validity", "shape", "cue", "gazetteer", "against", "edges")
_SPAN = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str) -> Column:
    """All matches with code point offsets and what stands around them: the pieces
    between the matches give the distances."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )

    def spans(x: Column) -> Column:
        def step(done: Column, match: Column) -> Column:
            start = done["at"] + F.char_length(F.get(x["pieces"], match["i"]))
            end = start + F.char_length(match["m"])
            span = F.struct(
                start.alias("start"), end.alias("end"), match["m"].alias("match"),
                F.right(F.get(x["pieces"], match["i"]), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(x["pieces"], match["i"] + 1), F.lit(1)).alias("after"),
            )
            return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
        numbered = F.transform(x["found"], lambda m, i: F.struct(m.alias("m"), i.alias("i")))
        return F.aggregate(numbered, nothing, step, lambda done: done["spans"])

    return F.when(text.rlike(pattern), _bound(parts, spans)).otherwise(F.array().cast(_SPAN))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def worth(i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.when(i % 2 == 0, doubled).otherwise(digit)

    places = F.sequence(F.lit(1), F.char_length(digits))
    total = F.aggregate(F.transform(places, worth), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The base rule of a kind; false for the kinds that the method adds."""
    count = F.char_length(_digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(
            F.split(match, r"\."),
            lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3,
        )
        small = F.forall(parts, lambda p: p)
        return F.when(
            small, F.forall(F.split(match, r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255)
        ).otherwise(False)
    if kind == "card":
        return F.when((count >= 16) & (count <= 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return (count >= 8) & (count <= 15)
    return F.lit(False)


def _shape(kind: str, match: Column) -> Column:
    """Whether the match looks like a real one; no base rule asks for this."""
    digits = _digits(match)
    looks = {
        "email": match.rlike(r"(?i)^[a-z0-9][^@]{0,63}@[^@]{1,200}[.][a-z]{2,10}$"),
        "ip": ~match.rlike(r"(?:^|[.])0[0-9]|^0[.]"),
        "card": digits.rlike("^[3-6]") & (F.char_length(digits) >= 14),
        "phone": match.rlike(r"^\+[1-9][0-9]{0,2}[\x20(.-]"),
        "secret": match.rlike(r"[0-9]") & match.rlike(r"[=:]\s{0,3}\"?[^\s\"]{12,}"),
        "id_number": ~match.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "local_phone": match.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9]"),
        "spelled_email": match.rlike(r"(?i)(?:dot[\])]|[.])\s?[a-z]{2,10}$"),
    }
    return looks[kind]


def _vote(condition: Column, yes: int, no: int) -> Column:
    return F.when(condition, yes).otherwise(no).cast("int")


def _votes(kind: str, span: Column, ok: Column) -> Column:
    match, before, after = span["match"], span["before"], span["after"]
    validity = _vote(ok, 1, -1) if kind in BASE else F.lit(0)
    known = {
        "email": match.rlike(DOMAIN),
        "spelled_email": match.rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|eu)$"),
        "secret": match.rlike("(?i)^(?:password|token|api)"),
    }.get(kind, F.lit(False))
    glued = before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")
    return F.array(
        validity,
        _vote(_shape(kind, match), 1, -1),
        _vote(before.rlike(f"(?i)(?:{CUES[kind]})"), 1, 0),
        _vote(known, 1, 0),
        _vote(before.rlike(AGAINST), -1, 0),
        _vote(glued, -1, 1),
    )


def _described(kind: str):
    def describe(span: Column) -> Column:
        ok = F.coalesce(valid(kind, span["match"]), F.lit(False))
        abstain = F.array(*[F.lit(0)] * len(LABELERS))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"),
            span["start"].alias("start"), span["end"].alias("end"), ok.alias("ok"),
            F.coalesce(_votes(kind, span, ok), abstain).alias("votes"),
        )

    return describe


def candidates(text: Column) -> Column:
    """All candidate spans of a text: kind, offsets, ``ok`` (a valid base span) and
    the votes, by kind, then by start."""
    found = []
    for kind, pattern in PATTERNS.items():
        spans = located(text, pattern)
        if kind in HINTS:
            spans = F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(_SPAN))
        found.append(F.transform(spans, _described(kind)))
    return F.concat(*found)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the logistic classifier: one for each kind, and for each labeler
    one for a vote for and one for a vote against."""

    kinds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(KINDS, -1.0))
    pro: tuple[float, ...] = (0.0,) * len(LABELERS)
    contra: tuple[float, ...] = (0.0,) * len(LABELERS)
    reliability: tuple[float, ...] = ()

    def score(self, candidate: Column) -> Column:
        total = F.lit(0.0)
        for kind, weight in self.kinds.items():
            total = total + F.when(candidate["kind"] == kind, weight).otherwise(0.0)
        for i, (plus, minus) in enumerate(zip(self.pro, self.contra)):
            vote = F.get(candidate["votes"], F.lit(i))
            total = total + F.when(vote == 1, plus).when(vote == -1, minus).otherwise(0.0)
        return total


def estimate_reliabilities(
    votes: np.ndarray, counts: np.ndarray, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation with labelers independent given the truth, begun
    at the majority. Gives the posterior of each combination, and for each labeler
    and truth the chances of its three votes (smoothed by one candidate each)."""
    posterior = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    table = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        for truth, weight in ((0, 1 - posterior), (1, posterior)):
            for value in (-1, 0, 1):
                table[:, truth, value + 1] = ((votes == value) * (weight * counts)[:, None]).sum(0) + 1
        table /= table.sum(axis=2, keepdims=True)
        prior = ((posterior * counts).sum() + 1) / (counts.sum() + 2)
        log_odds = np.full(len(votes), math.log(prior / (1 - prior)))
        for i in range(votes.shape[1]):
            chances = table[i][:, votes[:, i] + 1]
            log_odds += np.log(chances[1]) - np.log(chances[0])
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior, table


def train_span_model(rows: list[tuple[str, tuple[int, ...], int]]) -> SpanModel:
    """``rows``: kind, votes, number of candidates. Newton steps on the penalised
    likelihood of the posteriors."""
    if not rows:
        return SpanModel()
    kinds = np.array([KINDS.index(kind) for kind, _, _ in rows])
    votes = np.array([v for _, v, _ in rows], dtype=int)
    counts = np.array([n for _, _, n in rows], dtype=float)
    posterior, table = estimate_reliabilities(votes, counts)
    features = np.hstack([np.eye(len(KINDS))[kinds], votes == 1, votes == -1]).astype(float)
    weights = np.zeros(features.shape[1])
    scale = counts / counts.sum() * min(counts.sum(), 1e4)
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (scale * (posterior - chance)) - weights
        bend = (features * (scale * chance * (1 - chance))[:, None]).T @ features
        weights += np.linalg.solve(bend + np.eye(len(weights)), slope)
    k, n = len(KINDS), len(LABELERS)
    agreement = table[:, 1, 2] / (table[:, 1, 2] + table[:, 0, 2])
    return SpanModel(
        kinds={kind: float(w) for kind, w in zip(KINDS, weights)},
        pro=tuple(map(float, weights[k : k + n])),
        contra=tuple(map(float, weights[k + n :])),
        reliability=tuple(map(float, agreement)),
    )


def _with_candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(_CANDIDATES, candidates(text))


#: Columns inside the operators; no column of a user is named so.
_CANDIDATES, _SPANS, _BASE = "__pii_candidates", "__pii_spans", "__pii_base"


def fit(docs: DataFrame) -> SpanModel:
    """Learn from the candidates of all documents."""
    votes = _with_candidates(docs.select("text")).select(
        F.explode(_CANDIDATES).alias("c")
    ).select("c.kind", "c.votes")
    counted = votes.groupBy("kind", "votes").count().collect()  # bounded, see above
    return train_span_model(
        sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in counted)
    )


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _outweighed(candidate: Column) -> Column:
    """What stands before the span speaks against it, and neither its own rule nor a cue
    nor the gazetteer for it."""
    vote = {name: F.get(candidate["votes"], F.lit(i)) for i, name in enumerate(LABELERS)}
    favour = (vote["validity"] == 1) | (vote["cue"] == 1) | (vote["gazetteer"] == 1)
    return (vote["against"] == -1) & ~favour


def with_spans(docs: DataFrame, model: SpanModel, spans: str = "pii_spans", base: str = "pii_base") -> DataFrame:
    """``docs`` with the columns ``pii_base`` and ``pii_spans`` (in place of columns of
    these names), by kind, then start. A span that the classifier adds must not have
    its evidence outweighed, nor overlap a base span or one added for an earlier kind."""
    found = _with_candidates(docs).withColumn(
        _CANDIDATES,
        F.filter(_CANDIDATES, lambda c: c["ok"] | ((model.score(c) > 0) & ~_outweighed(c))),
    )

    def chosen(every: Column) -> Column:
        return F.filter(
            every,
            lambda c: c["ok"]
            | ~F.exists(
                every,
                lambda o: (o["ok"] | (o["rank"] < c["rank"])) & _overlaps(o, c),
            ),
        )

    return found.withColumn(spans, _bound(F.col(_CANDIDATES), chosen)).withColumn(
        base, F.filter(spans, lambda c: c["ok"])
    ).drop(_CANDIDATES)


def as_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets;
    overlapping spans are replaced together. A null text stays null; all columns stay."""
    model = model or fit(docs)
    marked = with_spans(docs, model, _SPANS, _BASE)

    def cut(x: Column) -> Column:
        def step(done: Column, span: Column) -> Column:
            fresh = span["start"] >= done["at"]
            between = F.substring(x["text"], done["at"] + 1, span["start"] - done["at"])
            return F.struct(
                F.greatest(done["at"], span["end"]).alias("at"),
                F.when(
                    fresh,
                    F.concat(
                        done["parts"],
                        F.array(between, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))),
                    ),
                ).otherwise(done["parts"]).alias("parts"),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(
            x["spans"], start, step,
            lambda done: F.concat(
                F.array_join(done["parts"], ""),
                F.substring(x["text"], done["at"] + 1, F.char_length(x["text"])),
            ),
        )

    ordered = F.array_sort(
        F.transform(_SPANS, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    clean = _bound(F.struct(F.col("text").alias("text"), ordered.alias("spans")), cut)
    return marked.withColumn(
        "text", F.when(F.size(_SPANS) > 0, clean).otherwise(F.col("text"))
    ).select(*docs.columns)


def op9_weak_supervision(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = with_spans(docs, fit(docs))

    def number(kind: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return marked.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[number(kind) for kind in BASE],
        F.sha2(as_text(F.col("pii_base")), 256).alias("base_sha256"),
        as_text(F.col("pii_spans")).alias("spans"), (F.size("pii_spans") > 0).alias("has_personal_data"),
    )
