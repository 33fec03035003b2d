"""Personal data by patterns and weak supervision (operator 8, DataFrame functions only).

Base spans come from fixed patterns with checks. Looser candidates (spelled-out addresses, numbers
without a plus sign, 13-digit cards, colon-separated addresses, and access tokens as a kind of their
own) get votes of four labelers: a strict pattern, a gazetteer of prefixes and endings in use, the
words before the span, and a check of digits and length. Votes and the shape of a span make a
pattern; there are a few hundred patterns at most, and only their counts reach the driver.
Expectation-maximisation over the counts estimates each labeler's reliability by kind, its posteriors
train a logistic span classifier on votes and shape, and spans that it accepts and that pass their
check are added. Candidates that overlap a base span are dropped first and train nothing.

Places of matches are found without Python: splitting a text at a pattern gives the parts between
matches, and lengths are summed in blocks of the square root of their number, so thousands of matches
in a text stay cheap. Patterns start only where a run of their first characters starts, or where the
last match ended, so long runs cost linear time.

Defined results: null text is empty and has no spans; repeated rows are read one by one; long texts
are read whole; an empty table gives an empty result; redaction keeps all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, table

#: Kinds in the order of the span text (fixed values).
KINDS = ("email", "ip", "card", "phone")
#: Base kinds, and the kind that only the method adds: strings that open an account.
ALL_KINDS = (*KINDS, "secret")

#: Base patterns, written so that they match what the contract's do, from the same places, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs of digits fail the check in any case
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a text holds no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?:(?:\.| ?(?:\(dot\)|\[dot\]| dot ) ?)[A-Za-z0-9-]{2,24}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,200}+={0,2}(?![A-Za-z0-9_/+=-])",
}
LOOSE_NEEDS = {
    "email": "(?i)[\\[( ](?:dot|at)[\\]) ]",
    "ip": ":[0-9A-Fa-f]{1,4}:",
    "phone": "[0-9]{3}[ .-][0-9]{4}",
    "secret": "(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20}",
}

STRICT = {
    "email": r"^[A-Za-z0-9._%+-]+(?:@|[(\[]at[)\]])[A-Za-z0-9-]+(?:(?:\.|[(\[]dot[)\]])[A-Za-z0-9-]+)+$",
    "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$",
    "card": r"^[0-9]{13,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$|^3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}$",
    "phone": r"^\+[0-9]|^\([0-9]{3}\)",
    "secret": r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|A[KS]IA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,}|xox[abprs]-.+|eyJ.+)$",
}
#: Prefixes and endings in use (fixed values, from public lists): generic and two-letter top-level domains;
#: first numbers of assigned and private address ranges; issuer ranges of payment cards; country calling
#: codes by their first numbers, and area codes of the North American plan; prefixes of access tokens and
#: lengths of digests in hexadecimal.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\] ]? ?)(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|shop|site|xyz|[a-z]{2})$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[013-9][0-9]|12[0-689]|2[01][0-9]|22[0-3])\.|(?i)^(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|3[689]|35(?:2[89]|[3-8])|6011|64[4-9]|65|62)",
    "phone": r"^\+(?:1[ (.-]|7|2[07]|2[1-689]|3[0-469]|3[578]|4[013-9]|42|5[1-8]|5[09]|6[0-6]|6[7-9]|8[1246]|8[058]|9[0-58]|9[679])|^\(?[2-9][0-8][0-9]",
    "secret": r"^(?:A[KS]IA|gh[opsru]_|xox[abprs]-|sk[-_]|eyJ|AIza)|^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})$",
}
#: Words that announce personal data of a kind, in the texts' languages.
CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|correo|courriel|write|kontakt)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse)",
    "card": r"(?i)(?:card|visa|mastercard|karte|carte|tarjeta|credit)",
    "phone": r"(?i)(?:phone|call|tel\b|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)",
    "secret": r"(?i)(?:token|secret|passw|api[ _-]?key|bearer|credential|schlüssel|clave|clé)",
}
BEFORE = 24  # code points of context, back to the match before at most
LABELERS = ("strict", "known", "context", "check")
#: Where estimation starts: how often each labeler votes on personal data, and on other spans.
HIT, MISS = (0.9, 0.8, 0.4, 0.95), (0.2, 0.4, 0.05, 0.3)


def _over_earlier(values: Column, pick, join) -> Column:
    """For each place of an array what ``pick`` makes of all values before it (null for the first).

    Blocks of the square root of the length are picked from first, so this takes m * sqrt(m) steps.
    """

    def build(v: Column, width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda j: pick(F.slice(v, j * width + 1, width)))
        return let(
            blocks,
            lambda done: F.transform(
                v,
                lambda x, i: let(
                    F.floor(i / width).cast("int"),
                    lambda j: join(pick(F.slice(done, F.lit(1), j)), pick(F.slice(v, j * width + 1, i - j * width))),
                ),
            ),
        )

    whole = let(values, lambda v: let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda width: build(v, width)))
    return F.when(F.size(values) > 0, whole).otherwise(F.array().cast("array<int>"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v, w>> of the matches of ``pattern``: start, end (exclusive) in code points, match, text before it."""

    def build(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        return let(
            _over_earlier(steps, _total, lambda a, b: a + b),
            lambda at: F.transform(
                found,
                lambda m, i: let(
                    F.get(at, i) + F.length(F.get(gaps, i)),
                    lambda s: F.struct(
                        s.alias("s"), (s + F.length(m)).alias("e"), m.alias("v"), F.substring(F.get(gaps, i), F.lit(-BEFORE), F.lit(BEFORE)).alias("w")
                    ),
                ),
            ),
        )

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: build(gaps, found)))


_NONE = "array<struct<s:int,e:int,v:string,w:string>>"


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_NONE))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    """Check digit test: from the right, every second digit is doubled and its digits summed."""

    def weigh(digits: Column) -> Column:
        doubled = F.translate(digits, "0123456789", "0246813579")
        return F.aggregate(
            F.sequence(F.lit(1), F.length(digits)),
            F.lit(0),
            lambda a, i: a + F.ascii(F.substring(F.when(i % 2 == 1, digits).otherwise(doubled), i, F.lit(1))) - F.lit(48),
        )

    return let(F.reverse(_digits(value)), lambda d: weigh(d) % 10 == 0)


def _checked(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & passes_luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    """All matches of a base pattern, before its check."""
    present = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9](?:[ -]?[0-9]){12}")
    return _where(present, located(text, BASE[kind]))


def _sound(kind: str, value: Column) -> Column:
    """The labeler of digits and length."""
    digits = F.length(_digits(value))
    if kind == "card":
        return digits.between(13, 19) & passes_luhn(value)
    if kind == "phone":
        return F.when(F.startswith(value, F.lit("+")), digits.between(10, 15)).otherwise(value.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]*[2-9]"))
    if kind == "ip":
        return _checked(kind, value) | value.rlike("(?i)[1-9a-f].*:.*(?:[a-f]|[0-9a-f]{4}:)")
    if kind == "email":
        return value.rlike(r"[@(\[]") | value.rlike("(?i) dot (?:com|org|net|edu|gov|info)$")  # spelled-out words alone are weak
    return value.rlike("[A-Za-z]") & (digits >= 4)


def candidates(text: Column) -> Column:
    """Sorted array<struct<s, k, e, base, strict, known, context, check, shape>>: base spans, and loose ones that overlap none."""

    def described(kind: str, spans: Column, base: Column | None) -> Column:
        def one(x: Column) -> Column:
            value = x["v"]
            shape = F.concat_ws(
                "",
                F.least(F.floor(F.length(_digits(value)) / 4), F.lit(5)).cast("string"),
                F.when(value.rlike("[ ().-]"), F.lit("s")).otherwise(F.lit("n")),
            )
            return F.struct(
                x["s"].alias("s"), F.lit(ALL_KINDS.index(kind)).alias("k"), x["e"].alias("e"),
                (_checked(kind, value) if base is None else base).alias("base"),
                value.rlike(STRICT[kind]).alias("strict"), value.rlike(GAZETTEER[kind]).alias("known"),
                x["w"].rlike(CONTEXT[kind]).alias("context"), _sound(kind, value).alias("check"), shape.alias("shape"),
            )

        return F.transform(spans, one)

    def apart(every: Column) -> Column:
        """Without loose spans that overlap a base span."""
        ends = F.transform(every, lambda c: F.when(c["base"], c["e"]))
        starts = F.reverse(F.transform(every, lambda c: F.when(c["base"], c["s"])))
        return let(
            _over_earlier(ends, F.array_max, F.greatest),
            lambda ended: let(
                F.reverse(_over_earlier(starts, F.array_min, F.least)),
                lambda starting: F.filter(
                    every,
                    lambda c, i: c["base"]
                    | ((F.coalesce(F.get(ended, i), F.lit(0)) <= c["s"]) & F.coalesce(F.get(starting, i) >= c["e"], F.lit(True))),
                ),
            ),
        )

    def build(body: Column) -> Column:
        parts = [described(kind, base_matches(body, kind), None) for kind in KINDS]
        loose = [described(kind, _where(body.rlike(LOOSE_NEEDS[kind]), located(body, LOOSE[kind])), F.lit(False)) for kind in LOOSE]
        return let(
            F.sort_array(F.concat(*parts, *loose)),
            lambda every: F.when(F.size(every) < 2, every).when(F.forall(every, lambda c: c["base"]), every).otherwise(apart(every)),
        )

    return let(text, build)


def _pattern(c: Column) -> Column:
    return F.concat_ws("|", c["k"].cast("string"), *[c[v].cast("int").cast("string") for v in LABELERS], c["shape"])


def estimate(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability of personal data by pattern, from counts of patterns: kind, votes of LABELERS and shape, parted by ``|``.

    EM over two classes with labelers independent within a class; then logistic regression on votes
    and shape with the posteriors as soft targets.
    """
    out: dict[str, float] = {}
    for kind in sorted({p.split("|")[0] for p in counts}):
        own = sorted(p for p in counts if p.split("|")[0] == kind)
        votes = [[int(x) for x in p.split("|")[1:-1]] for p in own]
        weight = [float(counts[p]) for p in own]
        hit, miss, prior = list(HIT), list(MISS), 0.5
        post = [0.5] * len(own)
        for _ in range(rounds):
            for i, v in enumerate(votes):
                yes, no = prior, 1 - prior
                for x, a, b in zip(v, hit, miss):
                    yes, no = yes * (a if x else 1 - a), no * (b if x else 1 - b)
                post[i] = yes / (yes + no)
            # the starting reliabilities stay as ten pseudo-spans a class, which also fixes which class is which
            total_yes = sum(w * q for w, q in zip(weight, post)) + 10
            total_no = sum(w * (1 - q) for w, q in zip(weight, post)) + 10
            hit = [(10 * s + sum(w * q * v[j] for w, q, v in zip(weight, post, votes))) / total_yes for j, s in enumerate(HIT)]
            miss = [(10 * s + sum(w * (1 - q) * v[j] for w, q, v in zip(weight, post, votes))) / total_no for j, s in enumerate(MISS)]
            prior = min(max(total_yes / (total_yes + total_no), 0.01), 0.99)
        shapes = sorted({p.split("|")[-1] for p in own})
        rows = [[1.0, *v, *[float(p.split("|")[-1] == s) for s in shapes]] for p, v in zip(own, votes)]
        theta = [0.0] * len(rows[0])
        scale = sum(weight)
        for _ in range(400):
            grad = [0.02 * t for t in theta]
            for row, w, q in zip(rows, weight, post):
                err = w / scale * (1 / (1 + math.exp(-sum(a * b for a, b in zip(theta, row)))) - q)
                grad = [g + err * x for g, x in zip(grad, row)]
            theta = [t - 1.5 * g for t, g in zip(theta, grad)]
        for p, row in zip(own, rows):
            out[p] = 1 / (1 + math.exp(-sum(a * b for a, b in zip(theta, row))))
    return out


def span_model(found: DataFrame, column: str = "__c") -> dict[str, float]:
    """Counts of patterns over all candidates (combined before the shuffle; a few hundred rows) and their model."""
    rows = found.select(F.explode(column).alias("c")).groupBy(_pattern(F.col("c")).alias("p")).count().collect()
    return estimate({r["p"]: r["count"] for r in rows})


def accepted(cands: Column, model: dict[str, float], threshold: float = 0.8) -> Column:
    """Base spans, and others that pass their check, that the model accepts and that context or gazetteer support; sorted structs (s, k, e)."""
    good = sorted(p for p, q in model.items() if q >= threshold)
    added = (lambda c: c["check"] & (c["context"] | c["known"]) & _pattern(c).isin(good)) if good else (lambda c: F.lit(False))
    kept = F.filter(cands, lambda c: c["base"] | added(c))
    spans = F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e")))
    return let(spans, lambda x: F.filter(x, lambda v, i: ~F.coalesce(F.get(x, i - F.lit(1)) == v, F.lit(False))))  # candidates are sorted


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or each chain of overlapping spans, replaced by the kind in brackets."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])

    def joined(cut) -> Column:
        """Pieces before the first span of each chain, marks, and what follows the last; ``cut(from, to)`` gives a piece."""
        return let(
            F.transform(_over_earlier(F.transform(spans, lambda x: x["e"]), F.array_max, F.greatest), lambda e: F.coalesce(e, F.lit(0))),
            lambda at: F.concat(
                F.array_join(
                    F.transform(
                        spans, lambda x, i: F.when(x["s"] >= F.get(at, i), F.concat(cut(F.get(at, i), x["s"]), F.get(marks, x["k"]))).otherwise(F.lit(""))
                    ),
                    "",
                ),
                cut(F.array_max(F.transform(spans, lambda x: x["e"])), F.length(text)),
            ),
        )

    few = joined(lambda a, b: F.substring(text, a + F.lit(1), b - a))
    # a substring is counted off from the start of the text; for many, characters are parted once
    many = let(F.split(text, "", -1), lambda chars: joined(lambda a, b: F.array_join(F.slice(chars, a + F.lit(1), F.greatest(b - a, F.lit(0))), "")))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) <= 50, few).otherwise(many)


def find_candidates(docs: DataFrame, text: str = "text", column: str = "__c") -> DataFrame:
    return docs.withColumn(column, candidates(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def redact_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null."""
    model = span_model(find_candidates(docs.select(text), text))
    found = find_candidates(docs, text).withColumn("__s", accepted(F.col("__c"), model))
    return found.withColumn(text, redacted(F.col(text).cast("string"), F.col("__s"))).select(*docs.columns)


def _of_kind(number: int):
    return lambda c: c["k"] == number


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(find_candidates(docs).select("doc_id", "__c"), "pii-candidates")
    model = span_model(found)
    base = F.filter("__c", lambda c: c["base"])
    own = F.array_sort(F.transform(base, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    counts = [F.size(F.filter(base, _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    every = found.withColumn("__a", accepted(F.col("__c"), model))
    secrets = F.size(F.filter("__a", _of_kind(len(KINDS)))).cast("long").alias("n_secret")
    return every.select("doc_id", *counts, F.sha2(span_text(own), 256).alias("base_sha256"), span_text(F.col("__a")).alias("spans"), secrets)
