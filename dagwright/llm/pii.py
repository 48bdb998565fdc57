"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Positions come from splitting a text at a pattern: the matches and the
parts between them, in order, add up to code-point offsets. Quantifiers are possessive where giving
back could never help, so that no run of characters is tried from each of its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word boundaries in ASCII.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Characters of an account number by country (fixed values of the published registry).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def iban_pattern() -> str:
    """Countries of one length together, each with two check digits and as many letters or digits as it has."""
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS.split():
        by_length.setdefault(int(x[2:]), []).append(x[:2])
    return "(?:" + "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())) + ")"


#: Kinds, in the order in which spans that start together are listed.
#: An email begins where a run of its first class begins or the last match ended; a card chain of fewer than
#: 12 digits would be dropped anyway.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": BEFORE + iban_pattern() + AFTER,
    "ssn": BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + AFTER,
}
BASE = ("email", "ip", "card", "phone")
#: Score of a confirmed match, and what a context word within NEAR code points before it adds. Spans under
#: THRESHOLD go, except those of BASE.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
BONUS, THRESHOLD, NEAR = 0.3, 0.5, 40
CONTEXT = {
    "email": "e-?mail|contact|write|reach",
    "ip": "ip|address|host|server",
    "card": "card|visa|mastercard|amex|credit|pay",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto",
    "ssn": "ssn|social|security",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def confirmed(kind: str, x: Column) -> Column:
    """Whether a match passes its kind's checks."""
    d = F.regexp_replace(x, "[^0-9]", "")
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(d).between(12, 19) & F.call_function("luhn_check", F.when(F.length(d) <= 19, d).otherwise("1"))
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(x, F.lit(" "), F.lit(""))) == 1
    return F.lit(True)


def mod97(x: Column) -> Column:
    """An account number, its first four characters moved to the end and letters read as 10 to 35, modulo 97."""

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", rest).when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(F.concat(x.substr(F.lit(5), F.length(x)), x.substr(1, 4)), ""), F.lit(0), add)


def may_match(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    sign = {"email": "@", "phone": "+", "ssn": "-", "ip": "."}.get(kind)
    return F.contains(text, F.lit(sign)) if sign else F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    pattern = F.lit(PATTERNS[kind])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, n: int, x: string>>").alias("out"))

    def add(acc: Column, z: Column) -> Column:
        begin, n = acc["at"] + F.length(z["part"]), F.length(z["x"])
        return F.struct((begin + n).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), n.alias("n"), z["x"].alias("x")))).alias("out"))

    def located(found: Column) -> Column:
        parts = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found))
        return F.aggregate(F.arrays_zip(parts.alias("part"), found.alias("x")), start, add, lambda acc: acc["out"])

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR)))
        near = before.rlike(f"(?i){BEFORE}(?:{CONTEXT[kind]}){AFTER}")
        return F.struct(s["start"].alias("start"), F.lit(list(PATTERNS).index(kind)).alias("rank"), F.lit(kind).alias("kind"), (s["start"] + s["n"]).alias("end"), F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, F.lit(BONUS)).otherwise(0.0)).alias("score"))

    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int, score: double>>")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # transform over one element binds the matches, so that a text without any is never split
    each = F.transform(F.array(found), lambda x: F.when(F.exists(x, lambda m: confirmed(kind, m)), F.transform(F.filter(located(x), lambda s: confirmed(kind, s["x"])), scored)).otherwise(none))[0]
    got = F.when(may_match(kind, text), each).otherwise(none)
    return got if kind in BASE or SCORES[kind] >= THRESHOLD else F.filter(got, lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `spans`, an array of (start, rank, kind, end, score) by start and kind, to the columns of docs.

    Offsets are code points, end exclusive. Matches of a kind are leftmost and do not overlap; one that
    fails its checksum goes and is not tried again at another length; an account number has the length of its country. Spans of different kinds may
    overlap. A null or empty text has no spans; an existing column `spans` is replaced.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    numeric = [k for k in PATTERNS if k != "email"]
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int, score: double>>")
    found = F.concat(spans_of("email", content), F.when(content.rlike("[0-9]"), F.concat(*[spans_of(k, content) for k in numeric])).otherwise(none))
    return docs.withColumn("spans", F.array_sort(found))


def masked(text: Column, spans: Column) -> Column:
    """The text with `<kind>` for each span; one that begins in an earlier span adds nothing."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))))
