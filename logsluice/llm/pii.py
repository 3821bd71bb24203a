"""Personal data in texts, by Spark expressions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for account
numbers) and words near a span move its score. Each row is judged by itself: nothing is shuffled,
and the work grows with the length of the text (n log n in the number of its spans).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on each side of a span that are looked at for context words.
NEAR = 60
#: An added span needs this score.
LEAST = 0.5
RAISE, LOWER = 0.3, 0.3
#: Words that speak against personal data of any kind.
AGAINST = "isbn|issn|version|serial|invoice|order|tracking|example|build|release"

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column) -> Column:
    """Sums up to and including each element of an array of long, by doubling steps: an
    accumulator that is copied for each element would cost the square of its length."""
    doublings = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(2)))).cast("int")
    steps = F.transform(F.sequence(F.lit(0), doublings - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(
        steps, lengths, lambda sums, step: F.transform(sums, lambda x, i: x + F.when(i >= step, F.get(sums, i - step)).otherwise(F.lit(0).cast("long")))
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for a text of digits with a right Luhn check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True for an account number whose first four characters moved to the end leave 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        return F.when(letter, rest * 100 + F.ascii(c) - 55).otherwise(rest * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add) == 1


def _no_check(value: Column) -> Column:
    return F.lit(True)


def _card(value: Column) -> Column:
    return let(digits(value), lambda d: F.length(d).between(14, 19) & luhn(d))


def _phone(value: Column) -> Column:
    return F.length(digits(value)).between(10, 15)


def _ip(value: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    # A possessive run of zeros would eat a part that is 0.
    part = f"(?:{part}|0++)"
    return value.rlike(rf"\A{part}(?:\.{part}){{3}}\z")


def _account(value: Column) -> Column:
    return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & mod97(value)


def _local_phone(value: Column) -> Column:
    return F.length(digits(value)).between(7, 15)


@dataclass(frozen=True)
class Kind:
    """How spans of one kind are proposed, confirmed and scored.

    ``hint`` is a text without which there is no match. ``base`` kinds are kept whatever their score.
    A match that fails its check is tried once more without its end that matches ``loose``.
    """

    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    words: str
    hint: str = ""
    base: bool = False
    loose: str = ""


# Runs are possessive and begin at the start of a run or where the last match ended: the same
# matches as from the plain form, but a long run without a match is read once, not once a start.
_RUN = r"(?:\G|(?<![{0}]))[{0}]"
KINDS: tuple[Kind, ...] = (
    Kind("email", _RUN.format("A-Za-z0-9._%+-") + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _no_check, 0.8, "e-?mail|mail|correo|courriel|contact|write", "@", True),
    Kind("ip", _RUN.format("0-9") + r"++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, "ip|host|server|address|adresse|login|client", ".", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.7, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment", "", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, "phone|tel|telefon|teléfono|téléphone|call|mobile|fax|reach", "+", True),
    Kind("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])", _account, 0.9, "iban|account|bank|konto|compte|cuenta", loose=r"\x20[A-Z0-9]{1,3}\z"),
    Kind("social", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", _no_check, 0.4, "ssn|social|security|insurance|taxpayer", "-"),
    Kind("local_phone", r"(?<![0-9A-Za-z.+()-])(?<!\+[0-9]{1,3}[\x20-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){0,3}+(?![0-9])", _local_phone, 0.3, "phone|tel|telefon|teléfono|téléphone|call|mobile|fax|reach"),
    Kind("spelled_email", _RUN.format("A-Za-z0-9._%+-") + r"++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(](?i:dot)[\])]|\.)\x20?[A-Za-z0-9-]++)++", _no_check, 0.7, "e-?mail|mail|correo|courriel|contact|write"),
)
RANK = {k.name: i for i, k in enumerate(KINDS)}
BASE = tuple(k.name for k in KINDS if k.base)


def score_of(kind: Kind, near: Column) -> Column:
    """Score of a confirmed span between 0 and 1, by the words near it."""
    for_it = F.when(near.rlike(rf"(?iU)\b(?:{kind.words})\b"), RAISE).otherwise(0.0)
    against = F.when(near.rlike(rf"(?iU)\b(?:{AGAINST})\b"), LOWER).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + for_it - against)), 2)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order: places are code points, ``end`` is exclusive.

    Context comes from the text between a span and its neighbours of the kind, so that no place
    of a long text has to be looked up from its start.
    """
    none = F.array().cast(SPAN)

    def place(found: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0)).cast("long"))

        def span(m: Column, i: Column, at: Column) -> Column:
            near = F.concat(F.right(F.get(pieces, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(pieces, i + 1), F.lit(NEAR)))
            start = F.get(at, i)
            value = F.when(kind.check(m), m)
            if kind.loose:
                value = F.coalesce(value, let(F.regexp_replace(m, kind.loose, ""), lambda v: F.when(kind.check(v), v)))
            score = F.when(value.isNotNull(), score_of(kind, near))
            return F.struct(start.alias("start"), F.lit(RANK[kind.name]).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(value)).alias("end"), score.alias("score"), value.alias("value"))

        spans = let(running(steps), lambda at: F.transform(found, lambda m, i: span(m, i, at)))
        return F.filter(spans, lambda s: s["score"] >= (0.0 if kind.base else LEAST)).cast(SPAN)

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    spans = let(found, lambda f: F.when(F.size(f) > 0, let(F.split(text, kind.pattern, -1), lambda p: place(f, p))).otherwise(none))
    return F.when(F.contains(text, F.lit(kind.hint)), spans).otherwise(none) if kind.hint else spans


def settled(spans: Column) -> Column:
    """Ordered spans without the added ones that overlap the span before or after them, where that
    one is a base span or has a higher score (the earlier one, where scores are equal)."""

    def stays(s: Column, i: Column, all_spans: Column) -> Column:
        before, after = F.get(all_spans, i - 1), F.get(all_spans, i + 1)
        base = len(BASE)
        lost = (before["end"] > s["start"]) & ((before["rank"] < base) | (before["score"] >= s["score"]))
        lost_after = (after["start"] < s["end"]) & ((after["rank"] < base) | (after["score"] > s["score"]))
        return (s["rank"] < base) | ~(F.coalesce(lost, F.lit(False)) | F.coalesce(lost_after, F.lit(False)))

    return let(spans, lambda a: F.filter(a, lambda s, i: stays(s, i, a)))


def with_personal(docs: DataFrame, text: str = "text", name: str = "personal") -> DataFrame:
    """docs with an array of the spans of personal data in the whole text, by start and kind.

    Each span has start, rank and kind, end, score, value. Null and empty texts have none. Spans
    of the base kinds (email, ip, card, phone) are all reported, with their score; those of the
    others need a score of 0.5. A column of that name is replaced.
    """
    # The text may not be looked up in a lambda of a column with a clashing name.
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(name, settled(F.array_sort(F.concat(*(spans_of(source, k) for k in KINDS)))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def found_personal(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the base spans, all spans as text, and their scores.

    Rows that share an id stay rows of their own.
    """
    rows = with_personal(docs.select("doc_id", "text"))
    base = F.filter("personal", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("personal", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("personal")).alias("spans"),
        F.transform("personal", lambda s: s["score"]).alias("scores"),
    )
