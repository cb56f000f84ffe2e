"""Personal data in texts, by DataFrame functions alone.

Each kind has a pattern that proposes spans, a rule that confirms them (number
ranges, counts of digits, Luhn, mod-97) and words which, close before a span,
raise its score.  Places of matches follow from the text between them: the
pieces that ``split`` leaves and the matches that ``regexp_extract_all`` gives
alternate, so a running sum of their lengths is every start and end, in code
points.

The patterns run in time linear in the text.  Where a pattern begins with a
run of characters, it may begin only at the start of that run or where the
previous match ended, and the run is possessive: the leftmost match of the
plain pattern begins there too, and no start inside the run can do better.

Defined cases: null text is empty and has no spans; a kind without spans counts
0; equal rows are each answered; an empty table gives no rows; ties in start
are ordered by the kinds' order below; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import PART, let, placed
from .shared import id_and_text


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap sign without which a text has no match; the pattern then doesn't run.
    sign: str
    pattern: str
    #: Patterns of words nearby, the score without and with them.
    context: str
    score: tuple[float, float]
    base: bool = True


# The kinds in their order, the first four with the patterns that the results are defined by.
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"e-?mail|contact|write|correo|courriel", (0.9, 1.0)),
    Kind("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"\bip\b|address|host|server|login", (0.6, 0.9)),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", r"card|visa|master|credit|karte|carte|tarjeta", (0.7, 1.0)),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", r"phone|call|tel|mobil|fax", (0.6, 0.9)),
    # The method's own: bank account numbers (mod-97) and numbers that only their neighbourhood makes personal.
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"iban|bank|account|konto|compte|cuenta", (0.8, 1.0), base=False),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"ssn|social security|tax id", (0.4, 0.9), base=False),
)
#: Code points before a span in which context words count.
NEARBY = 40
#: Method spans below this score are left out; base spans stay.
LEAST_SCORE = 0.5
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "struct<start:bigint,end:bigint,rank:int,kind:string,score:double>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second from the right doubled, digit sums summed, divisible by 10."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: _doubled(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _doubled(x: Column, twice: Column) -> Column:
    return F.when(twice, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)


def mod97(account: Column) -> Column:
    """Whether an account number passes: country and check digits moved behind, letters as 10 to 35, remainder 1."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
    step = lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0), step) == 1)


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of a kind, ascending."""
    good = F.filter(placed(text, kind.pattern), lambda s: _confirmed(kind.name, s["match"]))

    def scored(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - NEARBY, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(NEARBY)).cast("int"))
        score = F.when(F.lower(before).rlike(kind.context), kind.score[1]).otherwise(kind.score[0])
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), score.alias("score"))

    out = F.transform(good, scored)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)


def _ordered(spans: Column) -> Column:
    """By start, then by the kinds' order."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["score"].alias("score")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null) and ``found``: all spans, ascending by start, then by kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    out = id_and_text(docs).withColumn("text", text)
    for rank, kind in enumerate(KINDS):
        sign = F.contains(F.col("text"), F.lit(kind.sign)) if kind.sign else F.col("text").rlike("[0-9]")
        out = out.withColumn(f"_{kind.name}", F.when(sign, _spans(F.col("text"), kind, rank)).otherwise(none))
    return out.select("doc_id", "text", _ordered(F.concat(*[F.col(f"_{k.name}") for k in KINDS])).alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(rank: int) -> Column:
    return F.filter(F.col("found"), lambda s: s["rank"] == rank)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans with their scores."""
    base = F.filter(F.col("found"), lambda s: s["rank"] < sum(k.base for k in KINDS))
    counts = [F.size(_of(rank)).cast("long").alias(f"n_{k.name}") for rank, k in enumerate(KINDS) if k.base]
    scores = F.transform(F.col("found"), lambda s: s["score"])
    return find(docs).select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), scores.alias("scores"))


def masked(text: Column, found: Column) -> Column:
    """The text with its spans replaced by their kind in brackets; spans that overlap or lie in each other go as one, named by the first."""
    zero = F.struct(F.lit(-1).cast("long").alias("end"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        last = F.element_at(state["out"], -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["rank"].alias("rank"), last["kind"].alias("kind"), last["score"].alias("score"))
        size = F.size(state["out"])
        joined = F.struct(longer["end"].alias("end"), F.concat(F.slice(state["out"], F.lit(1), size - 1), F.array(longer)).alias("out"))
        return F.when(s["start"] < state["end"], joined).otherwise(F.struct(s["end"].alias("end"), F.concat(state["out"], F.array(s)).alias("out")))

    def write(spans: Column) -> Column:
        n = F.size(spans)
        end = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.get(spans, i)["end"])
        cut = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))

        def part(c: Column) -> Column:
            """PART spans with the text before each: a place is looked for in their stretch, not in the whole text."""
            first, last = c * PART, F.least(c * PART + PART, n) - 1

            def one(base: Column) -> Column:
                each = lambda chunk: F.array_join(F.transform(F.sequence(first, last), lambda i: F.concat(cut(chunk, end(i - 1) - base, F.get(spans, i)["start"] - base), F.lit("["), F.upper(F.get(spans, i)["kind"]), F.lit("]"))), "")
                return let(cut(text, base, end(last)), each)

            return let(end(first - 1), one)

        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int")), part)
        return F.concat(F.array_join(parts, ""), F.substr(text, (end(n - 1) + 1).cast("int")))

    return let(F.aggregate(found, zero, step, lambda s: s["out"]), write)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked.  All rows and columns stay; n_chars follows the text where there is one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    out, names = docs, docs.columns
    for rank, kind in enumerate(KINDS):
        sign = F.contains(text, F.lit(kind.sign)) if kind.sign else text.rlike("[0-9]")
        out = out.withColumn(f"__pii_{kind.name}", F.when(sign, _spans(text, kind, rank)).otherwise(none))
    out = out.withColumn("__pii", _ordered(F.concat(*[F.col(f"__pii_{k.name}") for k in KINDS])))
    new = F.when(F.size("__pii") > 0, masked(F.col("text"), F.col("__pii"))).otherwise(F.col("text"))
    out = out.withColumn("text", new)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("__pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*names)
