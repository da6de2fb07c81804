"""Numbers in words, units and categories, as tables and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENTHS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()
LARGE = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
FRACTIONS = {"half": 0.5, "one-half": 0.5, "one half": 0.5, "third": 1 / 3, "one-third": 1 / 3, "one third": 1 / 3, "two-thirds": 2 / 3, "two thirds": 2 / 3, "quarter": 0.25, "one-quarter": 0.25, "one quarter": 0.25, "three-quarters": 0.75, "three quarters": 0.75}

ORDINAL_VALUES = {w: k + 1 for k, w in enumerate(ORDINALS)} | {w: 20 + 10 * k for k, w in enumerate(TENTHS)} | {"hundredth": 100, "thousandth": 1000}
SMALL = ORDINAL_VALUES | {w: k for k, w in enumerate(ONES)} | {w: 20 + 10 * k for k, w in enumerate(TENS)}

#: Spellings of each unit.
UNITS = {
    "days": ("day", "days", "calendar day", "calendar days"), "business_days": ("business day", "business days"), "weeks": ("week", "weeks"),
    "months": ("month", "months", "calendar month", "calendar months"), "years": ("year", "years", "calendar year", "calendar years"), "hours": ("hour", "hours"),
    "USD": ("dollar", "dollars", "usd"), "cents": ("cent", "cents"), "%": ("percent", "per cent", "percentage"),
    "times": ("time", "times"), "users": ("user", "users"), "copies": ("copy", "copies"), "seats": ("seat", "seats"),
}
UNIT_OF = {raw: unit for unit, spellings in UNITS.items() for raw in spellings}

#: The first category with a keyword in the context is taken.
CATEGORIES = (
    ("notice_period", ("prior written notice", "written notice", "notice of termination", "notify", "days notice", "days' notice", "months notice", "months' notice", "advance notice", "days of notice")),
    ("cure_period", ("cure", "remedy", "remediat", "correct the breach", "cure period")),
    ("late_charge", ("late charge", "late fee", "interest rate", "penalty interest", "overdue interest", "finance charge", "per month", "per annum", "one and one-half", "1.5%", "accrues at")),
    ("termination", ("terminat", "cancel", "wind down", "discontinue")),
    ("renewal", ("renew", "auto-renew", "automatic renewal", "renewal term")),
    ("payment_term", ("payment", "invoice", "pay within", "due within", "net 30", "net 60", "past due", "remittance", "remit", " shall pay", "must pay", "after the end of each quarter", "days after")),
    ("liability_cap", ("liability", "aggregate liability", "maximum liability", "liability cap", "cap on liability", "exceed")),
    ("term_length", ("initial term", "term of", "duration", "subscription term", "agreement term", "term shall", "for a period of")),
    ("threshold", ("threshold", "minimum", "at least", "no less than", "not less than", "floor", "base amount")),
    ("revenue_share", ("revenue share", "revenue split", "share of revenue", "percentage of revenue", "net revenue")),
    ("arbitration", ("arbitrat", "adr", "dispute resolution", "arbitrator")),
    ("audit", ("audit", "inspection", "examination of records")),
    ("confidentiality", ("confidential", "non-disclosure", "nda")),
    ("warranty", ("warrant", "warranty", "guarantee", "representation")),
    ("indemnification", ("indemnif", "hold harmless", "defend")),
    ("discount", ("discount", "reduction", "rebate", "credit")),
    ("impression", ("impression", "page view", "page impression", "pageview")),
    ("user_count", ("registered user", "active user", "authorized user", "user count", "number of users")),
    ("penalty", ("penalty", "liquidated damage", "forfeit")),
    ("percentage", ("%", "percent", "per cent")),
)


def has_any(text: Column, words) -> Column:
    """Whether the text holds one of the words, as they stand."""
    test = F.lit(False)
    for w in words:
        test = test | F.contains(text, F.lit(w))
    return test


def unit(raw: Column | str) -> Column:
    r = F.trim(F.lower(c(raw)))
    table = F.create_map(*[F.lit(x) for pair in UNIT_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, r), r)


def category(context: Column | str) -> Column:
    low = F.lower(c(context))
    found = F.lit("general")
    for name, words in reversed(CATEGORIES):
        found = F.when(has_any(low, words), name).otherwise(found)
    return found


def word_number(phrase: Column | str) -> Column:
    """Value of a number in words (hyphens as spaces); null if it doesn't start with one. Large words multiply what stands before."""
    small = F.create_map(*[F.lit(x) for w, v in SMALL.items() for x in (w, float(v))])
    large = F.create_map(*[F.lit(x) for w, v in LARGE.items() if v > 100 for x in (w, float(v))])
    fractions = F.create_map(*[F.lit(x) for pair in FRACTIONS.items() for x in pair])
    low = F.lower(F.trim(c(phrase)))
    words = F.filter(F.split(low, r"[\s-]+"), lambda w: w != "")

    def step(acc, raw):
        w = F.regexp_replace(raw, "s+$", "")
        value, times = F.try_element_at(small, w), F.try_element_at(large, w)
        state = lambda total, now, ok, going: F.struct(total.alias("total"), now.alias("now"), ok.alias("ok"), going.alias("going"))
        yes = F.lit(True)
        return (
            F.when(~acc["going"], acc)
            .when(value.isNotNull(), state(acc["total"], acc["now"] + value, yes, yes))
            .when(w == "hundred", state(acc["total"], acc["now"] * 100, yes, yes))
            .when(times.isNotNull(), state(acc["total"] + F.when(acc["now"] == 0, F.lit(1.0)).otherwise(acc["now"]) * times, F.lit(0.0), yes, yes))
            .when(w.isin("and", "a", "an"), acc)
            .otherwise(state(acc["total"], acc["now"], acc["ok"], F.lit(False)))
        )

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"), F.lit(False).alias("ok"), F.lit(True).alias("going"))
    folded = F.aggregate(words, start, step, lambda a: F.when(a["ok"], a["total"] + a["now"]))
    return F.coalesce(F.try_element_at(fractions, low), folded)
