"""Column expressions over the wide node row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c


def low(name: str, most: int | None = None) -> Column:
    x = F.coalesce(F.lower(F.col(name)), F.lit(""))
    return x if most is None else F.substring(x, 1, most)


def node_key() -> Column:
    """The natural key: type and the lower-cased fields that tell nodes of the type apart."""
    k = lambda prefix, *parts: F.concat_ws("::", F.lit(prefix), *parts)
    return (
        F.when(F.col("type") == "DEFINITION", k("DEF", low("term")))
        .when(F.col("type") == "OBLIGATION", k("OBL", low("party"), low("action", 80)))
        .when(F.col("type") == "RIGHT", k("RIG", low("party"), low("right_text", 80)))
        .when(F.col("type") == "NUMERIC", k("NUM", F.coalesce("value", F.lit("")), low("unit"), low("applies_to", 60)))
        .when(F.col("type") == "CONDITION", k("CON", low("trigger", 60), low("consequence", 60)))
        .when(F.col("type") == "BLANK", k("BLK", low("field")))
        .when(F.col("type") == "REFERENCE", k("REF", low("ref_to")))
    )


def joined(*names: str) -> Column:
    """Lower-cased fields with spaces between, without empty ones."""
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(n), F.lit("")) for n in names]))


def all_text() -> Column:
    """Every text of a node, as edges look for terms in it."""
    return joined("source_text", "term", "definition", "party", "modal", "action", "right_text", "value", "unit", "applies_to", "trigger", "consequence")


def check_text() -> Column:
    return joined("source_text", "action", "right_text", "definition", "trigger", "consequence", "applies_to", "term")


def concept_text() -> Column:
    return joined("source_text", "action", "right_text", "term", "definition", "trigger", "consequence", "applies_to")


def key_text() -> Column:
    """The fields that a slot's subject is compared with."""
    both = lambda *n: F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit("")) for x in n])
    return (
        F.when(F.col("type") == "NUMERIC", both("value", "unit", "applies_to", "trigger"))
        .when(F.col("type") == "DEFINITION", both("term", "definition"))
        .when(F.col("type") == "OBLIGATION", both("party", "action"))
        .when(F.col("type") == "RIGHT", both("party", "right_text"))
        .when(F.col("type") == "CONDITION", both("trigger", "consequence"))
        .when(F.col("type") == "REFERENCE", both("ref_to", "describes"))
        .otherwise(F.substring(F.coalesce("source_text", F.lit("")), 1, 100))
    )


def search_text() -> Column:
    """A node put as question and answer, so that it lies near the questions that it answers."""
    opt = lambda before, name, after="": F.when(F.coalesce(F.length(name), F.lit(0)) > 0, F.concat(F.lit(before), F.col(name), F.lit(after))).otherwise("")
    f = lambda n: F.coalesce(F.col(n), F.lit(""))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    must = F.trim(say(f("modal"), " ", f("action"), opt(" if ", "condition"), opt(" (", "qualifiers", ")")))
    may = F.trim(say(f("right_text"), opt(" limited to ", "limit_text"), opt(" if ", "condition"), opt(" (", "qualifiers", ")")))
    return (
        F.when(F.col("type") == "DEFINITION", say("What does ", f("term"), " mean? ", f("term"), " means ", f("definition")))
        .when(F.col("type") == "OBLIGATION", say("What must ", f("party"), " do? ", f("party"), " ", must))
        .when(F.col("type") == "RIGHT", say("Can ", f("party"), " ", may, "? ", f("party"), " may ", may))
        .when(F.col("type") == "NUMERIC", say("What is the ", f("applies_to"), "?", opt(" when ", "trigger"), " ", f("applies_to"), ": ", F.trim(say(f("value"), " ", f("unit")))))
        .when(F.col("type") == "CONDITION", say("What happens if ", f("trigger"), "? If ", f("trigger"), " then ", opt("", "party", " "), f("consequence")))
        .when(F.col("type") == "BLANK", say("What is the ", f("field"), "? ", f("field"), " ", f("context"), " is blank unfilled"))
        .when(F.col("type") == "REFERENCE", say("reference to ", f("ref_to"), " which describes ", f("describes")))
        .otherwise(f("source_text"))
    )


#: Modals that forbid.
NEGATIVE = ("cannot", "can not", "shall not", "may not", "will not", "must not", "need not", "not", "no", "never")


def is_negative() -> Column:
    modal = F.trim(low("modal"))
    return modal.isin(*NEGATIVE) | F.contains(modal, F.lit("not")) | modal.startswith("no ") | F.contains(low("party"), F.lit("neither")) | low("action").startswith("not ") | low("action").startswith("no ")


def specificity() -> Column:
    """How concrete an answer of this node is."""
    long = lambda n: F.length(F.coalesce(F.col(n), F.lit(""))) > 20
    t = F.col("type")
    return (
        F.when(t == "BLANK", 0.0).when(t == "NUMERIC", 1.0).when(t == "REFERENCE", 0.75)
        .when(t == "DEFINITION", F.when(long("definition"), 1.0).otherwise(0.65))
        .when((t == "OBLIGATION") & is_negative(), 0.70)
        .when(t == "OBLIGATION", F.when(long("action"), 1.0).otherwise(0.80))
        .when(t == "RIGHT", F.when(long("right_text"), 1.0).otherwise(0.80))
        .when(t == "CONDITION", F.when(long("consequence"), 1.0).otherwise(0.80))
        .otherwise(0.80)
    )


def has(names: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & (F.coalesce(F.trim(c(n)), F.lit("")) != "")
    return test
