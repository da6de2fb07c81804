"""What a question asks for, from its words: kind, keywords, flags, intent scores, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layers import Layer, apply, clip, has, when
from .text import c

# Words that tell kinds of questions.
DEFINITION_VERBS = ("define", "defined", "mean", "means", "refer", "refers", "constitute", "constitutes", "include", "includes", "consist", "encompasses")
DUTY_VERBS = ("must", "shall", "required", "obligat", "duty", "permitted", "may not", "cannot", "prohibited", "responsible", "liable", "comply", "ensure", "maintain", "provide", "notify", "indemnify", "pay", "reimburse")
PARTIES = ("wipro", "licensee", "licensor", "customer", "vendor", "supplier", "provider", "client", "user", "party", "parties")
GENERIC = (
    "information", "agreement", "parties", "between", "either", "whether", "section", "within", "before", "another", "having", "making", "during", "following", "applicable",
    "pursuant", "confidential", "obligations", "required", "related", "receiving", "disclosing", "includes", "provided", "provide", "requires", "written", "notice",
    "manner", "business", "described", "document", "executed", "certain", "herein", "therein", "thereof", "company", "person", "entity", "service", "services",
)
STARTERS = r"(?i)^(can |does |do |is |are |has |have |did |was |were |will |would |could |should |may |shall |must |ought |need )"

# Words behind each flag; a question is lower-cased and trimmed.
WORDS = {
    "exact": (" exact ", " exactly ", " specific ", " precisely ", " detailed "),
    "date": (" date", "when ", " end date", "start date", "effective date", "term end"),
    "name": (" name of", " agreement name", "title of", "called ", "what is the name"),
    "list": (" list ", " which ", " what are ", " all ", " each ", " every "),
    "value": (" value", " amount", " total", " market share", " percentage", " price", " fee", "minutes", "share"),
    "percent": (" percent", " percentage", "%", "share"),
    "yesno": (" do ", " does ", " is ", " are ", " can ", " may ", " must ", " shall "),
    "definition": (" define ", " definition", " means ", " refer to as", " referred to as"),
    "exhibit": (" exhibit ", " schedule ", " appendix ", " annex "),
    "report": (" report", " reports", " statement", " filing", " disclosure"),
    "contents": (" contents", " contain", " included", " include", " listed", " stations"),
    "internal": ("emails", "email", "communications", "internal", "negotiation", "discussion", "strategy", "confidential"),
    "future": (" will ", " future", " going forward", " in the future", " would ", " could ", " might "),
    "opinion": (" opinion", " think", " likely", " expect", " success", " best", " should"),
    "hypothesis": (" if ", " hypothetic", " suppose", " assume", " post-renegotiation", "renegotiation"),
    "event": (" occurred", " happened", " already", " previous", " past ", " disputes", " lawsuits", " legal cases"),
    "instance": ("this customer", "specific customer", "this agreement instance", "this account", "authorized purchaser", "order form", "legal name", "start date", "minimum commitment", "discount", "workspace id", "organizational id"),
    "external": ("pricing page", "dpa", "data processing addendum", "security measures", "service-specific terms", "service specific terms", "subprocessor", "sub-processors", "supported countries", "territories list", "healthcare addendum", "audit reports", "external document", "appendix", "annex"),
    "external_contents": ("full text", "exact obligations", "exact terms", "exact language", "contents of", "what is in", "what are in", "listed in", "inside the", "in the full", "full dpa"),
}
PLAN = ("plan", "planned", "planning", "roadmap", "next year", "next quarter", "forecast", "projected")
OFFICERS = ("current ceo", "current president", "current chairman", "current founder", "current cto", "current coo", "current cfo", "who is the ceo", "who is the president", "who is the chairman", "who is the founder")
DOCUMENTS = (
    ("dpa", ("dpa", "data processing addendum")), ("security_measures", ("security measures",)), ("pricing_page", ("pricing page",)), ("service_specific_terms", ("service-specific terms", "service specific terms")),
    ("healthcare_addendum", ("healthcare addendum",)), ("audit_reports", ("audit report", "audit reports")), ("supported_countries", ("supported countries", "territories list")), ("order_form", ("order form",)),
    ("exhibit", ("exhibit",)), ("schedule", ("schedule",)), ("appendix", ("appendix",)), ("annex", ("annex",)),
)

_RULE_SLOT = "(slot IN ('REQUIREMENT', 'PERMISSION', 'CONSEQUENCE'))"


def _sum(*terms: tuple[str, float]) -> str:
    return clip(" + ".join(when(test, w) for test, w in terms))


FLAGS: Layer = {"q": "trim(lower(question))"}
ASKS: Layer = {f"asks_{name}": has(*words) for name, words in WORDS.items()}
FORM: Layer = {"simple_extract": _sum(("asks_date", 0.35), ("asks_percent", 0.25), ("asks_yesno", 0.20), (_RULE_SLOT, 0.15), ("asks_name", 0.15))}
SCORES: Layer = {
    "exact_intent": clip(" + ".join(when(t, w) for t, w in (("asks_exact", 0.18), ("asks_exhibit", 0.32), ("asks_report", 0.24), ("asks_contents AND asks_list", 0.22), (has("market share"), 0.30), (has("total value", "exact value"), 0.28), ("asks_internal", 0.26), ("slot = 'VALUE'", 0.10))) + " - 0.45 * simple_extract"),
    "speculative": _sum(
        ("asks_future", 0.55), (has(*PLAN), 0.40), (has("update", "updates", "change", "changes", "modify", "modifications") + " AND " + has("plan", "planned", "planning", "future", "next year", "next quarter"), 0.20),
        ("asks_opinion", 0.35), ("asks_hypothesis", 0.30), ("asks_event AND asks_future", 0.20), (has("next month", "next week", "next day", "next quarter") + " AND asks_future", 0.40),
        (has("if it fails", "if it doesn't", "if they fail", "if he fails", "if she fails"), 0.45), ("substring(q, 1, 10) = 'what will ' AND asks_future AND " + has("if ", "when "), 0.35),
    ),
    "outside_document": _sum(("asks_internal", 0.45), (has("unwritten", "not written", "off the record", "oral", "confidential"), 0.40), (has("replacement technology", "new technology", "future renegotiation", "post-renegotiation"), 0.30), (has(*OFFICERS), 0.70)),
    "missing_artifact": _sum(("asks_exhibit", 0.70), ("asks_report", 0.45), ("asks_contents", 0.20)),
    "instance_missing": _sum(("asks_instance", 0.55), (has("this customer", "specific customer", "this account", "authorized purchaser", "order form"), 0.25), ("asks_date OR asks_name OR asks_value OR asks_percent", 0.15), ("asks_exact", 0.10)),
    "external_reference": _sum(("asks_external", 0.55), ("asks_contents", 0.20), ("asks_exact OR asks_list", 0.10), ("asks_exhibit OR asks_report", 0.15)),
    "expects_rule": clip(" + ".join(when(t, w) for t, w in (("asks_yesno", 0.45), (_RULE_SLOT, 0.35), (has("must ", " shall ", " may ", " may not", " allowed", " not allowed", " required to", " liable if", "without "), 0.25))) + " - " + when("asks_external OR asks_exhibit OR asks_report", 0.20)),
    "external_doc": "CASE " + " ".join(f"WHEN {has(*words)} THEN '{name}'" for name, words in DOCUMENTS) + " WHEN asks_external THEN 'other' ELSE 'none' END",
}


def _one_of(votes: tuple[tuple[str, str], ...], none: str) -> str:
    """The only kind that some test votes for; mixed if there are more."""
    by: dict[str, list[str]] = {}
    for kind, test in votes:
        by.setdefault(kind, []).append(test)
    count = " + ".join(f"CASE WHEN {' OR '.join(t)} THEN 1 ELSE 0 END" for t in by.values())
    return f"CASE WHEN {count} > 1 THEN 'mixed' " + " ".join(f"WHEN {' OR '.join(t)} THEN '{k}'" for k, t in by.items()) + f" ELSE {none} END"


KINDS: Layer = {
    "outside_needed": clip("0.55 * external_reference + 0.35 * missing_artifact + " + when("asks_external_contents", 0.10)),
    "answer_form": _one_of((("yes_no", "asks_yesno"), ("date", "asks_date"), ("percent", "asks_percent"), ("number", "asks_value"), ("name", "asks_name"), ("list", "asks_list"), ("list", "asks_contents"), ("clause_text", "asks_definition")), "'clause_text'"),
    "proof": _one_of((("external_artifact_contents", "asks_external"), ("external_artifact_contents", "asks_exhibit"), ("external_artifact_contents", "asks_report"), ("customer_instance_field", "asks_instance"), ("definition", "asks_definition"), ("enumeration", "asks_list"), ("enumeration", "asks_contents"), ("exact_value", "asks_date"), ("exact_value", "asks_value"), ("exact_value", "asks_percent"), ("exact_value", "asks_name"), ("direct_rule_clause", "asks_yesno"), ("direct_rule_clause", _RULE_SLOT)), "'mixed'"),
}
INTENT = [FLAGS, ASKS, FORM, SCORES, KINDS]


def intent(questions: DataFrame) -> DataFrame:
    """Questions (question, slot) with all flags, scores and kinds."""
    return apply(questions, INTENT)


def question_type(verb: Column | str, entity: Column | str, obj: Column | str, numeric: Column | str) -> Column:
    """NUMERIC, DEFINITION, OBLIGATION, PARTY_SPECIFIC or GENERAL, from the parsed question."""
    v, e, o = (F.lower(F.coalesce(c(x), F.lit(""))) for x in (verb, entity, obj))
    any_of = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    defines = F.arrays_overlap(F.split(v, r"\W+"), F.array(*map(F.lit, DEFINITION_VERBS))) | F.contains(o, F.lit("definition")) | F.contains(o, F.lit("meaning"))
    return (
        F.when(F.coalesce(c(numeric), F.lit(False)), "NUMERIC").when(defines, "DEFINITION")
        .when((e != "") & any_of(e, PARTIES), F.when(any_of(v, DUTY_VERBS), "OBLIGATION").otherwise("PARTY_SPECIFIC"))
        .when(any_of(v, DUTY_VERBS), "OBLIGATION").otherwise("GENERAL")
    )


def keywords(question: Column | str) -> Column:
    """Quoted words, capitalised phrases and long words that aren't generic, in lower case, distinct."""
    q = c(question)
    found = lambda pattern: F.regexp_extract_all(q, F.lit(pattern), 1)
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    long = F.filter(found(r"\b([a-z]{6,})\b"), lambda w: ~w.isin(*GENERIC))
    return F.array_distinct(F.concat(low(found(r"['\"]([^'\"]{3,})['\"]")), low(found(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")), long))


def is_open(question: Column | str) -> Column:
    return ~F.trim(c(question)).rlike(STARTERS)


# Auxiliaries, modal phrases and prepositions of action phrases.
AUXILIARIES = ("be", "is", "are", "was", "were", "am", "being", "been", "have", "has", "had", "do", "does", "did")
MODALS = ("entitled to ", "allowed to ", "permitted to ", "authorized to ", "required to ", "obligated to ", "able to ", "qualified to ", "not entitled to ", "not allowed to ", "not permitted to ")
PREPOSITIONS = ("to", "from", "for", "of", "about", "on", "in", "into", "with", "at", "by")


def plain_action(action: Column | str) -> Column:
    """The action without leading auxiliaries and one modal phrase."""
    a = F.regexp_replace(F.trim(F.lower(c(action))), r"\s+", " ")
    a = F.regexp_replace(a, rf"^(?:(?:{'|'.join(AUXILIARIES)})(?:\s+|$))+", "")
    return F.trim(F.regexp_replace(a, rf"^(?:{'|'.join(MODALS)})", ""))


def verb_and_object(action: Column | str) -> tuple[Column, Column]:
    words = F.split(plain_action(action), " ")
    skips = (F.size(words) >= 3) & F.get(words, F.lit(1)).isin(*PREPOSITIONS)
    rest = F.when(skips, F.slice(words, F.lit(3), F.size(words))).otherwise(F.slice(words, F.lit(2), F.size(words)))
    return F.get(words, F.lit(0)), F.array_join(rest, " ")


#: Question words behind each slot when the parsed question has no kind of its own.
SLOT_WORDS = {
    "MEANING": ("what is the definition", "what does", "what is a ", "what are the term"),
    "PERMISSION": ("can ", "may ", "allowed", "permitted", "right to", "rights to", "entitled to", "able to", "has the right", "rights granted", "rights of ", "rights does", "rights do ", "right for "),
    "ACTOR": ("who is", "who has", "who can", "who are", "who holds", "which party", "whose", "who provides", "who gives", "who offers"),
    "CONSEQUENCE": ("what happens", "consequences", "what occurs", "what is the result", "what are the penalties", "what are the effects"),
    "REQUIREMENT": ("obligation", "responsibility", "responsible for", "required to", "duties", "restrictions", "prohibited", "not allowed", "not permitted", "what method", "how should", "how must", "how shall"),
}
DEFINING = ("define", "mean", "consist", "include", "refer", "incorporat", "attach", "annex")
DATE_QUESTION = r"(?i)\bwhen\b|\bwhat date\b|\beffective date\b|\bstart date\b|\bend date\b|\bexpir\w*\b|\bcommenc\w*\b|\bbegin\w*\b"
FOCUS = (
    ("rate", ("rate", "percent", "%", "interest", "finance charge", "per month", "per year", "per day")),
    ("frequency", ("how often", "frequency", "once per", "times per", "per year", "per month", "no more than")),
    ("price_rule", ("priced", "price", "pricing", "then-current", "unless otherwise", "order form")),
    ("cap", ("cap", "liability cap", "limitation on amount", "limit on amount", "total liability", "maximum liability")),
)


def required_slots(question: Column | str, node_type: Column | str, numeric: Column | str, modal: Column | str, verb: Column | str) -> Column:
    """Array of slots that the question needs: by the kind of node that it was parsed to, else by its words."""
    q, kind = F.lower(c(question)), F.upper(F.coalesce(c(node_type), F.lit("GENERAL")))
    any_of = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    number = F.coalesce(c(numeric), F.lit(False))
    v = F.lower(F.coalesce(c(verb), F.lit("")))
    tests = {
        "VALUE": number, "MEANING": any_of(v, DEFINING) | any_of(q, SLOT_WORDS["MEANING"]), "PERMISSION": any_of(q, SLOT_WORDS["PERMISSION"]), "ACTOR": any_of(q, SLOT_WORDS["ACTOR"]),
        "CONSEQUENCE": any_of(q, SLOT_WORDS["CONSEQUENCE"]), "REQUIREMENT": q.rlike(r"\bmust\b|\bshall\b|\bshould\b") | any_of(q, SLOT_WORDS["REQUIREMENT"]),
    }
    by_words = F.filter(F.array(*[F.when(t, F.lit(s)) for s, t in tests.items()]), lambda s: s.isNotNull())
    forbids = any_of(F.lower(F.coalesce(c(modal), F.lit(""))), ("not", "cannot"))
    one = lambda s: F.array(F.lit(s))
    slots = (
        F.when((kind == "NUMERIC") | (number & (kind != "GENERAL")), one("VALUE")).when(kind == "DEFINITION", one("MEANING")).when(kind == "RIGHT", one("PERMISSION"))
        .when(kind == "OBLIGATION", F.when(forbids, one("PERMISSION")).otherwise(one("REQUIREMENT"))).when(kind == "CONDITION", one("CONSEQUENCE")).otherwise(by_words)
    )
    dated = F.when(c(question).rlike(DATE_QUESTION) & ~F.array_contains(slots, "VALUE"), F.concat(slots, one("VALUE"))).otherwise(slots)
    return F.when(F.size(dated) == 0, one("GENERAL")).otherwise(dated)


def value_focus(question: Column | str) -> Column:
    q, found = F.lower(c(question)), F.lit("generic")
    for name, words in reversed(FOCUS):
        found = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)), name).otherwise(found)
    return found


def asked_party(question: Column | str, parties: Column | str) -> Column:
    """The party of the document that the question is about: who has the rights, the subject, or else the first one named."""
    q, names = F.lower(c(question)), c(parties)
    owner = F.regexp_extract(q, r"\b(\w+)'s\s+(?:rights?|obligations?|responsibilit\w*|duties|liabilit\w*)", 1)
    subject = F.regexp_extract(q, r"\bwhat\s+\w+(?:\s+\w+)?\s+does\s+(?:the\s+)?(\w+)\s+have\b", 1)
    at = F.transform(F.filter(names, lambda p: F.contains(q, p)), lambda p: F.struct(F.instr(q, p).alias("at"), (-F.length(p)).alias("n"), p.alias("p")))
    first = F.get(F.array_sort(at), F.lit(0))["p"]
    return F.when((owner != "") & F.array_contains(names, owner), owner).when((subject != "") & F.array_contains(names, subject), subject).otherwise(F.coalesce(first, F.lit("")))


#: Scores that a reader's intent and the words' intent both have.
BLENDED = ("exact_intent", "simple_extract", "speculative", "outside_document", "missing_artifact", "instance_missing", "external_reference", "expects_rule", "outside_needed")
#: Kinds that a reader may name.
PROOFS = ("direct_rule_clause", "exact_value", "definition", "enumeration", "customer_instance_field", "external_artifact_contents", "mixed")
FORMS = ("yes_no", "date", "number", "percent", "name", "list", "clause_text", "mixed")
LANES = ("direct_rule", "exact_value", "dependency_risk", "speculative_outside", "mixed")


def one_of(value: Column | str, allowed: tuple[str, ...], otherwise: str = "mixed") -> Column:
    """The value if it is one of those allowed, in lower case."""
    v = F.trim(F.lower(c(value)))
    return F.when(v.isin(*allowed), v).otherwise(otherwise)


def blend(intents: DataFrame, weight: float = 0.8) -> DataFrame:
    """Intents with a reader's scores (columns said_<score>, null without a reader) mixed in, and its kinds where it names them.

    A weight of 1 takes the reader alone; scores that a reader doesn't give stay as the words have them."""
    mixed = {n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.col(f"said_{n}").isNull(), F.col(n)).otherwise((1 - weight) * F.col(n) + weight * F.col(f"said_{n}")))) for n in BLENDED if f"said_{n}" in intents.columns}
    kinds = {n: F.when(F.col(f"said_{n}").isNull(), F.col(n)).otherwise(one_of(f"said_{n}", allowed)) for n, allowed in (("proof", PROOFS), ("answer_form", FORMS)) if f"said_{n}" in intents.columns}
    return intents.withColumns(mixed | kinds)


def variants(question: Column | str, reply: Column | str, n: int = 6) -> Column:
    """`n` variants of a question: the reply's lines that ask something, then the question itself as often as needed."""
    lines = F.filter(F.transform(F.split(F.coalesce(c(reply), F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("?")))
    return F.slice(F.concat(lines, F.array_repeat(c(question), n)), 1, n)
