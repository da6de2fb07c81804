"""Typed nodes: validated, keyed, resolved, and derived from one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import nodes as nx
from clausegraph.functions.numerics import has_any
from clausegraph.schema import NODE_TEXT, REQUIRED

#: What a model may return for a chunk; `to`, `right` and `limit` are its names for ref_to, right_text and limit_text.
RAW = "type string, " + ", ".join(f"{c} string" for c in NODE_TEXT if c not in ("ref_to", "right_text", "limit_text")) + ", `to` string, `right` string, `limit` string, value_tags array<string>, source_text string, chunk_id long"


def parse_nodes(replies: DataFrame) -> DataFrame:
    """doc_id, chunk_id and one row for each node of (doc_id, chunk_id, reply): an object with `nodes` or `items`, or a bare list.

    A reply with text around the list, or with commas before closing brackets, is read after mending."""
    mended = F.regexp_replace(F.regexp_extract("reply", r"(?s)(\[.*\])", 1), r",\s*([}\]])", "$1")
    wrapped = F.from_json("reply", f"nodes array<struct<{_ddl()}>>, items array<struct<{_ddl()}>>")
    listed = F.from_json(mended, f"array<struct<{_ddl()}>>")
    nodes = F.coalesce(wrapped["nodes"], wrapped["items"], listed)
    rows = replies.select("doc_id", F.col("chunk_id").alias("_asked"), F.explode(nodes).alias("n")).select("doc_id", "_asked", "n.*")
    return rows.withColumn("chunk_id", F.coalesce("chunk_id", "_asked")).drop("_asked").withColumnsRenamed({"to": "ref_to", "right": "right_text", "limit": "limit_text"})


def _ddl() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.rsplit(" ", 1) for x in RAW.split(", ")))


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of known types with all required fields; fields trimmed and empty ones null, modals and tags in lower case."""
    rows = nodes.withColumn("type", F.upper("type"))
    rows = rows.withColumns({n: F.nullif(F.trim(F.col(n)), F.lit("")) for n in NODE_TEXT if n in nodes.columns})
    rows = rows.withColumns({"modal": F.lower("modal"), "source_text": F.trim(F.coalesce("source_text", F.lit("")))})
    if "value_tags" in nodes.columns:
        rows = rows.withColumn("value_tags", F.slice(F.transform(F.filter("value_tags", lambda t: t != ""), lambda t: F.trim(F.lower(t))), 1, 8))
    valid = F.lit(False)
    for kind, names in REQUIRED.items():
        valid = valid | ((F.col("type") == kind) & nx.has(names))
    return rows.where(valid)


def unique_nodes(nodes: DataFrame, order: tuple[str, ...] = ("chunk_id", "source_text")) -> DataFrame:
    """The first node of each key in a document."""
    w = Window.partitionBy("doc_id", "node_key").orderBy(*order)
    return nodes.withColumn("node_key", nx.node_key()).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def alias_map(nodes: DataFrame) -> DataFrame:
    """doc_id, alias, name: a defined term stands for its definition; where the definition quotes a name no longer than the
    term, that name stands for the term. Of several, the last definition counts."""
    quoted = F.trim(F.regexp_extract("definition", r"[('\"]([\w\s]+)['\")]", 1))
    defs = nodes.where("type = 'DEFINITION' AND trim(term) <> '' AND trim(definition) <> ''")
    swap = (F.regexp_extract("definition", r"[('\"]([\w\s]+)['\")]", 0) != "") & (F.length(quoted) <= F.length(F.trim("term")))
    rows = defs.select("doc_id", F.lower(F.when(swap, quoted).otherwise(F.trim("term"))).alias("alias"), F.when(swap, F.trim("term")).otherwise(F.trim("definition")).alias("name"), F.struct("chunk_id", "source_text", "definition").alias("at"))
    return rows.groupBy("doc_id", "alias").agg(F.max_by("name", "at").alias("name"))


def resolve_parties(nodes: DataFrame, aliases: DataFrame, fields: tuple[str, ...] = ("party", "beneficiary", "object_party")) -> DataFrame:
    """Nodes with the names that their parties' aliases stand for. A document's aliases are one row, so nodes are dealt once."""
    table = aliases.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", "name"))).alias("_names"))
    rows = nodes.join(table, "doc_id", "left")
    return rows.withColumns({f: F.coalesce(F.try_element_at("_names", F.trim(F.lower(F.col(f)))), F.col(f)) for f in fields if f in nodes.columns}).drop("_names")


#: Terms whose definitions make up the summary of a contract.
SUMMARY_TERMS = ("agreement type", "territory", "governing law", "parties", "party", "licensor", "licensee", "company", "vendor", "client", "customer", "effective date", "execution date")


def contract_summary(nodes: DataFrame) -> DataFrame:
    """doc_id, definition: one summary node for each document with header-level facts, in the order of definitions, then dates."""
    term, applies = F.lower("term"), F.lower("applies_to")
    fact = F.when((F.col("type") == "DEFINITION") & (F.trim("definition") != "") & has_any(term, SUMMARY_TERMS), F.concat_ws(": ", F.trim("term"), F.trim("definition")))
    date = F.when((F.col("type") == "NUMERIC") & has_any(applies, ("execution date", "effective date")), F.concat(F.lit("Date: "), F.col("value"), F.lit(" "), F.col("unit")))
    rows = nodes.select("doc_id", F.struct((F.col("type") == "NUMERIC").alias("late"), "chunk_id", "source_text", F.coalesce(fact, date).alias("fact")).alias("f")).where("f.fact IS NOT NULL").distinct()
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["fact"]), " | ").alias("definition"))


#: What a number in a condition is called, by words of the condition.
TAG_RULES = (
    (("notice", "notify", "written notice"), ("notice_period", "days")), (("terminat", "cancell", "end the agreement"), ("termination",)),
    (("exit fee", "transfer fee", "exit"), ("exit_fee", "fee", "currency")), (("arbitrat", "hearing", "dispute resolution"), ("arbitration", "dispute", "days")),
    (("initial term", "term of", "renew", "renewal"), ("term", "duration", "renewal")), (("nrr", "net recurring revenue", "recurring rev"), ("revenue", "recurring", "currency")),
    (("suspend", "suspension"), ("suspension", "notice_period")), (("press release", "public statement", "approval"), ("approval", "days")),
    (("payment", "invoice", "remit", "due"), ("payment", "fee")), (("audit", "inspection", "records"), ("audit", "days")),
    (("cure", "remedy", "breach"), ("cure_period", "breach", "days")), (("escrow", "trust"), ("escrow", "days")),
)

#: Patterns of numbers in conditions; the unit (by default the words of the second group) and first tags.
CONDITION_NUMBERS = (
    (r"(?i)\b(\d[\d,]*)\s*(calendar\s+days?)\b", None, ("days",)), (r"(?i)\b(\d[\d,]*)\s*(business\s+days?)\b", None, ("days",)), (r"(?i)\b(\d[\d,]*)\s*(days?)\b", None, ("days",)),
    (r"(?i)\b(\d[\d,]*)\s*(weeks?)\b", None, ("duration",)), (r"(?i)\b(\d[\d,]*)\s*(months?)\b", None, ("duration",)), (r"(?i)\b(\d[\d,]*)\s*(years?)\b", None, ("duration",)),
    (r"(?i)\$\s*(\d[\d,]*(?:\.\d+)?)\s*(million|thousand|k)\b", "USD", ("currency", "cap")), (r"\$\s*(\d[\d,]*(?:\.\d+)?)\b", "USD", ("currency",)), (r"(?i)\b(\d+(?:\.\d+)?)\s*(%|percent)\b", None, ("percent", "rate")),
)


def value_tags(text: Column, base: tuple[str, ...], most: int = 6) -> Column:
    low = F.lower(text)
    tags = [F.array(*map(F.lit, base)).cast("array<string>")] + [F.when(has_any(low, words), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")) for words, tags in TAG_RULES]
    return F.slice(F.array_distinct(F.concat(*tags)), 1, most)


def _number(rule: int, pattern: str, fixed: str | None, base: tuple[str, ...]):
    """What a match of a rule tells: value, unit, first tags, and whether the trigger holds it."""

    def struct(m: Column) -> Column:
        unit = F.lit(fixed) if fixed else F.lower(F.trim(F.regexp_extract(m, pattern, 2)))
        inside = F.instr(F.coalesce(F.col("trigger"), F.lit("")), m) > 0
        return F.struct(F.lit(rule).alias("rule"), F.regexp_replace(F.regexp_extract(m, pattern, 1), ",", "").alias("value"), unit.alias("unit"), inside.alias("in_trigger"), F.array(*map(F.lit, base)).alias("base"))

    return struct


def condition_numerics(nodes: DataFrame) -> DataFrame:
    """NUMERIC nodes for the numbers in conditions that no node of the document has yet; the first condition of a key gives it."""
    both = F.concat_ws(" ", F.coalesce("trigger", F.lit("")), F.coalesce("consequence", F.lit("")))
    found = [F.transform(F.regexp_extract_all(both, F.lit(rule[0]), 0), _number(k, *rule)) for k, rule in enumerate(CONDITION_NUMBERS)]
    rows = nodes.where("type = 'CONDITION'").select("doc_id", "chunk_id", "trigger", "consequence", "source_text", F.posexplode(F.concat(*found)).alias("at", "x"))
    context = F.when(F.col("x.in_trigger"), F.col("trigger")).otherwise(F.col("consequence"))
    number = F.expr("try_cast(x.value AS double)")
    value = F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(F.col("x.value"))
    tags = F.slice(F.array_distinct(F.concat(F.col("x.base"), value_tags(F.concat_ws(" ", "trigger", "consequence"), ()))), 1, 6)
    made = rows.select("doc_id", "chunk_id", F.lit("NUMERIC").alias("type"), value.alias("value"), F.col("x.unit").alias("unit"), F.trim(F.substring(context, 1, 120)).alias("applies_to"), F.substring("trigger", 1, 200).alias("trigger"), tags.alias("value_tags"), "source_text", "at")
    key = F.concat_ws("::", F.lit("NUM"), "value", F.lower("unit"), F.substring(F.lower("applies_to"), 1, 60))
    w = Window.partitionBy("doc_id", "node_key").orderBy("chunk_id", "source_text", "trigger", "at")
    first = made.withColumn("node_key", key).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "at")
    known = nodes.where("type = 'NUMERIC'").select("doc_id", nx.node_key().alias("node_key")).distinct()
    return first.join(known, ["doc_id", "node_key"], "left_anti")


def topic_chunks(chunks: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, topic, chunk_id, hits: the `most` chunks of a document with most words of each topic that it lacks; later chunks first of equals."""
    words = topics.select("doc_id", "topic", F.explode(F.array_distinct(F.filter(F.split(F.lower("topic"), " "), lambda w: F.length(w) > 3))).alias("word"))
    hits = chunks.join(words, "doc_id").where(F.contains(F.lower("chunk_text"), F.col("word"))).groupBy("doc_id", "topic", "chunk_id").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("doc_id", "topic").orderBy(F.col("hits").desc(), F.col("chunk_id").desc())
    return hits.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def new_by_source(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of a later pass whose source text the document's nodes don't have."""
    return found.join(nodes.select("doc_id", "source_text").distinct(), ["doc_id", "source_text"], "left_anti")


def chunks_without_nodes(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks that gave no node: what a second pass reads."""
    return chunks.join(nodes.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_anti")


def extraction_batches(chunks: DataFrame, size: int = 3, most: int = 1500) -> DataFrame:
    """doc_id, batch, text: `size` consecutive chunks of a document for each call, each cut to `most` characters."""
    rows = chunks.select("doc_id", F.floor(F.col("chunk_id") / size).cast("long").alias("batch"), F.struct("chunk_id", F.substring("chunk_text", 1, most).alias("text")).alias("c"))
    lines = F.transform(F.array_sort(F.collect_list("c")), lambda c: F.concat(F.lit("[CHUNK "), c["chunk_id"].cast("string"), F.lit("]\n"), c["text"]))
    return rows.groupBy("doc_id", "batch").agg(F.array_join(lines, "\n\n").alias("text"))


def edge_text(chunks: DataFrame, first: int = 2, last: int = 2, head: int = 3000, tail: int = 1200) -> DataFrame:
    """doc_id, header, signature: the start of a document's first chunks and the end of its last ones."""
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("chunk_id").desc()))
    rows = chunks.withColumn("_back", back).where((F.col("chunk_id") < first) | (F.col("_back") <= last))
    texts = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("chunk_id", "chunk_text")))), lambda c: c["chunk_text"]), "\n")
    got = rows.groupBy("doc_id").agg(texts(F.col("chunk_id") < first).alias("header"), texts(F.col("_back") <= last).alias("signature"))
    return got.select("doc_id", F.substring("header", 1, head).alias("header"), F.right("signature", F.lit(tail)).alias("signature"))


def question_registry(questions: DataFrame) -> DataFrame:
    """Questions (doc, question, label) numbered within their document."""
    return questions.withColumn("q_no", F.row_number().over(Window.partitionBy("doc").orderBy("question")))
