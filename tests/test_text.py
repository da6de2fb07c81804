import pytest
from clausegraph.functions import numerics as nx
from clausegraph.functions import questions as qx
from clausegraph.functions import text as tx
from clausegraph.operators import ingest, numerics
from pyspark.sql import functions as F


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, k, t) for k, t in enumerate(texts)], "doc_id string, page_no long, text string")


def test_repeating_lines_go(spark):
    got = {r.page_no: r.text for r in ingest.strip_repeating_lines(pages(spark, "Head\nOne\n", " Head \nTwo", "Head", "Three")).collect()}
    assert got == {0: "One", 1: "Two", 2: "", 3: "Three"}


def test_sentences_and_boilerplate(spark):
    row = spark.createDataFrame([('It ends. "So" it goes; (a) next! no',)], "t string").select(tx.sentences("t").alias("s")).first()
    assert row.s == ["It ends.", '"So" it goes;', "(a) next! no"]
    rows = [("short", True), ("ends with colon:", False), ("A" * 45, True), ("This is a sentence that is long enough to be kept here.", False), ("Write to someone at me@here.com about all these many things.", True), ("", True)]
    got = spark.createDataFrame(rows, "s string, b boolean").where(tx.is_boilerplate("s") != F.col("b"))
    assert got.count() == 0


def test_packing_keeps_sentences(spark):
    parts = [f"Sentence number {k} has a few words." for k in range(20)]
    got = spark.createDataFrame([(" ".join(parts),), ("",), ("Short.",)], "t string").select(tx.packed("t", 200).alias("p")).collect()
    assert got[1].p == [] and got[2].p == ["Short."]
    assert all(len(p) <= 200 for p in got[0].p) and len(got[0].p) > 3
    assert got[0].p[1].startswith(tx_last(got[0].p[0]))


def tx_last(part):
    return part[part.rfind("Sentence") :]


def test_paragraphs_fill_up(spark):
    """Short blocks are joined up to sixty characters; headers part, and so do blocks after a header's."""
    text = "\n".join(["2. Title", "", "short", "", "another short one", "", "y" * 50, "", "next", "x" * 70, "", "last"])
    got = [r.text for r in ingest.filled_paragraphs(pages(spark, text)).orderBy("para").collect()]
    assert got == ["2. Title", "short another short one " + "y" * 50, "next " + "x" * 70, "last"]


def test_overlaps_follow_a_chain(spark):
    """A short chunk passes on what it took from the one before."""
    s = [f"Sentence number {k} of this text is long enough to be kept as it is." for k in range(6)]
    bodies = spark.createDataFrame([("d", 1, "P", False, " ".join(s[:4])), ("d", 2, "P", True, s[4]), ("d", 3, "P", True, s[5]), ("d", 4, "P", False, "1. Head"), ("d", 5, "P", True, "tail")], "doc_id string, seq long, parent string, lead boolean, own string")
    got = [r.body for r in ingest.with_overlaps(bodies).orderBy("seq").collect()]
    assert got == [" ".join(s[:4]), " ".join([*s[1:4], s[4]]), " ".join([*s[2:5], s[5]]), "1. Head", "tail"]


def test_chunks_carry_parents_and_overlap(spark):
    text = "\n".join([
        "1. Scope", "The vendor delivers all of the goods that are listed in the order to the customer on time.", "",
        "Provided that the customer has paid all of the invoices that were due before the delivery.", "",
        "The customer may: (a) return goods within thirty days (b) reject goods that are broken", "",
        "2. Price of goods and of their delivery as agreed between both of the parties to this. It is fixed.",
    ])
    got = [r.chunk_text for r in ingest.chunk_documents(pages(spark, text)).orderBy("chunk_id").collect()]
    assert got[0].startswith("[PARENT: ")
    joined = " ".join(got)
    assert "Provided that the customer" in joined and "(a) return goods" in joined and "(b) reject goods" in joined
    assert sum("(a) return" in c for c in got) == 1 and sum(c.count("Provided that") for c in got) >= 1


@pytest.mark.parametrize(("text", "value", "unit", "category", "source"), [
    ("Either party may give thirty (30) days' prior written notice.", 30, "days", "notice_period", "mixed"),
    ("Overdue sums bear one and one-half percent (1.5%) per month.", 1.5, "%", "late_charge", "digit"),
    ("The fee is $1,000,000 annually.", 1_000_000, "", "general", "digit"),
    ("It ends after twenty-five days of silence.", 25, "days", "general", "word"),
    ("The deposit is 5% of it.", 5, "%", "percentage", "digit"),
])
def test_numeric_facts(spark, text, value, unit, category, source):
    facts = numerics.extract_numerics(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert (value, unit, category, source) in [(f.value, f.unit, f.category, f.source) for f in facts]


def test_numbers_that_are_no_facts(spark):
    texts = ["Section 12 applies.", "See Rule 45 there.", "On 5/12 it rained.", "In 1999 it was so.", "Size 640x450 pixels.", "At 12 Main Street now.", "Page 7 of it.", "a 30-day period", "Network 1 is up.", "see 2.1 for it", "Springfield IL 60601", "3.   Item", "revision 4", "2.4   TERM 5"]
    got = numerics.extract_numerics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).where("source = 'digit'")
    assert [(texts[r.doc_id], r.raw) for r in got.collect()] in ([], [("2.4   TERM 5", "5")])


def test_numbers_near_each_other(spark):
    """Words near digits are left out, so are words near words before them, and a number said twice is one fact."""
    far = " and some more words that fill up the space between them as far as it goes and then on"
    texts = [
        "We wait for thirty (30) days and then we go" + far + " for forty days, fifty days" + far + " for sixty days.", "5 (five) users; 5 (five) users",
    ]
    got = numerics.extract_numerics(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.value, r.unit, r.source, r.written_form) for r in got] == [(0, 30.0, "days", "mixed", "thirty"), (0, 40.0, "days", "word", None), (0, 60.0, "days", "word", None), (1, 5.0, "", "mixed", "five"), (1, 5.0, "", "digit", None)]


def test_general_shows_six_digits(spark):
    values = [0.0, 1.0, 1.5, 30.0, 1234567.0, 123456.0, 0.00001234, 99.95, 2e9, 0.25, 1000000.0, 100.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", numerics.general(F.col("v")).alias("s")).collect()
    assert all(r.s == f"{r.v:g}" for r in got), got


def test_sentences_around_numbers():
    text = "First one ends. Then 5 days pass; it is so. After that. " + "x" * 700 + " 7 days"
    marks = numerics.Sentences(text)
    assert marks.around(text.index("5")) == "Then 5 days pass;" and set(marks.around(text.index("7 d"))[:-7]) == {"x"}


def test_word_numbers(spark):
    rows = [("two thousand five hundred", 2500.0), ("one hundred and twenty-three", 123.0), ("three million", 3e6), ("one-half", 0.5), ("first", 1.0), ("nothing", None), ("hundreds", 0.0)]
    got = spark.createDataFrame(rows, "p string, v double").select("p", "v", nx.word_number("p").alias("got")).collect()
    assert all(r.v == r.got for r in got), got


def test_numeric_map_prefers_long_contexts(spark):
    rows = [(1, "a", 5.0, "x", "short", 1), (1, "a", 5.0, "x", "longer one", 9), (1, "a", 6.0, "x", "c", 2)]
    got = numerics.numeric_map(spark.createDataFrame(rows, "doc_id int, category string, value double, unit string, context string, position long"))
    assert {r.context for r in got.collect()} == {"longer one", "c"}


def test_band_anti_join_is_exact(spark):
    left, right = [(1, p) for p in range(0, 200)], [(1, 50), (1, 55), (2, 120)]
    got = numerics.band_anti_join(spark.createDataFrame(left, "d int, p int"), spark.createDataFrame(right, "d int, q int"), "d", "p", "q", 7)
    assert {r.p for r in got.collect()} == {p for _, p in left if all(abs(p - q) >= 7 for d, q in right if d == 1)}


@pytest.mark.parametrize(("question", "kind", "want"), [
    ("What is the notice period?", "GENERAL", ["GENERAL"]), ("When does it end?", "GENERAL", ["VALUE"]), ("Can the buyer return it?", "GENERAL", ["PERMISSION"]), ("Who is it?", "GENERAL", ["ACTOR"]),
    ("What happens if it is late?", "GENERAL", ["CONSEQUENCE"]), ("Must it be so?", "GENERAL", ["REQUIREMENT"]), ("What does it mean?", "GENERAL", ["MEANING"]), ("How much?", "NUMERIC", ["VALUE"]), ("When?", "OBLIGATION", ["REQUIREMENT", "VALUE"]),
])
def test_required_slots(spark, question, kind, want):
    row = spark.createDataFrame([(question, kind)], "q string, k string").select(qx.required_slots("q", "k", F.lit(False), F.lit("shall"), F.lit("")).alias("s")).first()
    assert row.s == want
