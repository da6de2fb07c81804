"""Column expressions over text: sentences, boilerplate, headers, blanks, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a sentence ends and the next begins, and what marks boilerplate, headers and blank fields.
SENTENCE_BREAK = "(?<=[.!?;])[)\\]”\"']*\\s+(?=[A-Z\"“”(\\d])"
BOILERPLATE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:docusign|envelope\s+id)(?:[^\p{L}\p{N}_]|$)|\+?\d[\d\s().\-]{6,}\d|https?://|www\.|[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}|(?:^|[^\p{L}\p{N}_])(?:suite|ste|floor|fl|blvd|ave|st|rd|dr|ln|pkwy)(?:[^\p{L}\p{N}_]|$)"
HEADER = r"(?i)^\s*(?:\d+(?:\.\d+)*\.?\s|SECTION\s+\d+|Article\s+[A-Z\d]+|Schedule\s+[A-Z])"
SUBSECTION = r"(?i)^([a-z])\.\s+([A-Z][^.]{2,50})\.\s*"
BODY_HEADER = r"(?i)^\s*(?:\d+[.\d]*\s+[A-Z]|Section\s+\d|Article\s+[IVX\d]|EXHIBIT\b|SCHEDULE\b|ANNEX\b)"
GUARD = r"(?i)^\s*(?:provided\s+that|provided,\s*however,\s*that|notwithstanding|except\s+as)\b"
BLANK = r"\*\*|___|\[BLANK\]"
PARENT = r"^\[PARENT:\s*([^\]]+)\]"
LINE_END = r"\r\n|\n|\r"
ITEM_MARK = r"\s*\([a-z0-9iv]+\)\s*"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(c(x), F.lit(" \t\n\r\f\v"))


def lines(text: Column | str) -> Column:
    """Lines as an array; a last line end makes no empty line."""
    return F.split(F.regexp_replace(c(text), f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def sentences(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(c(text), SENTENCE_BREAK, -1), lambda s: F.trim(s)), lambda s: s != "")


def is_boilerplate(sentence: Column | str) -> Column:
    s = F.trim(c(sentence))
    return (s == "") | ((F.length(s) < 40) & ~s.endswith(":")) | ((F.upper(s) == s) & s.rlike("[A-Z]{3,}")) | s.rlike(BOILERPLATE)


def collapsed(text: Column | str) -> Column:
    """Lower case with runs of white space as one space: what makes two chunks equal."""
    return F.trim(F.regexp_replace(F.lower(c(text)), r"\s+", " "))


def header(line: Column | str) -> Column:
    return c(line).rlike(HEADER) | c(line).rlike(SUBSECTION)


def long_words(text: Column | str, least: int = 4) -> Column:
    """Distinct lower-case ASCII words of at least `least` letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c(text)), F.lit(rf"\b([a-z]{{{least},}})\b"), 1))


def parent_label(source: Column | str) -> Column:
    """The label of a chunk's section; null without one, or for the general one."""
    label = F.trim(F.regexp_extract(c(source), PARENT, 1))
    return F.when((label != "") & (F.lower(label) != "general"), label)


def packed(text: Column | str, most: int = 1800, carry: int = 260) -> Column:
    """A long paragraph as parts of whole sentences up to `most` characters; a part's last sentence, if shorter than
    `carry`, also opens the next part. A longer sentence is a part of its own. One fold over the sentences."""
    t = F.trim(c(text))
    empty = F.array().cast("array<string>")
    join = lambda a: F.array_join(a, " ")
    start = F.struct(empty.alias("out"), empty.alias("buf"))

    def step(acc, s):
        out, buf = acc["out"], acc["buf"]
        flushed = F.when(F.size(buf) > 0, F.concat(out, F.array(join(buf)))).otherwise(out)
        last = F.try_element_at(buf, F.lit(-1))
        kept = F.when(F.length(last) < carry, F.array(last, s)).otherwise(F.array(s))
        full = (F.size(buf) > 0) & (F.length(join(buf)) + F.length(s) + 1 > most)
        return (
            F.when(F.length(s) > most, F.struct(F.concat(flushed, F.array(s)).alias("out"), empty.alias("buf")))
            .when(full, F.struct(flushed.alias("out"), kept.alias("buf")))
            .otherwise(F.struct(out.alias("out"), F.concat(buf, F.array(s)).alias("buf")))
        )

    done = lambda acc: F.when(F.size(acc["buf"]) > 0, F.concat(acc["out"], F.array(join(acc["buf"])))).otherwise(acc["out"])
    return F.when(t == "", empty).when(F.length(t) <= most, F.array(t)).otherwise(F.aggregate(sentences(t), start, step, done))


def _after_colon(paragraph: Column | str) -> tuple[Column, Column]:
    """Where the first colon stands, and the texts between item marks after it."""
    p = c(paragraph)
    cut = F.instr(p, ":")
    return cut, F.split(F.substring(p, cut + 1, F.length(p)), ITEM_MARK, -1)


def first_item_body(paragraph: Column | str) -> Column:
    """What stands between the first item mark and the second."""
    return stripped(F.get(_after_colon(paragraph)[1], F.lit(1)))


def list_items(paragraph: Column | str) -> Column:
    """`preamble: (a) x (b) y` as an array of preamble with each item; null unless it has two marks or more."""
    p = c(paragraph)
    cut, bodies = _after_colon(p)
    marks = F.transform(F.regexp_extract_all(F.substring(p, cut + 1, F.length(p)), F.lit(f"({ITEM_MARK})"), 1), stripped)
    prefix = stripped(F.concat(stripped(F.substring(p, F.lit(1), cut - 1)), F.lit(": "), stripped(F.get(bodies, F.lit(0)))))
    pairs = F.arrays_zip(marks.alias("mark"), F.slice(bodies, F.lit(2), F.size(bodies)).alias("body"))
    items = F.transform(F.filter(pairs, lambda x: stripped(x["body"]) != ""), lambda x: F.concat_ws(" ", prefix, x["mark"], stripped(x["body"])))
    return F.when((cut > 0) & (F.size(marks) >= 2), items)
