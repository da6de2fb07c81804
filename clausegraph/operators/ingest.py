"""From pages to chunks. A page is (doc_id, page_no, text); a document's pages are in the order of page_no."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions import text as tx


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, pos, line."""
    return pages.select("doc_id", "page_no", F.posexplode(tx.lines("text")).alias("pos", "line"))


def repeating_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, stripped, pages: trimmed lines that stand on `least` pages or more of their document."""
    seen = page_lines(pages).select("doc_id", "page_no", F.trim("line").alias("stripped")).where("stripped <> ''")
    return seen.groupBy("doc_id", "stripped").agg(F.count_distinct("page_no").alias("pages")).where(F.col("pages") >= least)


def strip_repeating_lines(pages: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, page_no, text: the pages without headers, footers and letterheads."""
    rows = page_lines(pages).withColumn("stripped", F.trim("line"))
    kept = rows.join(repeating_lines(pages, least), ["doc_id", "stripped"], "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    made = kept.groupBy("doc_id", "page_no").agg(F.array_join(ordered, "\n").alias("text"))
    return pages.select("doc_id", "page_no").join(made, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))


def sentence_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, pos, sentence, boilerplate."""
    rows = pages.select("doc_id", "page_no", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))
    return rows.withColumn("boilerplate", tx.is_boilerplate("sentence"))


def first_of_equal(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Chunks whose collapsed text no earlier chunk of their document has. Equal texts are counted map-side by their order."""
    first = chunks.groupBy("doc_id", tx.collapsed("chunk_text").alias("same")).agg(F.min(order).alias(order))
    return chunks.join(first.select("doc_id", order), ["doc_id", order], "left_semi")


def section_of_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, pos, line, section: the last header line before or at each line, or General."""
    whole = Window.partitionBy("doc_id").orderBy("page_no", "pos")
    rows = page_lines(pages)
    head = F.when(tx.header("line") & (F.length(F.trim("line")) < 60), F.trim("line"))
    return rows.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(whole), F.lit("General")))


def paragraph_rows(pages: DataFrame) -> DataFrame:
    """doc_id, para, text, n_lines of paragraphs: blank lines and headers part them (islands by running sums)."""
    whole = Window.partitionBy("doc_id").orderBy("page_no", "pos")
    rows = page_lines(pages).withColumn("line", F.trim("line"))
    starts = tx.header("line") | (F.lag("line", 1, "").over(whole) == "")
    rows = rows.withColumn("para", F.sum(F.when(starts, 1).otherwise(0)).over(whole)).where("line <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "pos", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id", "para").agg(F.array_join(ordered, " ").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def merge_guards(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that only qualify the one before (`provided that ..`) are joined to it."""
    whole = Window.partitionBy("doc_id").orderBy("para")
    rows = paragraphs.withColumn("_joins", F.col("text").rlike(tx.GUARD) & (F.row_number().over(whole) > 1))
    rows = rows.withColumn("_group", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(whole))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "_group").agg(F.min("para").alias("para"), F.array_join(ordered, " ").alias("text")).drop("_group")


def split_lists(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para, item, text: one row for each item of an enumerated list, or the paragraph itself."""
    parts = F.coalesce(tx.list_items("text"), F.array("text"))
    return paragraphs.select("doc_id", "para", F.posexplode(parts).alias("item", "text"))


def pack_paragraphs(paragraphs: DataFrame, most: int = 1800) -> DataFrame:
    """doc_id, para, part, text: paragraphs in parts of at most about `most` characters."""
    return paragraphs.select("doc_id", "para", F.posexplode(tx.packed("text", most)).alias("part", "text"))


def blank_fields(nodes: DataFrame, column: str = "text") -> DataFrame:
    """Rows with a column `blank`: whether the text holds an unfilled field."""
    return nodes.withColumn("blank", F.coalesce(F.col(column).rlike(tx.BLANK), F.lit(False)))


def glyph_lines(glyphs: DataFrame, gap: float = 2.5, step: int = 4) -> DataFrame:
    """doc_id, page_no, text from glyphs (text, x0, x1, top): glyphs of a band of `step` points are a line, and a gap is a space."""
    band = (F.bround(F.col("top") / step) * step).alias("band")
    row = glyphs.select("doc_id", "page_no", band, "x0", "x1", "text")
    w = Window.partitionBy("doc_id", "page_no", "band").orderBy("x0", "x1", "text")
    row = row.withColumn("text", F.concat(F.when(F.col("x0") - F.lag("x1").over(w) > gap, " ").otherwise(""), F.col("text")))
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))), lambda g: g["text"]), "")
    made = row.groupBy("doc_id", "page_no", "band").agg(inside.alias("line"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("band", "line"))), lambda x: x["line"])
    return made.groupBy("doc_id", "page_no").agg(F.array_join(whole, "\n").alias("text"))


# the whole chunker


def filled_paragraphs(pages: DataFrame, least: int = 60) -> DataFrame:
    """doc_id, para, text: paragraphs begin at headers, and at blank lines once what stands before is a header's or has `least` characters.

    Blocks between blank lines and headers come from running sums. Only runs of short blocks need a fold, a run at a time."""
    whole = Window.partitionBy("doc_id").orderBy("page_no", "pos")
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split("text", tx.LINE_END, -1)).alias("pos", "line"))  # a page ends a line
    rows = rows.withColumn("line", tx.stripped("line")).withColumn("head", tx.header("line")).withColumn("gap", F.lag("line", 1, "").over(whole) == "")
    rows = rows.withColumn("block", F.count_if(F.col("head") | F.col("gap")).over(whole)).where("line <> ''")
    joined = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, value))), lambda x: x[value]), " ")
    blocks = rows.groupBy("doc_id", "block").agg(joined(["page_no", "pos"], "line").alias("text"), F.bool_or("head").alias("head"))
    by_block = Window.partitionBy("doc_id").orderBy("block")
    done = F.col("head") | (F.length("text") >= least)
    runs = blocks.withColumn("run", F.count_if(F.col("head") | F.lag(done, 1, True).over(by_block)).over(by_block))
    empty = F.array().cast("array<string>")

    def fill(acc, b):
        new = acc["last"].isNull() | (F.length(acc["last"]) >= least)
        closed = F.when(new & acc["last"].isNotNull(), F.concat(acc["out"], F.array(acc["last"]))).otherwise(acc["out"])
        return F.struct(closed.alias("out"), F.when(new, b["text"]).otherwise(F.concat_ws(" ", acc["last"], b["text"])).alias("last"))

    start = F.struct(empty.alias("out"), F.lit(None).cast("string").alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
    made = runs.groupBy("doc_id", "run").agg(F.aggregate(ordered, start, fill, lambda acc: F.concat(acc["out"], F.array(acc["last"]))).alias("texts"))
    paragraphs = made.select("doc_id", "run", F.posexplode("texts").alias("nth", "text"))
    return paragraphs.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "nth")).alias("para"), "text")


def labelled_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Adds parent, and `title` for paragraphs that are nothing but a header: labels are filled forward from headers."""
    upto = Window.partitionBy("doc_id").orderBy("para")
    head, sub = F.col("text").rlike(tx.HEADER), F.col("text").rlike(tx.SUBSECTION)
    stop = F.instr("text", ".")
    top = F.when(head & ~sub & ~F.col("title") & stop.between(2, 40), tx.stripped(F.substring(F.col("text"), F.lit(1), stop)))
    rows = paragraphs.withColumn("title", (head | sub) & (F.length("text") < 60)).withColumn("own_top", top)
    rows = rows.withColumn("top", F.coalesce(F.last("own_top", ignorenulls=True).over(upto), F.lit("General")))
    under = F.concat_ws(" ", "top", F.regexp_replace(tx.stripped(F.regexp_extract("text", tx.SUBSECTION, 0)), r"\.+$", ""))
    label = F.when(F.col("title"), F.col("text")).when(sub, under).otherwise(F.col("own_top"))
    return rows.withColumn("parent", F.coalesce(F.last(label, ignorenulls=True).over(upto), F.lit("General"))).drop("own_top", "top")


def chunk_bodies(paragraphs: DataFrame) -> DataFrame:
    """doc_id, seq, parent, lead, own: what each chunk holds of its own, and whether an overlap goes before it.

    Items of lists and parts of long paragraphs are rows; guards are joined to the chunk before."""
    items, first = tx.list_items("text"), tx.first_item_body("text")
    guard = ~F.col("title") & F.col("text").rlike(tx.GUARD) & (F.col("para") > 1)
    texts = F.when(F.col("title") | guard, F.array("text")).otherwise(F.coalesce(items, tx.packed("text")))
    rows = paragraphs.withColumns({"guard": guard, "first": ~F.col("title") & (items.isNull() | (first != ""))})
    rows = rows.select("doc_id", "para", "parent", "guard", "first", F.posexplode(texts).alias("item", "text"))
    whole = Window.partitionBy("doc_id").orderBy("para", "item")
    rows = rows.withColumn("seq", F.count_if(~F.col("guard")).over(whole))
    parts = F.array_sort(F.collect_list(F.struct("para", "item", "text", "parent", "first")))
    made = rows.groupBy("doc_id", "seq").agg(parts.alias("parts")).withColumn("p", F.col("parts")[0])
    lead = F.col("p.first") & (F.col("p.item") == 0) & ~F.col("p.text").rlike(tx.BODY_HEADER) & (F.col("seq") > 1)
    return made.select("doc_id", "seq", "p.parent", lead.alias("lead"), F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("own"))


def with_overlaps(bodies: DataFrame, sentences: int = 3) -> DataFrame:
    """doc_id, seq, parent, body: a leading chunk begins with the last sentences, boilerplate left out, of the one before.

    Those follow from the own text of the one before if it has enough of them beyond its first, or no overlap itself. Only
    where it hasn't does an overlap depend on the overlap before, and a fold runs along that chain."""
    plain = lambda all_: F.filter(all_, lambda s: ~tx.is_boilerplate(s))
    tail = lambda all_: F.array_join(F.slice(all_, F.greatest(F.lit(1), F.size(all_) - sentences + 1), sentences), " ")
    before = Window.partitionBy("doc_id").orderBy("seq")
    rows = bodies.withColumn("s", tx.sentences("own")).withColumn("beyond", F.size(plain(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))))))
    free = F.lag((F.col("beyond") >= sentences) | ~F.col("lead"), 1, True).over(before)
    rows = rows.withColumn("known", F.when(F.col("lead"), F.lag(tail(plain(F.col("s")))).over(before)).otherwise(F.lit(""))).withColumn("starts", ~F.col("lead") | free)
    rows = rows.withColumn("chain", F.count_if("starts").over(before))
    put = lambda overlap, own: F.when(F.coalesce(overlap, F.lit("")) == "", own).otherwise(F.concat_ws(" ", overlap, own))

    def follow(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        overlap = F.when(x["starts"], x["known"]).otherwise(tail(plain(tx.sentences(last["body"]))))
        return F.concat(acc, F.array(F.struct(x["seq"].alias("seq"), x["parent"].alias("parent"), put(overlap, x["own"]).alias("body"))))

    none = F.array().cast("array<struct<seq:bigint,parent:string,body:string>>")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "parent", "own", "starts", "known")))
    made = rows.groupBy("doc_id", "chain").agg(F.aggregate(ordered, none, follow).alias("chunks"))
    return made.select("doc_id", F.inline("chunks"))


def chunk_documents(pages: DataFrame) -> DataFrame:
    """doc_id, chunk_id, chunk_text: the whole chunker, with parents and overlaps, equal chunks once."""
    paragraphs = labelled_paragraphs(filled_paragraphs(strip_repeating_lines(pages)))
    bodies = with_overlaps(chunk_bodies(paragraphs))
    chunks = bodies.select("doc_id", F.col("seq").alias("chunk_id"), F.concat(F.lit("[PARENT: "), "parent", F.lit("] -> "), "body").alias("chunk_text"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1
    return first_of_equal(chunks).withColumn("chunk_id", nth.cast("long")).select("doc_id", "chunk_id", "chunk_text")
