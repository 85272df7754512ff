"""CoNLL-2012 reader: lines, three ways to number sentences, mentions from bracket atoms, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEGIN, END = r"^#begin document \((.*)\);? ?(?:part (\d+))?\s*$", r"^#end document"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of whole files, a row each; splits.conll_lines() gives the same of files of any size."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def blocks(lines: DataFrame) -> DataFrame:
    """Lines inside documents, with block (number of begins so far), doc_id and part; begin and end lines are left out."""
    w = Window.partitionBy("path").orderBy("line_no")
    begin, end = F.col("line").rlike(BEGIN), F.col("line").rlike(END)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(begin, F.struct(F.regexp_extract("line", BEGIN, 1).alias("doc_id"), F.regexp_extract("line", BEGIN, 2).alias("part")))
    return (
        lines.withColumn("block", F.sum(begin.cast("int")).over(run))
        .withColumn("ended", F.sum(end.cast("int")).over(run))
        .withColumn("head", F.last(head, ignorenulls=True).over(run))
        .where(~begin & ~end & (F.col("block") > F.col("ended")))
        .select("path", "block", F.col("head.doc_id").alias("doc_id"), F.col("head.part").alias("part"), "line_no", "line")
    )


def block_gates(lines: DataFrame) -> DataFrame:
    """kind, n: nested and unclosed documents, duplicate ids, tokens outside of documents, lines with fewer than five columns."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    begin, end = F.col("line").rlike(BEGIN), F.col("line").rlike(END)
    run = lines.withColumn("open", F.sum(begin.cast("int") - end.cast("int")).over(w))
    text = ~begin & ~end & (F.trim("line") != "") & ~F.col("line").startswith("#")
    flat = run.agg(
        F.count_if(begin & (F.col("open") > 1)).alias("nested"),
        F.sum(begin.cast("int") - end.cast("int")).alias("unclosed"),
        F.count_if(text & (F.col("open") < 1)).alias("outside"),
        F.count_if(text & (F.size(F.split(F.trim("line"), r"\s+")) < 5)).alias("short_line"),
    )
    twice = lines.where(begin).groupBy(F.regexp_extract("line", BEGIN, 1), F.regexp_extract("line", BEGIN, 2)).count().where("count > 1").agg(F.count("*").alias("duplicate_document"))
    row = flat.crossJoin(F.broadcast(twice))  # one row each
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("long").alias("n")) for c in row.columns))).alias("x")).select("x.*")


def tokens(block_lines: DataFrame, numbering: str = "blank_lines") -> DataFrame:
    """doc_id, part, line_no, sentence_id (1-based), token_id, idx (over the document), tok, coref.

    numbering: blank_lines (a sentence ends at one or more blank lines) or token_zero (one begins at each token 0).
    """
    doc = Window.partitionBy("path", "block").orderBy("line_no")
    run = doc.rowsBetween(Window.unboundedPreceding, 0)
    columns = F.split(F.trim("line"), r"\s+")
    blank = F.trim("line") == ""
    marked = block_lines.withColumn("blank", blank).withColumn("gap", ~F.col("blank") & F.coalesce(F.lag("blank").over(doc), F.lit(True)))
    word = marked.withColumn("by_blank", F.sum(F.col("gap").cast("int")).over(run)).where("NOT blank").where(~F.col("line").startswith("#"))
    parsed = word.withColumn("c", columns).withColumn("token_id", F.get("c", F.lit(2)).try_cast("int"))
    by_zero = F.sum((F.col("token_id") == 0).cast("int")).over(run)
    return parsed.withColumn("sentence_id", F.col("by_blank") if numbering == "blank_lines" else by_zero).select(
        "doc_id", "part", "line_no", F.col("sentence_id").cast("int"), "token_id", (F.row_number().over(doc) - 1).alias("idx"), F.get("c", F.lit(3)).alias("tok"), F.element_at("c", -1).alias("coref")
    )


def field_gates(block_lines: DataFrame, fields: int = 12) -> DataFrame:
    """path, line_no, doc_id, part, n_fields of the token lines that don't have exactly so many fields."""
    n = F.size(F.split(F.trim("line"), r"\s+"))
    token = (F.trim("line") != "") & ~F.col("line").startswith("#")
    return block_lines.where(token).select("path", "line_no", "doc_id", "part", n.alias("n_fields")).where(F.col("n_fields") != fields)


def literal_mentions(block_lines: DataFrame) -> DataFrame:
    """doc_id, sentence_id, start, end (token ids in the sentence), cid and problem of the mentions as one reads them from top to bottom.

    A sentence begins at each token 0. Brackets match by a stack for each doc_id
    and cluster, over all parts and blocks of the id; of mentions with one span
    the last that closes counts. problem: close_without_open, unclosed or
    cross_sentence; rows with a problem bear no span.
    """
    order = ["path", "line_no"]
    columns = F.split(F.trim("line"), r"\s+")
    token = (F.trim("line") != "") & ~F.col("line").startswith("#")
    words = block_lines.where(token).withColumn("c", columns).withColumn("token_id", F.get("c", F.lit(2)).try_cast("int"))
    run = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = words.withColumn("sentence_id", F.sum((F.col("token_id") == 0).cast("int")).over(run).cast("int"))
    atoms = placed.withColumn("coref", F.element_at("c", -1)).where("coref <> '-'").select("doc_id", *order, "sentence_id", "token_id", F.posexplode(F.split("coref", r"\|")).alias("k", "atom"))
    steps = F.array_compact(F.array(F.when(F.col("atom").startswith("("), 1), F.when(F.col("atom").endswith(")"), -1)))
    step = atoms.withColumn("cid", F.regexp_replace("atom", r"^\(|\)$", "")).withColumn("step", F.explode(steps))
    w = Window.partitionBy("doc_id", "cid").orderBy(*order, "k", F.desc("step"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # a closing without an opening leaves the stack empty: the depth is what is above the lowest point so far
    summed = step.withColumn("sum", F.sum("step").over(upto)).withColumn("low", F.least(F.lit(0), F.min("sum").over(upto)))
    level = summed.withColumn("orphan", (F.col("step") == -1) & (F.col("sum") < F.coalesce(F.lag("low").over(w), F.lit(0)))).withColumn(
        "depth", F.when(F.col("step") == 1, F.col("sum")).otherwise(F.col("sum") + 1)
    )
    keys = ["doc_id", "cid", "depth", "nth"]
    nth = F.row_number().over(Window.partitionBy("doc_id", "cid", "depth", "step").orderBy(*order, "k"))
    matched = level.where("NOT orphan").withColumn("nth", nth)
    opened = matched.where("step = 1").select(*keys, F.col("sentence_id").alias("os"), F.col("token_id").alias("start"))
    closed = matched.where("step = -1").select(*keys, *order, "k", "sentence_id", F.col("token_id").alias("end"))
    pairs = opened.join(closed, keys, "left")
    problem = F.when(F.col("sentence_id").isNull(), "unclosed").when(F.col("os") != F.col("sentence_id"), "cross_sentence")
    told = pairs.withColumn("problem", problem)
    span = ["doc_id", "sentence_id", "start", "end"]
    last = told.where("problem IS NULL").groupBy(*span).agg(F.max_by("cid", F.struct(*order, "k")).alias("cid")).withColumn("problem", F.lit(None).cast("string"))
    none = F.lit(None).cast("int")
    bad = told.where("problem IS NOT NULL").select("doc_id", F.col("os").alias("sentence_id"), none.alias("start"), none.alias("end"), "cid", "problem")
    lost = level.where("orphan").select("doc_id", "sentence_id", none.alias("start"), none.alias("end"), "cid", F.lit("close_without_open").alias("problem"))
    return last.unionByName(bad).unionByName(lost)


def mentions(toks: DataFrame) -> DataFrame:
    """doc_id, part, cid, start and end (idx), sentence_id, end_sentence of matched brackets; start or end is null where one is without its partner.

    Per document and cluster an opening raises the depth and a closing lowers it;
    the k-th opening at a depth belongs to the k-th closing at that depth.
    """
    atoms = toks.where("coref <> '-'").select("doc_id", "part", "sentence_id", "idx", F.posexplode(F.split("coref", r"\|")).alias("k", "atom"))
    cid = F.regexp_replace("atom", r"[()]", "")
    opens, closes = F.col("atom").startswith("("), F.col("atom").endswith(")")
    steps = atoms.withColumn("cid", cid).withColumn("step", F.explode(F.array_compact(F.array(F.when(opens, 1), F.when(closes, -1)))))
    order = Window.partitionBy("doc_id", "part", "cid").orderBy("idx", "k", F.desc("step"))
    depth = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("step") == -1, 1).otherwise(0)
    leveled = steps.withColumn("depth", depth)
    nth = F.row_number().over(Window.partitionBy("doc_id", "part", "cid", "depth", "step").orderBy("idx", "k"))
    numbered = leveled.withColumn("nth", nth)
    keys = ["doc_id", "part", "cid", "depth", "nth"]
    a = numbered.where("step = 1").select(*keys, F.col("idx").alias("start"), "sentence_id")
    b = numbered.where("step = -1").select(*keys, F.col("idx").alias("end"), F.col("sentence_id").alias("end_sentence"))
    return a.join(b, keys, "full_outer").select("doc_id", "part", "cid", "start", "end", "sentence_id", "end_sentence")


def mention_gates(found: DataFrame) -> DataFrame:
    """kind, n: open brackets, closings without opening, spans over sentences, spans in two clusters."""
    twice = found.where("start IS NOT NULL AND end IS NOT NULL").groupBy("doc_id", "part", "start", "end").agg(F.count_distinct("cid").alias("n")).where("n > 1").agg(F.count("*").alias("in_two_clusters"))
    row = found.agg(
        F.count_if(F.col("end").isNull()).alias("unclosed"), F.count_if(F.col("start").isNull()).alias("close_without_open"), F.count_if(F.col("sentence_id") != F.col("end_sentence")).alias("cross_sentence")
    ).crossJoin(F.broadcast(twice))  # one row each
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in row.columns))).alias("x")).select("x.*")


def slice_documents(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """All lines of the documents whose id is listed, begin and end lines too, in file order (path, line_no)."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(BEGIN), F.regexp_extract("line", BEGIN, 1))
    closed = F.sum(F.col("line").rlike(END).cast("int")).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    began = F.sum(F.col("line").rlike(BEGIN).cast("int")).over(w)
    inside = lines.withColumn("doc_id", F.last(head, ignorenulls=True).over(w)).where(F.col("doc_id").isNotNull()).withColumn("b", began).withColumn("e", F.coalesce(closed, F.lit(0))).where("b > e")
    return inside.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("path", "line_no", "line")


def rewrite_coref(block_lines: DataFrame, markers: DataFrame) -> DataFrame:
    """Lines with their last column replaced: - or the marker of (path, line_no). markers: path, line_no, coref."""
    token = (F.trim("line") != "") & ~F.col("line").startswith("#")
    j = block_lines.join(markers, ["path", "line_no"], "left")
    new = F.concat(F.regexp_extract("line", r"^(.*\s)\S+\s*$", 1), F.coalesce("coref", F.lit("-")))
    return j.select("path", "line_no", F.when(token, new).otherwise(F.col("line")).alias("line"))
