"""Formats made of lines, as plans over (path, policy, lineno, line): paragraphs, logs, underlined titles and saved sessions.

Lines end at a line feed, a carriage return or both. Each file is a window of its own; a file comes from one binary cell, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What marks a line that starts with a time, a line of adornment, and a turn of a session; how far a session's first mark may lie.
TIME = r"^\s*\[?(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
ADORNED = r"^([=\-~^\"#*+.:'`_])\1{2,}\s*$"
TURN = r"^=== (Human|Assistant) ===\s*$"
SESSION_HEAD = 4096

FILE = ("path", "policy")
BLANKS = " \t\r\n\f\x0b"


def text_of(content: Column) -> Column:
    """The text of a file; bytes that are no UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def file_lines(texts: DataFrame) -> DataFrame:
    """(path, policy, lineno, line) of ``texts`` (path, policy, text); a line end at the end of a text begins no further line."""
    each = texts.select(*FILE, F.posexplode(F.split(F.regexp_replace("text", r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")).alias("at", "line"))
    return each.select(*FILE, (F.col("at") + 1).alias("lineno"), "line")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def _said(line: Column) -> Column:
    return line.rlike(rf"[^{BLANKS}]")


def _joined() -> Column:
    """The lines of a group in their order."""
    return stripped(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lineno", "line"))), lambda x: x["line"]), "\n"))


def _numbered(pieces: DataFrame, letter: str) -> DataFrame:
    """Pieces (…file, first, last, text) named by ``letter`` and their number; pieces without text are not numbered."""
    kept = pieces.where(F.col("text") != "")
    return kept.withColumn("name", F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(*FILE).orderBy("first"))))


def _piece(pieces: DataFrame, kind: str, lang: str) -> DataFrame:
    return pieces.select(*FILE, F.lit(kind).alias("kind"), "name", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "text", F.lit(lang).alias("lang"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Maximal runs of lines that are not blank."""
    said = lines.where(_said(F.col("line")))
    run = F.col("lineno") - F.row_number().over(Window.partitionBy(*FILE).orderBy("lineno"))
    runs = said.withColumn("run", run).groupBy(*FILE, "run").agg(F.min("lineno").alias("first"), F.max("lineno").alias("last"), _joined().alias("text"))
    return _piece(_numbered(runs, "b"), "block", "text")


def log_windows(lines: DataFrame, size: int) -> DataFrame:
    """Windows of ``size`` lines of the files in which a line starts with a time; the others are read as paragraphs."""
    logs = lines.where(F.col("line").rlike(TIME)).select(*FILE).distinct()
    timed = lines.join(logs, [*FILE], "left_semi").groupBy(*FILE, F.floor((F.col("lineno") - 1) / size).alias("win"))
    windows = timed.agg(F.min("lineno").alias("first"), F.max("lineno").alias("last"), _joined().alias("text"))
    return _piece(_numbered(windows, "e"), "block", "log").unionByName(paragraphs(lines.join(logs, [*FILE], "left_anti")))


def slug(title: Column) -> Column:
    """Letters, digits, underscores and hyphens of a title in lower case, at most 60; ``section`` if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(stripped(title)), r"[^\p{L}\p{N}_\- \t]", ""), r"[ \t-]+", "-")
    return F.when(kept == "", "section").otherwise(F.substring(kept, 1, 60))


def _sections(lines: DataFrame, heads: DataFrame, lang: str) -> DataFrame:
    """The lines from each head (…file, lineno, title) to the next; what stands before the first is ``_preamble``. Files without a head give nothing."""
    own = Window.partitionBy(*FILE).orderBy("lineno")
    headed = lines.join(heads.select(*FILE).distinct(), [*FILE], "left_semi").join(heads, [*FILE, "lineno"], "left")
    headed = headed.withColumn("no", F.count("title").over(own))
    parts = headed.groupBy(*FILE, "no").agg(F.min("lineno").alias("first"), F.max("lineno").alias("last"), F.max("title").alias("title"), _joined().alias("text")).where(F.col("text") != "")
    parts = parts.withColumn("base", F.when(F.col("no") == 0, "_preamble").otherwise(slug(F.col("title"))))
    before = F.row_number().over(Window.partitionBy(*FILE, "base").orderBy("first")) - 1
    return _piece(parts.withColumn("name", F.when(before > 0, F.concat("base", F.lit("-"), before)).otherwise(F.col("base"))), "section", lang)


def titled(lines: DataFrame) -> DataFrame:
    """Sections under titles that are underlined, or lie between two lines of the same adornment."""
    own = Window.partitionBy(*FILE).orderBy("lineno")
    bare = F.regexp_replace("line", rf"[{BLANKS}]+$", "")
    seen = lines.withColumn("bare", bare).withColumn("b1", F.coalesce(F.lead("bare", 1).over(own), F.lit(""))).withColumn("b2", F.coalesce(F.lead("bare", 2).over(own), F.lit("")))
    adorned = lambda c: F.col(c).rlike(ADORNED)
    between = adorned("bare") & _said(F.col("b1")) & adorned("b2") & (F.substring("bare", 1, 1) == F.substring("b2", 1, 1))
    under = _said(F.col("bare")) & adorned("b1") & (F.length("b1") >= F.length(stripped(F.col("bare"))))
    seen = seen.withColumn("between", between).withColumn("under", under)
    was = lambda c, n: F.coalesce(F.lag(c, n).over(own), F.lit(False))
    # The lines of a title open no title of their own.
    inside = was("between", 1) | was("between", 2)
    marked = seen.withColumn("inside", inside).withColumn("after", was("under", 1))
    heads = marked.where(~F.col("inside") & (F.col("between") | (F.col("under") & ~F.col("after"))))
    heads = heads.select(*FILE, "lineno", stripped(F.when(F.col("between"), F.col("b1")).otherwise(F.col("bare"))).alias("title"))
    return _sections(lines, heads, "rst")


def is_session(text: Column) -> Column:
    """Whether a mark of a turn stands near the beginning of a text."""
    return F.regexp_replace(F.substring(text, 1, SESSION_HEAD), r"\r\n?", "\n").rlike("(?md)" + TURN)


def turns(lines: DataFrame) -> DataFrame:
    """The turns of saved sessions, each with its mark; what stands before the first is left out."""
    no = F.count_if(F.col("line").rlike(TURN)).over(Window.partitionBy(*FILE).orderBy("lineno"))
    parts = lines.withColumn("no", no).where("no > 0").groupBy(*FILE, "no").agg(F.min("lineno").alias("first"), F.max("lineno").alias("last"), _joined().alias("text"))
    return _piece(parts.withColumn("name", F.concat(F.lit("m"), "no")), "section", "session")
