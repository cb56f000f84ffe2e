"""Quality rules, by DataFrame functions alone.

Within a document: few words, and words in repeated three-word windows.  Across
documents: each line is normalised and hashed; per host (``source``) the
documents that hold it are counted, a document once; lines held by more than
``max_docs`` documents and more than ``max_share`` of the host's documents are
boilerplate, and lines held by more than ``enough_docs`` are on any host.  A
document that keeps too few of its words without them is rejected; ``cleaned``
takes them out of the texts.

The counts are partial sums before the shuffle, one row per task and line, so a
line that a third of all documents hold is a few rows.  Lines above the limit
are joined back to the documents' lines; the join splits its skewed partitions.

Repeated windows are found per document by sorting packed numbers: the high
bits of a window's hash above its position.  Neighbours with equal hash bits
are candidates; they count as repeated only where their words are equal, and a
text whose packed numbers can't decide (equal bits of different windows, or
more windows than positions fit) is grouped by the windows themselves.

Defined cases: null text has no words and fails; a null source is a host of its
own; each row is a document, so equal rows count as several; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line is boilerplate on a host when more documents than this hold it, and more than this share of the host's.
MAX_DOCS, MAX_SHARE = 20, 0.02
#: More documents than this are enough on any host, however large.
ENOUGH_DOCS = 1000
#: A document is depleted when fewer of its words are left, or a smaller share of them.
LEFT_WORDS, LEFT_SHARE = 30, 0.5
_POSITION_BITS = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.  ``words`` must be a column, not an expression."""
    n = F.size(words)
    last = n - 3  # of the windows, from 0
    numbers = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.sort_array(F.transform(numbers, lambda i: F.shiftleft(F.shiftright(key(i), _POSITION_BITS), _POSITION_BITS).bitwiseOR(i.cast("long"))))
    return packed


def _line_hash(line: Column) -> Column:
    """Of a line in lower case, white space made one space, digits made one 0."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))), "[0-9]+", "0"), "^ | $", ""))


def _filled(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")


def _lines(filled: Column) -> Column:
    return F.transform(filled, lambda x: F.struct(_line_hash(x).alias("h"), F.size(_words(x)).alias("n")))


def _same(words: Column, a: Column, b: Column) -> Column:
    at = lambda i, k: F.get(words, i + k)
    return (at(a, 0) == at(b, 0)) & (at(a, 1) == at(b, 1)) & (at(a, 2) == at(b, 2))


def signals(docs: DataFrame) -> DataFrame:
    """Of each row: row (its number), doc_id, source, lines (distinct hashes with their words), and the counts within the document."""
    t = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("words", _words(t)).withColumn("filled", _filled(t))
    low = (1 << _POSITION_BITS) - 1
    pos = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    bits = lambda x: F.shiftright(x, _POSITION_BITS)
    out = out.withColumn("n", F.size("words")).withColumn("packed", F.when(F.col("n") >= 4, _repeat_words(F.col("words"))).otherwise(F.array().cast("array<bigint>")))
    p, w = F.col("packed"), F.col("words")
    # the places in ``packed`` whose left neighbour has the same hash bits
    pairs = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: bits(F.get(p, i)) == bits(F.get(p, i - 1)))
    out = out.withColumn("pairs", F.when(F.size(p) > 1, pairs).otherwise(F.array().cast("array<int>")))
    pair = F.col("pairs")
    odd = (F.col("n") > low) | F.exists(pair, lambda i: ~_same(w, pos(F.get(p, i)), pos(F.get(p, i - 1))))
    plain = F.array_sort(F.array_distinct(F.flatten(F.transform(pair, lambda i: F.array(pos(F.get(p, i)), pos(F.get(p, i - 1)))))))
    # by the windows themselves: sorted (window, position), each equal to a neighbour
    out = out.withColumn("odd", F.when(F.size(p) > 0, odd).otherwise(F.lit(False)))
    grouped = F.when(F.col("odd"), F.array_sort(F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.slice(w, i + 1, 3).alias("x"), i.alias("i")))))
    out = out.withColumn("sorted", grouped)
    s = F.col("sorted")
    exact = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (F.get(s, i)["x"] == F.get(s, i - 1)["x"]) | (F.get(s, i)["x"] == F.get(s, i + 1)["x"])), lambda i: F.get(s, i)["i"]))
    out = out.withColumn("again", F.when(F.col("odd"), exact).otherwise(plain))
    covered = F.aggregate(
        F.col("again"),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("sum")),
        lambda a, i: F.struct((i + 3).alias("to"), (a["sum"] + i + 3 - F.greatest(i, a["to"])).alias("sum")),
        lambda a: a["sum"],
    )
    return out.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "source",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("again") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        _lines(F.col("filled")).alias("lines"),
    )


def _hits(found: DataFrame, max_docs: int, max_share: float, enough_docs: int) -> DataFrame:
    """(row, line) of each row's boilerplate lines; ``found`` has row, source and lines."""
    hosts = found.groupBy("source").agg(F.count("*").alias("docs"))
    once = found.select("source", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    held = once.groupBy("source", "h").agg(F.count("*").alias("in_docs")).where(F.col("in_docs") > max_docs)
    common = held.join(hosts, held["source"].eqNullSafe(hosts["source"])).where((F.col("in_docs") > max_share * F.col("docs")) | (F.col("in_docs") > enough_docs)).select(held["source"].alias("host"), "h")
    each = found.select("row", "source", F.explode("lines").alias("line"))
    return each.join(common, each["source"].eqNullSafe(common["host"]) & (each["line"]["h"] == common["h"])).select("row", "line")


def report(docs: DataFrame, scratch, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, enough_docs: int = ENOUGH_DOCS, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document row: the counts, base_failed, boilerplate words, and the verdict ``kept``."""
    # written once: the line counts and the verdicts both read it, and a row's number must be the same for both
    found = scratch.write(signals(docs), "signals")
    hit = _hits(found, max_docs, max_share, enough_docs).groupBy("row").agg(F.sum("line.n").cast("long").alias("n_common"), F.count("*").alias("n_common_lines"))
    left = F.col("n_words") - F.coalesce("n_common", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("n_common").isNotNull() & ((left < left_words) | (left < left_share * F.col("n_words")))
    return (
        found.drop("lines")
        .join(hit, "row", "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), F.coalesce("n_common", F.lit(0)).alias("n_boilerplate_words"), F.coalesce("n_common_lines", F.lit(0)).alias("n_boilerplate_lines"))
    )


def without_boilerplate(text: Column, common: Column) -> Column:
    """The text without the lines whose hashes ``common`` (an array) holds."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(common, _line_hash(x))), "\n")


def cleaned(docs: DataFrame, scratch, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, enough_docs: int = ENOUGH_DOCS) -> DataFrame:
    """The rows, all columns as they are, with the boilerplate lines taken out of ``text``."""
    # written once: a row's number must be the same in the counts and in the join
    rows = scratch.write(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = rows.select("row", F.col("source").cast("string").alias("source"), _lines(_filled(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("lines"))
    gone = _hits(found, max_docs, max_share, enough_docs).groupBy("row").agg(F.collect_set("line.h").alias("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(without_boilerplate(F.col("text"), F.col("gone")))
    return rows.join(gone, "row", "left").withColumn("text", text).select(*docs.columns)
