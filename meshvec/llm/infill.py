"""Fill-in-the-middle rewriting by escaped marker injection, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings of the output that open prefix, suffix and middle. A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many keep their order, and of 100 others so many begin with the suffix.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Ends a unit in the marked text, and the letter that escapes both itself and the end mark.
MARK, ESCAPE = "\u0001", "\u0002"


def marked(text: Column) -> Column:
    """The text with MARK after each unit: a run of ASCII letters, or any other code point.

    ESCAPE and MARK letters of the text become ESCAPE0 and ESCAPE1 first, which
    count as one unit each, so every MARK of the result ends a unit.
    """
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(MARK), F.lit(f"{ESCAPE}1"))
    return F.regexp_replace(escaped, f"[A-Za-z]+|{ESCAPE}.|[^A-Za-z]", f"$0{MARK}")


def unmarked(text: Column) -> Column:
    """A stretch of a marked text as it was in the text."""
    return F.replace(F.replace(F.replace(text, F.lit(MARK), F.lit("")), F.lit(f"{ESCAPE}1"), F.lit(MARK)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def units(marks: Column) -> Column:
    """How many units a marked text has."""
    return (F.char_length(marks) - F.char_length(F.replace(marks, F.lit(MARK), F.lit("")))).cast("long")


def pieces(text: Column, mark: str, count: Column | int) -> Column:
    """The first `count` pieces that mark parts, or the last -count ones."""
    return F.call_function("substring_index", text, F.lit(mark), count.cast("int") if isinstance(count, Column) else F.lit(count))


def first_units(marks: Column, k: Column) -> Column:
    return unmarked(pieces(marks, MARK, k))


def last_units(marks: Column, k: Column) -> Column:
    """The last k units. A marked text ends with MARK, so what follows its last MARK is an empty piece."""
    return unmarked(pieces(marks, MARK, -k - 1))


def restore(rows: DataFrame) -> DataFrame:
    """rows (output, form, ...) with restored, the exact text, made from these two alone.

    No part holds a marker, and a marker can't begin inside a part and end in
    the marker behind it, so the first one found is the one that was put there.
    """
    most, psm = F.lit(2**31 - 1), F.col("form") == "psm"
    kept = [c for c in rows.columns]
    rows = rows.select(*kept, F.substring("output", len(PREFIX) + 1, 2**31 - 1).alias("__body"))
    rows = rows.select("*", F.when(psm, pieces(F.col("__body"), SUFFIX, 1)).otherwise(pieces(F.col("__body"), PREFIX, 1)).alias("__first"))
    rows = rows.select(*kept, "__first", F.substring("__body", F.char_length("__first") + F.lit(len(SUFFIX) + 1), most).alias("__rest"))
    rows = rows.select("*", pieces(F.col("__rest"), MIDDLE, 1).alias("__second"))
    rows = rows.select("*", F.substring("__rest", F.char_length("__second") + F.lit(len(MIDDLE) + 1), most).alias("__middle"))
    parts = F.when(psm, F.concat("__first", "__middle", "__second")).otherwise(F.concat("__second", "__middle", "__first"))
    return rows.select(*kept, F.when(F.col("form") == "plain", F.col("output")).otherwise(parts).alias("restored"))


def draws(key: Column) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of "1:" and the key, as numbers."""
    digits = F.sha2(F.concat(F.lit("1:"), key).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units of the text), form, prefix, middle, suffix, output and restored of every document.

    The prefix ends after the smaller of two drawn numbers of units, the middle
    after the larger, the suffix is the rest. Form plain keeps the text; psm is
    prefix, suffix, middle behind their markers; spm is suffix, prefix, middle.
    Everything follows from the row alone: no shuffle, no Python, linear time,
    and a retry gives the same.

    Defined cases: a null text is empty, and an empty text is plain, with null
    prefix, middle and suffix, as every plain text; a null id draws by the word
    null and stays null; repeated rows have equal results; an empty table gives
    an empty result; further columns are not used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), marked(text).alias("marks"))
    h1, h2, h3, h4 = draws(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.select("*", units(F.col("marks")).alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    whole = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(whole, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "marks", "n", form.alias("form"), F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    cut_ = F.col("form") != "plain"
    prefix, suffix = F.when(cut_, first_units(F.col("marks"), F.col("low"))), F.when(cut_, last_units(F.col("marks"), F.col("n") - F.col("high")))
    rows = rows.select("doc_id", "text", "n", "form", prefix.alias("prefix"), suffix.alias("suffix"))
    inner = F.substring("text", F.char_length("prefix") + 1, F.char_length("text") - F.char_length("prefix") - F.char_length("suffix"))
    rows = rows.select("*", F.when(cut_, inner).alias("middle"))
    put = F.when(F.col("form") == "plain", F.col("text"))
    put = put.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    put = put.otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    rows = rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", put.alias("output"))
    return restore(rows)
