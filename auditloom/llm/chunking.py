"""Problem 3: texts over a limit as pieces that end at natural boundaries and overlap.

One regular expression with bounded quantifiers takes the pieces: its alternatives stand in the order of the
boundaries' strength, each consumes up to the room and must end at its boundary, and the last takes characters.
The overlap comes from looking back from each piece's offset. All of it is Spark's own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3000, 200
BLANKS = " \t\r\n"
#: Separators by falling strength; a unit is what lies between two of them.
SEPARATORS = (
    ("paragraph", r"\r?\n[ \t\r]*\n[ \t\r\n]*"),
    ("line", r"\r?\n"),
    ("sentence", r"(?<=[.!?])[ \t\r\n]+"),
    ("word", r"[ \t\r\n]+"),
)


def boundary(text: Column, limit: int = LIMIT) -> Column:
    """The strongest boundary at which no unit (without blanks at its ends) exceeds the limit, else ``none``."""
    found = F.lit("none")
    for name, separator in reversed(SEPARATORS):
        # a unit over the limit: more than `limit` code points between two non-blanks without a separator
        longest = F.array_max(F.transform(F.split(text, separator), lambda u: F.length(F.trim(u, F.lit(BLANKS)))))
        found = F.when(longest <= limit, F.lit(name)).otherwise(found)
    return found


def piece_pattern(room: int) -> str:
    """Pieces of at most ``room`` code points: up to the last paragraph end within it, else line, sentence, word end."""
    least = max(1, room // 4)  # a stronger boundary in the first quarter would make very short pieces
    ends = [rf"(?<=\n[ \t\r]{{0,9}}\n)(?![ \t\r]*\n)", r"(?<=\n)", r"(?<=[.!?][ \t\r\n]{1,4})(?![ \t\r\n])", r"(?<=[ \t\r\n])(?![ \t\r\n])"]
    tail = rf"[\s\S]{{1,{room}}}\z"
    return "|".join([tail, *(rf"[\s\S]{{{least},{room}}}{e}" for e in ends), rf"[\s\S]{{1,{room}}}"])


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, boundary, piece, start_pos, piece_text) of each text of more than ``limit`` code points.

    The pieces' new parts, put one after another, are the text again; each piece after the first also repeats the
    last ``overlap`` code points before it, cut forward to a word's start where one is near. start_pos is the place of
    the piece, its repeated part included. Null, empty and short texts have no row; rows with equal keys are
    treated apart. Other columns are left out, so their names can't clash.
    """
    room = limit - overlap
    own = df.select(F.col(key), F.col(text).alias("__t")).where(F.length("__t") > limit)
    parts = F.regexp_extract_all("__t", F.lit(piece_pattern(room)), F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.size("__p") - 1), lambda k: F.aggregate(F.slice("__p", F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)))
    cut = own.select(key, "__t", boundary(F.col("__t"), limit).alias("boundary"), parts.alias("__p")).withColumn("__s", starts)
    rows = cut.select(key, "__t", "boundary", F.posexplode(F.arrays_zip(F.col("__p").alias("p"), F.col("__s").alias("s"))).alias("piece", "__x"))
    back = F.expr(f"substring(__t, __x.s + 1 - least(__x.s, {overlap}), least(__x.s, {overlap}))")
    word = F.regexp_extract(back, r"^[^ \t\r\n]{0,40}[ \t\r\n]+", 0)
    lead = F.when(F.col("piece") > 0, F.expr("substring(__b, length(__w) + 1)")).otherwise(F.lit(""))
    rows = rows.withColumn("__b", back).withColumn("__w", F.when(F.length(word) < F.length("__b"), word).otherwise(F.lit(""))).withColumn("__l", lead)
    return rows.select(key, "boundary", "piece", (F.col("__x.s") - F.length("__l")).alias("start_pos"), F.concat("__l", F.col("__x.p")).alias("piece_text"))


def oversized(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, boundary) of each text that is cut: the first pieces of ``split_documents``."""
    return split_documents(df, key, text, limit, overlap).where(F.col("piece") == 0).select(key, "boundary")
