"""Line dedup: range-partitioned line hashes, streamed in document order, answered with keep bitmaps.

Lines never travel: a line is its 128-bit key hash, its document and its position. Rows are range-partitioned by hash
and sorted by hash, document and position, and one pass over each sorted run finds the first document of every key.
Keys so common that one range could not hold them are answered before the shuffle: a sketch finds them, one map-side
combined aggregate gives their first document, and that table is bounded by ``HOT_KEYS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import ascii_lower, materialise

#: Keys answered by broadcast. Every key above a ``2 / HOT_KEYS`` share of all lines is among them.
HOT_KEYS = 1000
SKETCH_ITEMS = 8192
#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line with blanks stripped at both ends and A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _hot(rows: DataFrame) -> DataFrame:
    """(h1, h2, first_doc, last_doc) of the most common keys: at most ``HOT_KEYS`` values of h1, whatever the input."""
    common = rows.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {SKETCH_ITEMS})").alias("top")).select(F.explode("top").alias("t"))
    total = rows.agg(F.count("*").alias("total"))
    common = common.join(F.broadcast(total)).where(F.col("t.count") * HOT_KEYS > F.col("total")).select(F.col("t.item").alias("h1"))
    kept = rows.join(F.broadcast(common), "h1")
    return kept.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, pos) of every line whose key an earlier document holds too."""
    rows = materialise(_keys(docs, min_chars))
    hot = materialise(_hot(rows).coalesce(1))
    seen = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    frequent = seen.where("first_doc IS NOT NULL AND doc_id > first_doc").select("doc_id", "pos")
    rare = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    # The range partitioning by hash also serves the window; the sort it asks for is the secondary sort.
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    first = rare.repartitionByRange("h1", "h2").withColumn("first_doc", F.first("doc_id").over(stream))
    return first.where("doc_id > first_doc").select("doc_id", "pos").unionByName(frequent)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, n_dropped, words): word w holds the dropped lines 64 w to 64 w + 63, lowest bit first.

    Only documents that lose lines have a row, and ``words`` ends with the last word that has a bit: bits beyond it
    and documents without a row keep every line. ``docs`` needs doc_id (unique, not null) and text.
    """
    dropped = dropped_lines(docs, min_chars)
    bit = F.expr("shiftleft(1L, pos % 64)")
    packed = dropped.groupBy("doc_id", F.expr("pos div 64").cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    words = packed.groupBy("doc_id").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")
    )
    dense = F.expr("transform(sequence(0, array_max(map_keys(m))), w -> coalesce(m[w], 0L))")
    return words.select("doc_id", "n_dropped", dense.alias("words"))


def _kept_text(words: Column) -> Column:
    def stays(_: Column, i: Column) -> Column:
        word = F.get(words, F.floor(i / 64).cast("int"))
        return word.isNull() | (F.getbit(word, F.pmod(i, F.lit(64)).cast("int")) == 0)

    return F.array_join(F.filter(F.split("_dedup_text", "\n"), stays), "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with ``text`` less the lines that an earlier document holds, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of blanks and with A-Z lower-cased. Keys of at least ``min_chars`` code points
    found in two documents or more stay only in the smallest doc_id that holds them, repeats inside it included.
    A null or empty text is one empty line; a null text becomes the empty text. Rows with a null doc_id keep all their
    lines. Other columns pass through; ``n_lines`` and ``n_dropped`` replace columns of these names. An empty table
    gives an empty table. doc_id must be unique; exact repeats of a row count as one document.
    """
    text = docs.withColumn("_dedup_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    known = text.where("doc_id IS NOT NULL").select("doc_id", F.col("_dedup_text").alias("text"))
    maps = keep_bitmaps(known, min_chars).select("doc_id", F.col("n_dropped").alias("_dedup_n"), F.col("words").alias("_dedup_words"))
    joined = text.join(maps, "doc_id", "left")
    kept = F.when(F.col("_dedup_words").isNull(), F.col("_dedup_text")).otherwise(_kept_text(F.col("_dedup_words")))
    return joined.withColumns({
        "text": kept,
        "n_lines": F.size(F.split("_dedup_text", "\n")).cast("long"),
        "n_dropped": F.coalesce("_dedup_n", F.lit(0)).cast("long"),
    }).drop("_dedup_text", "_dedup_n", "_dedup_words")
