"""Fragment sets: ordering by in-band key, completeness, consistency checks and extent tiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.asof import first_at_or_after, latest_at_or_before
from tracewell.plans.prefix import Running, bucket_of, computed_once, row_numbers, running

OUTLIER_RATIO = 16.0
PREVIEW = 12

#: Keys and positions per ordering bucket; one huge set is ordered bucket by bucket.
KEY_BUCKET = 1 << 20
POSITION_BUCKET = 1 << 30


def order_fragments(
    fragments: DataFrame, keys: Sequence[str] = ("set_id",), key_bucket: int = KEY_BUCKET
) -> DataFrame:
    """Number fragments by ``(key, image_offset)`` and place each at the running length of those before."""
    specs = [
        Running("__before", "sum", F.lit(1).cast("long")),
        Running("file_offset", "sum", F.col("length").cast("long")),
    ]
    placed = running(fragments, keys, bucket_of("key", key_bucket), ["key", "image_offset"], specs)
    return placed.withColumn("seq", F.col("__before") + 1).drop("__before")


def duplicate_keys(fragments: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Keys that more than one fragment of a set claims."""
    counted = fragments.groupBy(*keys, "key").agg(F.count("*").alias("claims"))
    return counted.where(F.col("claims") > 1)


def missing_key_ranges(
    fragments: DataFrame, keys: Sequence[str] = ("set_id",), key_bucket: int = KEY_BUCKET
) -> DataFrame:
    """Holes between the first and last present key of each set, as inclusive ranges."""
    present = fragments.select(*keys, F.col("key").cast("long").alias("key")).distinct()
    stepped = running(present, keys, bucket_of("key", key_bucket), ["key"], [Running("__prev", "last", F.col("key"))])
    return stepped.where(F.col("key") > F.col("__prev") + 1).select(
        *keys, (F.col("__prev") + 1).alias("first_missing"), (F.col("key") - 1).alias("last_missing")
    )


def missing_keys(fragments: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Every absent key as a row. A lost leading fragment is not noticed.

    Long holes are cut into pieces of a million keys first, so an untrusted key cannot make one
    task build an enormous array.
    """
    ranges = missing_key_ranges(fragments, keys)
    piece = 1 << 20
    starts = F.explode(F.sequence("first_missing", "last_missing", F.lit(piece).cast("long")))
    cut = ranges.select(*keys, "last_missing", starts.alias("__from"))
    stop = F.least(F.col("last_missing"), F.col("__from") + piece - 1)
    return cut.select(*keys, F.explode(F.sequence(F.col("__from"), stop)).alias("missing_key"))


def upper_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str, bucket: int = 1 << 16
) -> DataFrame:
    """Element ``n div 2`` (0-based) of the sorted values per key, from counts of distinct values."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(value).cast("long").alias("__v")).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    summed = running(counts, keys, bucket_of("__v", bucket), ["__v"], [Running("__upto", "sum", F.col("__n"))], inclusive=True)
    reached = summed.join(totals, keys).where(F.col("__upto") > F.expr("__total div 2"))
    return reached.groupBy(*keys).agg(F.min("__v").alias(out), F.max("__total").alias("n"))


def outliers(fragments: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """The largest fragment of each set of three or more that exceeds 16 times the upper median."""
    keys = list(keys)
    medians = upper_median(fragments, keys, "length", "median").where((F.col("n") >= 3) & (F.col("median") > 0))
    large = fragments.join(medians, keys).where(F.col("length") > F.col("median") * OUTLIER_RATIO)
    # Among equally long offenders the first in key order is named.
    rank = F.struct(F.col("length").alias("l"), (-F.col("key")).alias("k"), (-F.col("image_offset")).alias("o"))
    return large.groupBy(*keys).agg(
        F.max_by("label", rank).alias("label"), F.max("length").alias("length"), F.max("median").alias("median")
    )


def projection_check(fragments: DataFrame, keys: Sequence[str] = ("set_id",)) -> DataFrame:
    """Decode-time identity over pairs with consecutive keys, by an equi-join on the next key.

    Per set: usable fragments, confirmed pairs up to the first break, and the first break if any.
    """
    keys = list(keys)
    usable = fragments.where(F.col("decode_time").isNotNull() & (F.coalesce("duration_sum", F.lit(0)) != 0))
    left = usable.select(
        *keys, "key", "label", (F.col("decode_time") + F.col("duration_sum")).alias("predicted"), (F.col("key") + 1).alias("__next")
    )
    right = usable.select(*keys, F.col("key").alias("__next"), F.col("label").alias("next_label"), F.col("decode_time").alias("next_decode"))
    pairs = left.join(right, [*keys, "__next"])
    broken = F.col("predicted") != F.col("next_decode")
    verdict = pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.min_by(
            F.struct("key", "label", "predicted", "next_label", "next_decode"), F.when(broken, F.col("key"))
        ).alias("first_break"),
    )
    counts = usable.groupBy(*keys).agg(F.count("*").alias("usable"))
    return counts.join(verdict, keys, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)).cast("long"))


def tile_extents(
    fragments: DataFrame, regions: DataFrame, keys: Sequence[str] = ("set_id",), bucket_bytes: int = POSITION_BUCKET
) -> DataFrame:
    """Grow each fragment of a contiguous layout to the start of the next one, the last to ``region_end``."""
    keys = list(keys)
    nexts = running(
        fragments, keys, bucket_of("image_offset", bucket_bytes), ["image_offset", "key"],
        [Running("__next", "last", F.col("image_offset"))], descending=True,
    ).join(regions.select(*keys, "region_end"), keys, "left")
    stop = F.coalesce("__next", "region_end")
    grown = F.greatest(F.col("length").cast("long"), stop - F.col("image_offset"))
    return nexts.withColumn("length", grown).select(*fragments.columns)


def _number(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def reassemble(fragments: DataFrame, keys: Sequence[str] = ("set_id",), require_contiguous: bool = True, notes: bool = True) -> DataFrame:
    """Verdict per set: order evidence, completeness, notes, and the refusal if it cannot be trusted.

    Refusals in order: several identities, a duplicate key, missing fragments of a dense sequence, a
    decode-time break. Extents of accepted sets come from :func:`order_fragments`. Holes, medians and claims only
    word the notes; a caller that wants none is spared them.
    """
    keys = list(keys)
    at = F.struct("key", "image_offset")
    # Every part of the verdict reads the fragments; computing them must not be repeated with each.
    fragments = computed_once(fragments)
    base = fragments.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.countDistinct("grp").alias("identities"),
        F.min_by("key_kind", at).alias("key_kind"),
        F.min_by("key_source", at).alias("key_source"),
        F.sum("length").alias("bytes"),
    )
    # Between the first and last of n distinct keys, all but n are absent.
    absent = F.max("key").cast("long") - F.min("key").cast("long") + 1 - F.count("key")
    present = fragments.groupBy(*keys, "key").agg(F.count("*").alias("claims")).groupBy(*keys).agg(
        F.min(F.when(F.col("claims") > 1, F.col("key"))).alias("dup_key"), absent.alias("missing_count")
    )
    joined = base.join(present, keys, "left").join(projection_check(fragments, keys), keys, "left")
    if notes:
        joined = _noted(joined, fragments, present.select(*keys, "dup_key"), keys)
    missing = F.coalesce("missing_count", F.lit(0)).cast("long")
    timecode = F.col("key_kind") == "timecode"
    lost = ~timecode & (missing > 0)
    brk = F.col("first_break")
    refusal = (
        F.when(
            F.col("identities") > 1,
            F.concat(F.lit("fragments carry "), _number("identities"), F.lit(" different identities; they are not all from one file")),
        )
        .when(F.col("dup_key").isNotNull(), F.concat(F.lit("duplicate logical key "), _number("dup_key")))
        .when(lost & F.lit(require_contiguous), F.concat(_number(missing), F.lit(" fragment(s) are missing")))
        .when(
            brk.isNotNull(),
            F.concat(
                brk["label"], F.lit(" ends at decode time "), _number(brk["predicted"]), F.lit(" but "), brk["next_label"],
                F.lit(" starts at "), _number(brk["next_decode"]), F.lit("; the fragments are not consecutive"),
            ),
        )
    )
    one, sound = F.col("identities") <= 1, (F.col("identities") <= 1) & F.col("dup_key").isNull()
    reached = sound & ~(lost & F.lit(require_contiguous)) & (F.col("n") >= 2)
    more = F.when(missing > PREVIEW, F.concat(F.lit(" (+"), _number(missing - PREVIEW), F.lit(" more)"))).otherwise(F.lit(""))
    usable, pairs = F.coalesce("usable", F.lit(0)), F.coalesce("pairs", F.lit(0))
    noted = F.lit(None).cast("array<string>") if not notes else F.array_compact(
        F.array(
            F.when(one, F.concat(_number("n"), F.lit(" fragment(s) ordered by "), F.col("key_source"))),
            F.when(
                one & F.col("outlier").isNotNull(),
                F.concat(
                    F.lit("fragment "), F.col("outlier.label"), F.lit(" is "), _number("outlier.length"),
                    F.lit(" bytes against a median of "), _number("outlier.median"), F.lit("; the pairing is probably wrong"),
                ),
            ),
            F.when(
                one & F.col("dup_key").isNotNull(),
                F.concat(F.lit("fragments "), F.col("dup_a"), F.lit(" and "), F.col("dup_b"), F.lit(" both claim key "), _number("dup_key")),
            ),
            F.when(
                sound & timecode & (missing > 0),
                F.concat(
                    F.lit("timecodes jump between clusters (largest step "), _number("widest"),
                    F.lit("); the recording skipped time, which is normal for a recorder that drops frames"),
                ),
            ),
            F.when(
                sound & timecode,
                F.lit("timecode keys are checked for monotonicity, not contiguity: a skipped frame is not a lost fragment"),
            ),
            F.when(
                sound & lost,
                F.concat(F.lit("keys "), F.col("preview"), more, F.lit(" are absent, so the file is incomplete")),
            ),
            F.when(
                reached & (usable < 2),
                F.lit("no decode-time projection is available for this container; ordering rests on the in-band key alone"),
            ),
            F.when(
                reached & (usable >= 2) & brk.isNull() & (pairs > 0),
                F.concat(F.lit("decode-time projection confirmed across "), _number(pairs), F.lit(" consecutive pair(s)")),
            ),
            F.when(
                reached & (usable >= 2) & (pairs == 0), F.lit("no consecutive pair had a decode-time projection to check")
            ),
        )
    )
    return joined.select(
        *keys,
        "n",
        F.col("key_source").alias("ordered_by"),
        F.when(sound, ~lost).otherwise(F.lit(True)).alias("complete"),
        F.when(sound & lost, missing).otherwise(F.lit(0)).cast("long").alias("missing_count"),
        refusal.alias("refusal"),
        F.when(refusal.isNull(), F.col("bytes")).otherwise(F.lit(0)).cast("long").alias("bytes"),
        noted.alias("notes"),
    )


def _noted(joined: DataFrame, fragments: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """What the notes of a verdict quote: the widest hole, the first absent keys, an outlier and who claims a key twice."""
    holes = missing_key_ranges(fragments, keys)
    gaps = holes.groupBy(*keys).agg((F.max(F.col("last_missing") - F.col("first_missing") + 1) + 1).alias("widest"))
    preview = (
        holes.withColumn("__stop", F.least(F.col("last_missing"), F.col("first_missing") + PREVIEW - 1))
        .select(*keys, F.explode(F.sequence("first_missing", "__stop")).alias("k"))
    )
    claims = _first_two_claims(fragments, repeated.where(F.col("dup_key").isNotNull()), keys).drop("dup_key")
    odd = outliers(fragments, keys).select(*keys, F.struct("label", "length", "median").alias("outlier"))
    for part in (claims, gaps, _smallest(preview, keys, "k", PREVIEW), odd):
        joined = joined.join(part, keys, "left")
    return joined


def _first_two_claims(fragments: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of the first two fragments that claim a set's lowest duplicated key, by image offset."""
    same = fragments.join(repeated, keys).where(F.col("key") == F.col("dup_key"))
    first = same.groupBy(*keys, "dup_key").agg(
        F.min(F.struct("image_offset", "label")).alias("__a"), F.count("*").alias("__n")
    )
    rest = same.join(first, [*keys, "dup_key"]).where(F.struct("image_offset", "label") > F.col("__a"))
    second = rest.groupBy(*keys).agg(F.min(F.struct("image_offset", "label")).alias("__b"))
    both = first.join(second, keys, "left")
    return both.select(
        *keys, "dup_key", F.col("__a.label").alias("dup_a"), F.coalesce("__b.label", "__a.label").alias("dup_b")
    )


def _smallest(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The ``k`` smallest values per key as text, ranked inside hash slices before they meet."""
    sliced = df.withColumn("__s", F.pmod(F.xxhash64(value), F.lit(32)))
    inner = Window.partitionBy(*keys, "__s").orderBy(value)
    outer = Window.partitionBy(*keys).orderBy(value)
    few = sliced.withColumn("__r", F.row_number().over(inner)).where(F.col("__r") <= k)
    few = few.withColumn("__r", F.row_number().over(outer)).where(F.col("__r") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda v: v.cast("string")), ", ")
    return few.groupBy(*keys).agg(joined.alias("preview"))


def chunk_extents(runs: DataFrame, sizes: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """``(keys, chunk, offset, length)`` from sample-to-chunk runs, sample sizes and chunk offsets.

    A run covers its first chunk up to the next run's; the last is open-ended. A chunk is as long as
    the samples that fall into it. Chunks without bytes are left out.
    """
    keys = list(keys)
    width = KEY_BUCKET
    governed = latest_at_or_before(
        chunks, runs, keys, F.col("chunk"), "first_chunk", F.col("samples_per_chunk"), "spc", width=width
    ).where(F.col("spc").isNotNull())
    started = running(governed, keys, bucket_of("chunk", width), ["chunk"], [Running("first_sample", "sum", F.col("spc"))])
    started = started.withColumn("first_sample", F.col("first_sample") + 1)
    # A chunk's offset travels with it, so that the chunks are not numbered and joined a second time.
    homed = latest_at_or_before(
        sizes, started, keys, F.col("sample"), "first_sample", F.struct("chunk", "first_sample", "spc", "offset"), "home", width=width
    ).where(F.col("sample") < F.col("home.first_sample") + F.col("home.spc"))
    lengths = homed.groupBy(*keys, F.col("home.chunk").alias("chunk"), F.col("home.offset").alias("offset")).agg(F.sum("size").alias("length"))
    return lengths.where(F.col("length") > 0)


def sample_table_check(
    tracks: DataFrame, runs: DataFrame, sizes: DataFrame, chunks: DataFrame, extents: DataFrame | None = None
) -> DataFrame:
    """``reason`` per track: the first invariant its sample table breaks, null when it holds.

    ``tracks`` is ``(track_id, handler, sample_count, sample_size, stts_count, file_size)``;
    ``sample_size`` 0 means sizes are listed one by one, a null ``file_size`` skips the extent checks.
    """
    key = ["track_id"]
    ordered = running(runs, key, bucket_of("run", KEY_BUCKET), ["run"], [Running("__prev", "last", F.col("first_chunk"))])
    run_facts = ordered.groupBy(*key).agg(
        F.min_by("first_chunk", "run").alias("starts_at"),
        F.bool_or(F.coalesce(F.col("first_chunk") <= F.col("__prev"), F.lit(False))).alias("unordered"),
        F.min("samples_per_chunk").alias("least_spc"),
    )
    chunk_facts = chunks.groupBy(*key).agg(
        F.count("*").alias("n_chunks"), F.min("offset").alias("media_start")
    )
    size_facts = sizes.groupBy(*key).agg(F.count("*").alias("n_sizes"))
    # Described samples: each run's chunk span, the last one closed by the number of chunks.
    nexts = running(
        runs, key, bucket_of("run", KEY_BUCKET), ["run"], [Running("__next", "last", F.col("first_chunk"))], descending=True
    ).join(chunk_facts.select(*key, "n_chunks"), key)
    span = F.coalesce(F.col("__next") - F.col("first_chunk"), F.greatest(F.lit(0), F.col("n_chunks") - F.col("first_chunk") + 1))
    described = nexts.groupBy(*key).agg(F.sum(span * F.col("samples_per_chunk")).alias("described"))
    extents = chunk_extents(runs, sizes, chunks) if extents is None else extents
    ends = extents.groupBy(*key).agg(F.max(F.col("offset") + F.col("length")).alias("media_end"))
    facts = tracks
    for part in (run_facts, chunk_facts, size_facts, described, ends):
        facts = facts.join(part, key, "left")
    c = F.col
    label = F.concat(F.lit("track "), _number("track_id"), F.lit(" ("), c("handler"), F.lit("): "))
    listed = F.coalesce("n_sizes", F.lit(0))
    reason = (
        F.when(c("sample_count") == 0, F.lit("declares zero samples"))
        .when(c("starts_at").isNull(), F.lit("no sample-to-chunk table"))
        .when(c("n_chunks").isNull(), F.lit("no chunk offset table"))
        .when(
            (c("sample_size") == 0) & (listed != c("sample_count")),
            F.concat(F.lit("stsz declares "), _number("sample_count"), F.lit(" samples but lists "), _number(listed), F.lit(" sizes")),
        )
        .when(
            c("stts_count").isNotNull() & (c("stts_count") != c("sample_count")),
            F.concat(
                F.lit("stts accounts for "), _number("stts_count"), F.lit(" samples but stsz declares "), _number("sample_count"),
                F.lit(" -- this moov is not the index for this data"),
            ),
        )
        .when(c("starts_at") != 1, F.concat(F.lit("stsc first_chunk starts at "), _number("starts_at"), F.lit(", not 1")))
        .when(c("unordered"), F.lit("stsc first_chunk is not strictly ascending"))
        .when(c("least_spc") <= 0, F.lit("stsc declares a non-positive samples_per_chunk"))
        .when(
            c("described") < c("sample_count"),
            F.concat(
                F.lit("stsc describes "), _number("described"), F.lit(" samples, fewer than the "), _number("sample_count"),
                F.lit(" stsz declares"),
            ),
        )
        .when(
            (c("media_start") < 0) | (c("media_start") >= c("file_size")),
            F.concat(
                F.lit("first chunk offset "), _number("media_start"), F.lit(" is outside the "), _number("file_size"), F.lit("-byte file")
            ),
        )
        .when(
            c("media_end") > c("file_size"),
            F.concat(
                F.lit("last sample ends at "), _number("media_end"), F.lit(", past the "), _number("file_size"), F.lit("-byte file end")
            ),
        )
    )
    return facts.select("track_id", F.when(reason.isNotNull(), F.concat(label, reason)).alias("reason"))


def two_fragment_match(indexes: DataFrame, media: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pair a sample-table index with the first later media box whose payload length it predicts.

    ``indexes``: ``(keys, start, index_end, media_start, media_len)``, with ``media_start`` relative to
    the file; ``media``: ``(keys, box_start, header, payload_len)``. The table must say the media
    begins right behind the index. A box that already follows the index needs no reassembly.
    """
    keys = list(keys)
    adjacent = F.col("media_start") == F.col("index_end") - F.col("start") + 8
    wanted = indexes.where(adjacent & (F.col("media_len") > 0))
    boxes = media.select(*keys, F.col("payload_len").alias("media_len"), "box_start", F.struct("box_start", "header").alias("__box"))
    found = first_at_or_after(
        wanted, boxes, [*keys, "media_len"], F.col("index_end"), "box_start", F.col("__box"), "box", width=POSITION_BUCKET
    )
    paired = found.where(F.col("box").isNotNull() & (F.col("box.box_start") != F.col("index_end")))
    return paired.select(
        *indexes.columns,
        F.col("box.box_start").alias("box_start"),
        (F.col("media_len") + F.col("box.header")).alias("box_size"),
        (F.col("box.box_start") - F.col("index_end")).alias("gap_bytes"),
    )


def resolve_index_base(index_rows: DataFrame, chunks: DataFrame, bases: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Whether index rows are relative to the media list or to the file: the strictly better hit count wins.

    ``index_rows``: ``(keys, row, chunk_id, offset, is_list)``; ``chunks``: ``(keys, offset, fourcc,
    list_type)``; ``bases``: ``(keys, base)``. No winner, or no hit at all, resolves nothing.
    """
    keys = list(keys)
    rows = index_rows.join(bases, keys, "left").withColumn("base", F.coalesce("base", F.lit(0)))
    both = rows.select(
        *keys, "row", "chunk_id", "is_list", "base",
        F.explode(F.array(
            F.struct(F.lit("relative").alias("mode"), (F.col("base") + F.col("offset")).alias("at")),
            F.struct(F.lit("absolute").alias("mode"), F.col("offset").alias("at")),
        )).alias("m"),
    ).select(*keys, "row", "chunk_id", "is_list", "base", "m.mode", F.col("m.at").alias("__at"))
    heads = chunks.select(*keys, F.col("offset").alias("__at"), "fourcc", "list_type")
    listed = F.col("is_list") & (F.col("fourcc").isin("LIST", "rec ", "movi") | (F.col("list_type") == F.col("chunk_id")))
    hit = F.coalesce((F.col("fourcc") == F.col("chunk_id")) | listed, F.lit(False))
    counted = both.join(heads, [*keys, "__at"], "left").groupBy(*keys).agg(
        F.count_if(hit & (F.col("mode") == "relative")).alias("hits_relative"),
        F.count_if(hit & (F.col("mode") == "absolute")).alias("hits_absolute"),
        F.count_if(F.col("mode") == "absolute").alias("entries"),
        F.max("base").alias("base"),
    )
    mode = F.when(F.col("hits_relative") > F.col("hits_absolute"), F.lit("relative")).when(
        F.col("hits_absolute") > F.col("hits_relative"), F.lit("absolute")
    )
    return counted.select(
        *keys, "entries", "hits_relative", "hits_absolute", mode.alias("base_mode"),
        F.when(mode == "relative", F.col("base")).when(mode == "absolute", F.lit(0)).cast("long").alias("base"),
    )


# Limits of the two-piece heuristic.
BIFRAGMENT_SEARCH = 4 * 1024 * 1024
BIFRAGMENT_MAX_FILE = 10 * 1024 * 1024
BIFRAGMENT_ENTROPY = 2.5


def bifragment_match(heads: DataFrame, footers: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Pair a head without a footer with the first footer behind its search start.

    ``heads``: ``(keys, search_start, head_len, head_entropy, has_footer)``; ``footers``:
    ``(keys, offset, footer_len)``. Entropy of the tail is compared by :func:`bifragment_accept`
    once its bytes are read.
    """
    found = first_at_or_after(
        heads.where(~F.col("has_footer") & (F.col("head_len") > 0)), footers, keys, F.col("search_start"), "offset",
        F.struct("offset", "footer_len"), "hit", width=POSITION_BUCKET,
    )
    tail = F.col("hit.offset") + F.col("hit.footer_len") - F.col("search_start")
    return found.where(F.col("hit").isNotNull() & (tail <= BIFRAGMENT_SEARCH)).select(
        *heads.columns, tail.alias("tail_len")
    ).where(F.col("head_len") + F.col("tail_len") <= BIFRAGMENT_MAX_FILE)


def bifragment_accept(matches: DataFrame, head_entropy: str = "head_entropy", tail_entropy: str = "tail_entropy") -> DataFrame:
    """Keep pairs whose two pieces have comparable entropy."""
    return matches.where(F.abs(F.col(head_entropy) - F.col(tail_entropy)) <= BIFRAGMENT_ENTROPY)


def number_files(files: DataFrame, keys: Sequence[str] = ("image_id",), order: Sequence[str] = ("offset",), bucket_bytes: int = POSITION_BUCKET) -> DataFrame:
    """``carved_00001`` style identifiers per image in the given order."""
    numbered = row_numbers(files, keys, bucket_of(order[0], bucket_bytes), list(order), "__no")
    digits = F.col("__no").cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)
    return numbered.withColumn("file_id", F.concat(F.lit("carved_"), padded)).drop("__no")
