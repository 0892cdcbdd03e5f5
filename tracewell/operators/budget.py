"""Output limits: scaling a policy to a target and admitting files greedily in scan order."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.asof import latest_at_or_before
from tracewell.plans.joins import lookup
from tracewell.session import cut_lineage

MB, GB = 1 << 20, 1 << 30

#: Scan-order positions per bucket when denied files look up the budget state they met.
ORDER_BUCKET = 1 << 20


#: No limit.
NO_CAP = 1 << 62
#: Files of one image that one round judges at most, however many its cap allows.
ROUND = 100_000


@dataclass(frozen=True)
class Policy:
    """Limits of one session. Nothing is limited unless asked for; only the least confidence has a default."""

    max_output_bytes: int = NO_CAP
    max_file_bytes: int = NO_CAP
    max_files_per_category: int = NO_CAP
    max_files_per_extension: int = NO_CAP
    max_files_total: int = NO_CAP
    min_confidence: int = 60
    category_caps: dict[str, int] = field(default_factory=dict)

    def category_cap(self, category: str) -> int:
        return self.category_caps.get(category, self.max_files_per_category)

    @property
    def unlimited(self) -> bool:
        """Whether every file is admitted, whatever came before it."""
        caps = (self.max_output_bytes, self.max_file_bytes, self.max_files_per_category, self.max_files_per_extension, self.max_files_total)
        return min(*caps, *self.category_caps.values(), NO_CAP) >= NO_CAP


#: No cap at all; only the least confidence holds.
UNLIMITED = Policy()
#: Limits for a stand-alone run of one medium, for those who want some.
STAND_ALONE = Policy(256 * MB, 128 * MB, max_files_per_category=64, max_files_per_extension=32, max_files_total=512)


def policy_for_target(size: Column) -> Column:
    """``struct(max_output_bytes, max_files_total)`` scaled to the size of the searched medium."""
    eighth, thirtysecond = F.shiftright(size, 3), F.shiftright(size, 5)
    small = F.greatest(F.lit(8 * MB), F.least(eighth, F.lit(512 * MB)))
    large = F.greatest(F.lit(256 * MB), F.least(thirtysecond, F.lit(2 * GB)))
    files = F.greatest(F.lit(200), F.least(F.lit(2048), F.shiftright(size, 21)))
    positive = size > 0
    output = F.when(size >= 4 * GB, large).when(positive, small).otherwise(F.lit(256 * MB))
    return F.struct(
        output.cast("long").alias("max_output_bytes"), F.when(positive, files).otherwise(512).cast("int").alias("max_files_total")
    )


_FOLD_SCHEMA = (
    "image_id string, kind string, ord long, size long, category string, extension string, "
    "files long, bytes long, category_n long, extension_n long, digest string, cats map<string,long>, exts map<string,long>, done boolean"
)


def _fold(policy: Policy, limit: int):
    """Admit one image's next eligible files (at most ``limit`` rows) and report the state reached."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        first = pdf.iloc[0]
        files, total = int(first["files"]), int(first["bytes"])
        cats, exts = dict(first["cats"]), dict(first["exts"])
        out, taken = [], set()
        for row in pdf.itertuples(index=False):
            if files >= policy.max_files_total:
                break
            if row.digest is not None and row.digest in taken:
                continue
            cat_n, ext_n = cats.get(row.category, 0), exts.get(row.extension, 0)
            if (
                total + row.size <= policy.max_output_bytes
                and cat_n < policy.category_cap(row.category)
                and ext_n < policy.max_files_per_extension
            ):
                files, total = files + 1, total + int(row.size)
                cats[row.category], exts[row.extension] = cat_n + 1, ext_n + 1
                taken.add(row.digest)
                out.append(("admit", row.ord, row.size, row.category, row.extension, files, total, cat_n + 1, ext_n + 1, row.digest))
        done = len(pdf) < limit or files >= policy.max_files_total
        out.append(("state", pdf["ord"].iloc[-1], 0, None, None, files, total, 0, 0, None))
        frame = pd.DataFrame(
            out,
            columns=["kind", "ord", "size", "category", "extension", "files", "bytes", "category_n", "extension_n", "digest"],
        )
        frame.insert(0, "image_id", first["image_id"])
        last = [None] * (len(out) - 1)
        return frame.assign(cats=[*last, cats], exts=[*last, exts], done=[*last, done])

    return run


def _admissions(files: DataFrame, policy: Policy) -> DataFrame:
    """Admitted rows with the budget state after each.

    Admission is a fold in scan order, but a file that the state already rules out can never be
    admitted later. So each round filters the whole table by the current state, takes the next few
    hundred still-possible files per image, and folds just those. Every round either exhausts an
    image's possible files or moves its cursor; memory per image is bounded by the file cap or ``ROUND``.
    """
    take = min(policy.max_files_total, ROUND)
    sized = files.where(F.col("size") <= policy.max_file_bytes).select("image_id", "ord", "size", "category", "extension", "digest")
    empty = "map<string,long>"
    admitted: DataFrame | None = None
    state: DataFrame | None = None
    caps = F.lit(policy.max_files_per_category)
    for name, cap in policy.category_caps.items():
        caps = F.when(F.col("category") == name, F.lit(cap)).otherwise(caps)
    while True:
        if state is None:
            open_ = sized.withColumns(
                {
                    "files": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long"),
                    "cats": F.create_map().cast(empty), "exts": F.create_map().cast(empty),
                }
            )
        else:
            going = state.where(~F.col("done")).withColumnRenamed("ord", "__cursor").drop("done")
            open_ = sized.join(going, "image_id").where(F.col("ord") > F.col("__cursor")).drop("__cursor")
        possible = open_.where(
            (F.col("files") < policy.max_files_total)
            & (F.col("bytes") + F.col("size") <= policy.max_output_bytes)
            & (F.coalesce(F.try_element_at("cats", F.col("category")), F.lit(0)) < caps)
            & (F.coalesce(F.try_element_at("exts", F.col("extension")), F.lit(0)) < policy.max_files_per_extension)
        )
        if admitted is not None:
            possible = possible.join(admitted.select("image_id", "digest"), ["image_id", "digest"], "left_anti")
        possible = possible.withColumn("__slice", F.pmod(F.xxhash64("ord"), F.lit(256)))
        inner = Window.partitionBy("image_id", "__slice").orderBy("ord")
        outer = Window.partitionBy("image_id").orderBy("ord")
        nearest = (
            possible.withColumn("__rn", F.row_number().over(inner))
            .where(F.col("__rn") <= take)
            .withColumn("__rn", F.row_number().over(outer))
            .where(F.col("__rn") <= take)
            .drop("__rn", "__slice")
        )
        folded = cut_lineage(nearest.groupBy("image_id").applyInPandas(_fold(policy, take), _FOLD_SCHEMA))
        chosen = folded.where(F.col("kind") == "admit").drop("kind", "cats", "exts", "done")
        admitted = chosen if admitted is None else admitted.unionByName(chosen)
        state = folded.where(F.col("kind") == "state").select("image_id", "ord", "files", "bytes", "cats", "exts", "done")
        if state.where(~F.col("done")).isEmpty():
            return admitted


def admit_budget(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Append ``admitted`` and ``denial`` to ``files(image_id, ord, category, extension, size, ...)``.

    ``ord`` is the scan order, unique per image. Checks in order: single file size, file count, output
    bytes (an exact fit is allowed), category cap, extension cap. Denied files use no budget. With a
    ``digest`` column, a file whose digest was admitted before is passed over first.
    """
    policy = policy or Policy()
    typed = files.withColumn("image_id", F.col("image_id").cast("string"))
    if policy.unlimited:
        if "digest" not in files.columns:
            return files.withColumns({"admitted": F.lit(True), "denial": F.lit(None).cast("string")})
        first = files.where("digest IS NOT NULL").groupBy("image_id", "digest").agg(F.min("ord").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
        joined = lookup(files, first.drop("__n"), ["image_id", "digest"], F.xxhash64("ord"))
        again = F.coalesce(F.col("ord") > F.col("__first"), F.lit(False))
        denial = F.when(again, F.lit("the same payload was already written"))
        return joined.select(*files.columns, (~again).alias("admitted"), denial.alias("denial"))
    if "digest" not in files.columns:
        typed = typed.withColumn("digest", F.lit(None).cast("string"))
    admitted = cut_lineage(_admissions(typed, policy))
    state = admitted.select("image_id", F.col("ord").alias("__at"), F.struct("files", "bytes").alias("__s"))
    seen = latest_at_or_before(
        typed, state, ["image_id"], F.col("ord"), "__at", F.col("__s"), "__met", width=ORDER_BUCKET, strict=True
    )
    caps = F.lit(policy.max_files_per_category)
    for name, cap in policy.category_caps.items():
        caps = F.when(F.col("category") == name, F.lit(cap)).otherwise(caps)
    cat_closed = admitted.where(F.col("category_n") >= caps).groupBy("image_id", "category").agg(F.min("ord").alias("__cat_from"))
    ext_closed = (
        admitted.where(F.col("extension_n") >= policy.max_files_per_extension)
        .groupBy("image_id", "extension").agg(F.min("ord").alias("__ext_from"))
    )
    joined = (
        seen.join(admitted.select("image_id", "ord", F.lit(True).alias("admitted")), ["image_id", "ord"], "left")
        .join(cat_closed, ["image_id", "category"], "left")
        .join(ext_closed, ["image_id", "extension"], "left")
    )
    held = admitted.where(F.col("digest").isNotNull()).groupBy("image_id", "digest").agg(F.min("ord").alias("__same_from"))
    joined = joined.join(held, ["image_id", "digest"], "left")
    used_files, used_bytes = F.coalesce("__met.files", F.lit(0)), F.coalesce("__met.bytes", F.lit(0))

    def capped(number: Column, what: Column) -> Column:
        return F.concat(F.lit("reached the "), number.cast("string"), F.lit("-file cap for '"), what, F.lit("'"))

    denial = (
        F.when(F.col("ord") > F.col("__same_from"), F.lit("the same payload was already written"))
        .when(F.col("size") > policy.max_file_bytes, F.lit(f"single file exceeds the {policy.max_file_bytes:,} B per-file cap"))
        .when(used_files >= policy.max_files_total, F.lit(f"reached the {policy.max_files_total}-file session cap"))
        .when(used_bytes + F.col("size") > policy.max_output_bytes, F.lit(f"output budget of {policy.max_output_bytes:,} B exhausted"))
        .when(F.col("ord") > F.col("__cat_from"), capped(caps, F.col("category")))
        .when(
            F.col("ord") > F.col("__ext_from"),
            capped(F.lit(policy.max_files_per_extension), F.concat(F.lit("."), F.col("extension"))),
        )
    )
    yes = F.coalesce("admitted", F.lit(False))
    return joined.withColumn("admitted", yes).withColumn("denial", F.when(~F.col("admitted"), denial)).select(
        *files.columns, "admitted", "denial"
    )


def stop_reason(budgeted: DataFrame) -> DataFrame:
    """Per image: files and bytes admitted, denials, and the first denial in scan order."""
    return budgeted.groupBy("image_id").agg(
        F.count_if("admitted").alias("files_written"),
        F.sum(F.when(F.col("admitted"), F.col("size")).otherwise(0)).cast("long").alias("bytes_written"),
        F.count_if(~F.col("admitted")).alias("denied"),
        F.min_by("denial", F.when(~F.col("admitted"), F.col("ord"))).alias("stop_reason"),
    )


def stop_structure_pass(budgeted: DataFrame) -> DataFrame:
    """Structure-pass rows up to and including the first denial: that pass ends there."""
    first = budgeted.where(~F.col("admitted")).groupBy("image_id").agg(F.min("ord").alias("__stop"))
    joined = budgeted.join(first, "image_id", "left")
    return joined.where(F.col("__stop").isNull() | (F.col("ord") <= F.col("__stop"))).drop("__stop")
