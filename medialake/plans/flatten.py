"""K2 + E6: move every file below a target directory up into it (plan only).

A file keeps its name unless that name is taken -- by an entry already in the
target (file or directory) or by a file placed before it (in source-path order);
then it becomes ``stem_1.ext``, ``stem_2.ext`` ... (the first free one).

Slots.  The files of one name s ask, in source order, for the slots s, s_1, s_2, ... (number 0, 1, 2).
Only two names can ever take a slot: s_k belongs to the sequence of s as number k, and is the
slot 0 of the name s_k itself.  So slot k of s is
  taken from the start if an entry of that name exists,
  taken from the moment on when the first file named s_k comes (it takes the slot, unless it is taken already),
  and otherwise free until a file named s takes it.
The files of s take free slots in ascending order, and a slot once passed over stays taken.  If the
passed-over slots of s are known, all its files get their slot by rank alone: merge the files, by their rank
among the files of s, with the passed-over slots, by the number of free slots before them; the
position in that merged order is the slot number.

Rounds.  A slot that both sequences want goes to whoever comes first, and which file of s comes to slot k depends on
the slots passed over before it.  All such contested slots are decided at once from the decisions of the
round before, until none changes.  The first contested slot of a name without a parent needs no other
decision, and each further one (and the slot 0 of a child) only earlier ones, so every round makes at
least one more of them final and the fixed point is the sequential result.

Scale.  Ranks come from the global numbering, so a hot name is spread over the cluster.  A round moves one
slim row per contested or existing slot, not files; only the files that come to a contested slot are looked up.
The contested slots of one name (names s_<n> that are present as well) are added up in order in one
sorted stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators.ranking import rank_within
from ..session import cut_lineage, drop_tables, table_scope

#: A stem that may be a renamed one: its base and its number (up to 15 digits; no file count reaches more).
_NUMBERED = r"^(?s)(.+)_([1-9][0-9]{0,14})$"


def _moves(files: DataFrame, target: str) -> DataFrame:
    prefix = target.rstrip("/") + "/"
    below = files.where(F.col("file_path").startswith(prefix)
                        & (P.dirname(F.col("file_path")) != target.rstrip("/")))
    return below.select(F.lit(target.rstrip("/")).alias("target"),
                        F.col("file_path").alias("source_path"), "file_size",
                        P.basename(F.col("file_path")).alias("file_name"))


def _existing_names(files: DataFrame, dirs: DataFrame | None, target: str) -> DataFrame:
    t = target.rstrip("/")
    direct = files.where(P.dirname(F.col("file_path")) == t).select(
        P.basename(F.col("file_path")).alias("file_name"))
    if dirs is not None:
        subdirs = dirs.where(P.dirname(F.col("dir_path")) == t).select(
            P.basename(F.col("dir_path")).alias("file_name"))
        direct = direct.unionByName(subdirs)
    return direct.distinct().select(F.lit(t).alias("target"), "file_name")


def _slot_name(name: Column, slot: Column) -> Column:
    stem, ext = P.stem(name), P.extension(name)
    return F.when(slot == 0, name).otherwise(F.concat(stem, F.lit("_"), slot.cast("string"), ext))


def _contested(ranked: DataFrame, existing: DataFrame) -> DataFrame:
    """The slots of moving names that another name or an entry may hold: (target, file_name, k, holder,
    since, fixed).  ``holder``: the name whose slot 0 this slot is (k > 0) or whose sequence contains it
    as well (k = 0); ``since``: the source path of its first file; ``fixed``: an entry has the name."""
    names = cut_lineage(ranked.groupBy("target", "file_name").agg(F.min("source_path").alias("since")), "flatten-names")
    present = (names.join(existing.withColumn("there", F.lit(True)), ["target", "file_name"], "full_outer")
               .select("target", "file_name", "since", F.coalesce("there", F.lit(False)).alias("fixed")))
    stem = P.stem(F.col("file_name"))
    number = F.regexp_extract(stem, _NUMBERED, 2)
    children = (present.where(number != "").select(
        "target", F.concat(F.regexp_extract(stem, _NUMBERED, 1), P.extension(F.col("file_name"))).alias("base"),
        number.cast("long").alias("k"), F.col("file_name").alias("holder"), "since", "fixed"))
    # Only a base that P splits into the same stem and extension numbers its files like this.
    children = children.where(_slot_name(F.col("base"), F.col("k")) == F.col("holder"))
    later = cut_lineage(children.join(names.select("target", F.col("file_name").alias("base")), ["target", "base"]), "flatten-later")
    own = present.where("fixed AND since IS NOT NULL").select("target", "file_name", "fixed")
    shared = later.where("since IS NOT NULL").select("target", F.col("holder").alias("file_name"), F.col("base").alias("parent"))
    first = (shared.join(own, ["target", "file_name"], "full_outer").select(
        "target", "file_name", F.lit(0).cast("long").alias("k"), F.col("parent").alias("holder"),
        F.lit(None).cast("string").alias("since"), F.coalesce("fixed", F.lit(False)).alias("fixed")))
    return first.unionByName(later.select("target", F.col("base").alias("file_name"), "k", "holder", "since", "fixed"))


def _passed_over(slots: DataFrame, ranked: DataFrame) -> DataFrame:
    """(target, file_name, k, before) of the slots that their name's files pass over; ``before`` is the
    number of such slots with a smaller number."""
    order = Window.partitionBy("target", "file_name").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("skip").cast("long")).over(order), F.lit(0))
    state = cut_lineage(slots.withColumn("skip", F.col("fixed") | F.col("since").isNotNull()), "flatten-round")
    made: list[str] = []
    while True:
        with table_scope() as now:
            reached = (state.withColumn("r", F.col("k") - before)
                       .join(ranked.select("target", "file_name", "r", F.col("source_path").alias("comes")),
                             ["target", "file_name", "r"], "left"))
            late = F.col("since").isNotNull() & (F.col("comes").isNull() | (F.col("since") < F.col("comes")))
            later = cut_lineage(
                reached.where("k > 0").withColumn("next", F.col("fixed") | late)
                .withColumn("took", ~F.col("next") & F.col("comes").isNotNull()), "flatten-decided")
            took = later.where("took").select("target", F.col("holder").alias("file_name"), "took")
            first = (state.where("k = 0").join(took, ["target", "file_name"], "left")
                     .withColumn("next", F.col("fixed") | F.coalesce("took", F.lit(False))))
            cols = ["target", "file_name", "k", "holder", "since", "fixed", "skip", "next"]
            both = cut_lineage(later.select(*cols).unionByName(first.select(*cols)), "flatten-round")
        if not made:
            made, changed = now, both.where("skip <> next").limit(1).count()
        else:
            changed = both.where("skip <> next").limit(1).count()
            drop_tables(slots.sparkSession, made)
            made = now
        state = both.drop("skip").withColumnRenamed("next", "skip")
        if not changed:
            return state.withColumn("before", before).where("skip").select("target", "file_name", "k", "before")


def flatten_plan(files: DataFrame, target: str, dirs: DataFrame | None = None) -> DataFrame:
    """One row per moved file: source, size, old and new name, ``renamed`` flag and
    the new path."""
    name = ["target", "file_name"]
    moves = _moves(files, target)
    # Rank of each file among the files of its name, in source order.
    ranked = cut_lineage(rank_within(moves, name, ["source_path"], "r"), "flatten-ranked")
    slots = cut_lineage(_contested(ranked, _existing_names(files, dirs, target)), "flatten-slots")
    cols = ["target", "source_path", "file_size", "file_name"]
    if slots.isEmpty():  # no name meets another one: the rank is the slot
        placed = ranked.select(*cols, F.col("r").alias("slot"))
    else:
        over = cut_lineage(_passed_over(slots, ranked), "flatten-over")
        touched = over.select(*name).distinct()
        touched = cut_lineage(touched.withColumn("mixed", F.lit(True)), "flatten-touched")
        flagged = ranked.join(touched, name, "left")
        plain = flagged.where("mixed IS NULL").select(*cols, F.col("r").alias("slot"))
        merged = flagged.where("mixed").select(*cols, F.lit(1).alias("kind"), F.col("r").alias("at")).unionByName(
            over.select("target", F.lit("").alias("source_path"), F.lit(None).cast("bigint").alias("file_size"), "file_name",
                        F.lit(0).alias("kind"), (F.col("k") - F.col("before")).alias("at")))
        mixed = rank_within(merged, name, ["at", "kind", "source_path"], "slot").where("kind = 1").select(*cols, "slot")
        placed = plain.unionByName(mixed)
    plan = placed.select(*cols, _slot_name(F.col("file_name"), F.col("slot")).alias("target_name"))
    return plan.select("*", (F.col("target_name") != F.col("file_name")).alias("renamed"),
                       F.concat(F.col("target"), F.lit("/"), F.col("target_name")).alias("target_path"))


def move_totals(plan: DataFrame) -> DataFrame:
    """Files moved, renamed (conflicts), bytes."""
    return plan.agg(F.count(F.lit(1)).alias("moved"),
                    F.count_if("renamed").alias("conflicts"),
                    F.coalesce(F.sum("file_size"), F.lit(0)).cast("bigint").alias("total_size"))
