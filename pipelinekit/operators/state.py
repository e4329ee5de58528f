"""State tables: overlay, comparison with a desired state, and applying changes.

A state table holds what was recorded (one row per id and place), a desired table
what should be (one row per id). Columns, all strings unless noted:

``state``    id, name, type, external_job_id, fabric_id, is_paused and
             skip_processing (booleans), release_tag; ``apply_changes`` also needs
             seq (long), the order of the rows
``desired``  id, fabric_id, external_job_id, enabled and valid (booleans)
``changes``  the state columns, plus seq (long), operation and failed (boolean)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pipelinekit.operators.conditions import all_equal, keys_match
from pipelinekit.operators.keys import minus
from pipelinekit.operators.lookups import lookup, lookup_match
from pipelinekit.operators.running import running
from pipelinekit.storage import stored

KEY = ["id", "fabric_id"]


def overlay(base: DataFrame, top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``top``, and those of ``base`` whose key ``top`` lacks.

    A row of ``top`` wins as a whole, so its nulls win too. Null keys equal each other.
    """
    return minus(base, top, keys).unionByName(top)


def override(
    df: DataFrame, overrides: DataFrame, key: str, column: str, value: str, order_by: Sequence[str]
) -> DataFrame:
    """Replace ``column``, as a string, by the first override of the key unless that is empty."""
    given = overrides.select(F.col(key).alias("__key"), F.col(value).alias("__given"), *[
        F.col(c).alias(f"__{i}") for i, c in enumerate(order_by)
    ])
    found = lookup(df, given, {key: "__key"}, ["__given"], "first", [f"__{i}" for i in range(len(order_by))])
    chosen = F.coalesce(F.nullif(F.col("__given"), F.lit("")), F.col(column).cast("string"))
    return found.select(*[chosen.alias(c) if c == column else F.col(c) for c in df.columns])


def to_process(state: DataFrame) -> DataFrame:
    """State rows that are not marked to be skipped."""
    return state.filter(~F.coalesce("skip_processing", F.lit(False)))


def _within(df: DataFrame, places: Sequence[str] | DataFrame | None, name: str) -> DataFrame:
    """Add whether the place of a row is one of ``places``; every place is, if there are none to compare with."""
    if isinstance(places, DataFrame):
        (column,) = places.columns
        return lookup_match(df, places, {"fabric_id": column}, name)
    inside = F.lit(True) if places is None else F.coalesce(F.col("fabric_id").isin(list(places)), F.lit(False))
    return df.withColumn(name, inside)


def snapshot_diff(
    state: DataFrame,
    desired: DataFrame,
    of_type: Column,
    redeploy: bool = False,
    allowed: Sequence[str] | DataFrame | None = None,
    known: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Classify rows into what has to happen to turn the state into the desired one.

    Returns id, fabric_id, external_job_id and class; a row of several classes appears
    once for each. State rows marked to be skipped, or not ``of_type``, are left out.
    Desired rows outside the ``allowed`` places count only as SKIP, so the recorded
    rows of such an id are removed like those of an unknown one. ``allowed`` and ``known``
    are short lists, or tables whose only column names any number of places.

    =======  ==================================================================
    ADD      desired and valid, and not recorded under this id and place by any
             type; with ``redeploy``: desired, valid and enabled
    REFRESH  recorded under the id and place of a valid desired row (not with
             ``redeploy``, where ADD covers it)
    MOVED    recorded in another place than a valid desired row of the id
    REMOVE   recorded under an id that is not desired, valid or not; with
             ``redeploy`` only in ``known`` places
    RENAME   (``redeploy``) same id and place, enabled, another external name
    PAUSE    (``redeploy``) running, same id and place now disabled, and no row of
             the id is moved
    SKIP     desired outside the allowed places, or not valid
    =======  ==================================================================

    PAUSE looks at the rows being removed id by id; rows removed under other ids do
    not matter. A desired row that is not valid protects its recorded rows from REMOVE.
    """
    wanted = desired.select(
        "id",
        F.col("fabric_id").cast("string").alias("fabric_id"),
        "external_job_id",
        F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.coalesce("valid", F.lit(False)).alias("valid"),
    )
    wanted = _within(wanted, allowed, "reached")
    recorded = to_process(state)

    d = wanted.filter("reached").select(
        F.col("id").alias("d_id"),
        F.col("fabric_id").alias("d_place"),
        F.col("external_job_id").alias("d_name"),
        F.col("enabled").alias("d_enabled"),
        F.col("valid").alias("d_valid"),
    )
    s = recorded.filter(of_type).select("id", "fabric_id", "external_job_id", "is_paused")
    if redeploy:
        # Whether any row of an id lies elsewhere is told by its least and greatest place,
        # so that the rows themselves are joined only once.
        place = F.struct("fabric_id")
        places = s.groupBy(F.col("id").alias("p_id")).agg(F.min(place).alias("low"), F.max(place).alias("high"))
        elsewhere = ~F.col("low.fabric_id").eqNullSafe(F.col("d_place")) | ~F.col("high.fabric_id").eqNullSafe(F.col("d_place"))
        d = d.join(places, d["d_id"] == places["p_id"], "left").select(
            *d.columns, (F.col("p_id").isNotNull() & elsewhere).alias("d_elsewhere")
        )
    both = s.join(d, keys_match([(s["id"], d["d_id"])]), "left")

    here = F.col("d_valid") & F.col("fabric_id").eqNullSafe(F.col("d_place"))
    moved = F.col("d_valid") & ~F.col("fabric_id").eqNullSafe(F.col("d_place"))
    gone = F.col("d_id").isNull()
    if not redeploy:
        rules = {"REFRESH": here, "MOVED": moved, "REMOVE": gone}
        added = minus(wanted.filter(F.col("reached") & F.col("valid")), recorded, KEY)
    else:
        both = _within(both, known, "in_known")
        other_name = ~F.col("external_job_id").eqNullSafe(F.col("d_name"))
        running_now = F.coalesce(~F.col("is_paused"), F.lit(False))
        rules = {
            "MOVED": moved,
            "REMOVE": gone & F.col("in_known"),
            "RENAME": here & F.col("d_enabled") & other_name,
            "PAUSE": here & ~F.col("d_enabled") & running_now & ~F.col("d_elsewhere"),
        }
        added = wanted.filter(F.col("reached") & F.col("valid") & F.col("enabled"))

    labels = F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules.items()]))
    classified = both.select("id", "fabric_id", "external_job_id", F.explode(labels).alias("class"))
    skipped = wanted.filter(~F.col("reached") | ~F.col("valid"))
    listed = ["id", "fabric_id", "external_job_id"]
    return classified.unionByName(added.select(*listed, F.lit("ADD").alias("class"))).unionByName(
        skipped.select(*listed, F.lit("SKIP").alias("class"))
    )


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after a batch of changes, keyed by id and place.

    Failed changes and operations other than DELETED, REFRESH and CREATED have no
    effect. All deletions come first, then all refreshes, then all creations, each kind
    in order of ``seq``, unique among the changes, whatever the order of the kinds is; the
    last change of a kind wins. A refresh or a creation replaces its key or adds it. Null
    ids and null places are values like any other.

    A created row takes the release tag of the first row its id then has, in any
    place and even if that tag is null; with no such row it keeps its own. "First" goes
    by the order a list would have after removing and appending rows: untouched rows by
    their seq, then refreshed ones, then created ones. A created row that a later creation of
    its key replaces is in that list until then.

    The result has the state's columns without ``seq``. State and changes are read once
    each, when the plan is built: what happens to a key, the rows before creations and the
    first row of each creation are written to the shared folder.
    """
    columns = [c for c in state.columns if c != "seq"]
    created = F.col("operation") == "CREATED"
    done = changes.filter(~F.coalesce("failed", F.lit(False)) & F.col("operation").isin("DELETED", "REFRESH", "CREATED"))
    done = done.select("seq", "operation", *columns)
    # Each creation with the seq of the next one of its key.
    done = running(done, KEY, [F.col("seq").desc()], F.when(created, F.col("seq")), "min", "until", before=True)

    # What happens to a key. Changes are few against the state, so they are reduced first; the
    # state meets them in a join that need not shuffle it if they are small.
    touched = done.groupBy(*[F.col(k).alias(f"__{k}") for k in KEY]).agg(
        F.min(F.when(created, F.col("seq"))).alias("until"),
        F.bool_or(~created).alias("replaced"),
        F.max(F.when(F.col("operation") == "REFRESH", F.struct("seq", *columns))).alias("refresh"),
    )
    # The rows before creations, with the first creation of their key. Refreshed rows stand behind the untouched ones.
    untouched = state.join(touched, all_equal(state, touched, KEY), "left").filter(~F.coalesce("replaced", F.lit(False)))
    untouched = untouched.select(F.lit(0).alias("kind"), "seq", *columns, "until")
    refreshed = touched.filter("refresh IS NOT NULL").select(F.lit(1).alias("kind"), "refresh.*", "until")
    earlier = stored(untouched.unionByName(refreshed), "earlier")

    lasting = earlier.filter(F.col("until").isNull()).select(*columns)
    return lasting.unionByName(_created_rows(earlier, done.filter(created), columns))


def _created_rows(earlier: DataFrame, creations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The creations that last, each with the tag of the first row of its id at that time.

    A row is still there for a creation unless a creation before that one replaced its key, so
    the first row there is the least in list order among those replaced at that time or
    later. With rows and creations of an id in order of time, latest first, that is a
    running minimum. Earlier rows are reduced to one per id and time beforehand, so the
    groups grow with the creations of an id, not with its recorded rows.
    """
    ids = creations.select(F.col("id").alias("__id")).distinct()
    rows = earlier.join(ids, all_equal(earlier, ids, ["id"]), "left_semi")
    rows = rows.groupBy("id", F.col("until").alias("time")).agg(F.min(F.struct("kind", "seq", "release_tag")).alias("entry"))
    # Step 0 is a row that can come first, step 1 a creation that asks which one does. A creation
    # is both; being a row since its own seq only, it is not the least while an older one is there.
    of_rows = rows.select("id", "time", F.lit(0).alias("step"), "entry", F.lit(None).alias("creation"))
    row = F.when(F.col("until").isNull(), F.struct(*columns))
    own = F.struct(F.lit(2).alias("kind"), "seq", "release_tag")
    marks = F.array(
        F.struct(F.col("until").alias("time"), F.lit(0).alias("step"), own.alias("entry"), F.lit(None).alias("creation")),
        F.struct(
            F.col("seq").alias("time"), F.lit(1).alias("step"), F.lit(None).alias("entry"),
            F.struct("seq", "release_tag", row.alias("row")).alias("creation"),
        ),
    )
    of_creations = creations.select("id", F.inline(marks))
    latest_first = [F.col("time").desc_nulls_first(), "step", "entry.kind", "entry.seq"]
    found = running(of_rows.unionByName(of_creations), ["id"], latest_first, F.col("entry"), "min", "first").filter("step = 1")

    copies = (F.col("first.kind") == 2) & (F.col("first.seq") < F.col("creation.seq"))
    tag = F.when(F.col("first.kind") < 2, F.col("first.release_tag")).otherwise(F.col("creation.release_tag"))
    tagged = found.select(
        "id", F.col("creation.seq").alias("seq"), F.col("creation.row").alias("row"), tag.alias("tag"),
        F.when(copies, F.col("first.seq")).alias("of"),
    )
    tagged = _follow(tagged)
    tag = F.col("tag").cast(creations.schema["release_tag"].dataType)
    return tagged.filter(F.col("row").isNotNull()).select(
        *[tag.alias(c) if c == "release_tag" else F.col(f"row.{c}").alias(c) for c in columns]
    )


def _follow(tagged: DataFrame) -> DataFrame:
    """Give creations the tag of the creation (``of``) whose tag they copy, which may be a copy itself.

    Each round follows a link through two more, so the chains it has still to follow shrink to a
    third. A chain is as long as a key was created in one batch after all earlier rows had been
    replaced, so mostly there is none to follow.
    """
    while True:
        links = Observation()
        tagged = stored(tagged.observe(links, F.count("of").alias("open")), "tagged")
        if not links.get["open"]:
            return tagged
        to = tagged.select(
            F.col("id").alias("__id"), F.col("seq").alias("__seq"), F.col("tag").alias("__tag"), F.col("of").alias("__of")
        )
        followed, done = tagged.filter(F.col("of").isNotNull()), tagged.filter(F.col("of").isNull())
        for _ in range(2):
            same = F.col("id").eqNullSafe(F.col("__id")) & F.col("of").eqNullSafe(F.col("__seq"))
            met = F.col("__id").isNotNull() | F.col("__seq").isNotNull()
            followed = followed.join(to, same, "left").select(
                "id", "seq", "row", F.when(met, F.col("__tag")).otherwise(F.col("tag")).alias("tag"), F.col("__of").alias("of")
            )
        tagged = done.unionByName(followed)
