"""The identity store as relations: persons, samples, limits, pages, patches and the change feed."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.cumulative import running_totals


def with_face_count(persons: DataFrame, samples: DataFrame) -> DataFrame:
    """All ``persons`` with the number of their ``samples`` (0 for none)."""
    counts = samples.groupBy("person_id").agg(F.count("*").alias("face_count"))
    return persons.join(counts, "person_id", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0)))


def hydrate(hits: DataFrame, samples: DataFrame, persons: DataFrame) -> DataFrame:
    """``hits (sample_id, ...)`` with their sample, person and the person's number of samples."""
    return hits.join(samples, "sample_id").join(with_face_count(persons, samples), "person_id")


def person_overview(persons: DataFrame, samples: DataFrame) -> DataFrame:
    """Persons with sample count, mean quality, and the cover crop, or else that of the lowest sample with one."""
    crop = F.col("crop_path").isNotNull()
    stats = samples.groupBy("person_id").agg(
        F.count("*").alias("sample_count"),
        F.avg("quality").alias("avg_quality"),
        F.min_by("crop_path", F.when(crop, F.col("sample_id"))).alias("first_crop")
    )
    covers = samples.select(F.col("sample_id").alias("cover_sample_id"), F.col("crop_path").alias("cover_crop"))
    joined = persons.join(stats, "person_id", "left").join(covers, "cover_sample_id", "left")
    return joined.select(
        *persons.columns,
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        "avg_quality",
        F.coalesce("cover_crop", "first_crop").alias("cover_path")
    )


def gallery(samples: DataFrame, persons: DataFrame) -> DataFrame:
    """Samples with a vector and a person, by the person's display name or else ``Unnamed``."""
    kept = samples.where("embedding is not null and person_id is not null")
    return kept.join(persons.select("person_id", "name"), "person_id", "left").withColumn("name", F.coalesce("name", F.lit("Unnamed")))


def collection_totals(samples: DataFrame) -> DataFrame:
    """Persons with samples, samples, and the most samples of a person."""
    return samples.groupBy("person_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("persons"), F.coalesce(F.sum("n"), F.lit(0)).alias("faces"), F.coalesce(F.max("n"), F.lit(0)).alias("max_faces")
    )


def limit_violations(samples: DataFrame, added: DataFrame, capacity: int, max_faces: int) -> DataFrame:
    """Limits that ``added (person_id)`` would break: rows (limit, person_id, wanted)."""
    wanted = samples.select("person_id").union(added.select("person_id"))
    total = wanted.agg(F.count("*").alias("wanted")).where(F.col("wanted") > capacity).select(
        F.lit("capacity").alias("limit"), F.lit(None).cast("long").alias("person_id"), "wanted"
    )
    touched = wanted.join(
        added.select("person_id").distinct(), "person_id", "left_semi"
    ).groupBy("person_id").agg(F.count("*").alias("wanted"))
    return total.union(touched.where(F.col("wanted") > max_faces).select(F.lit("max_faces_per_person"), "person_id", "wanted"))


def page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset page: the ``size`` rows of the smallest keys over ``after`` (null: from the start)."""
    kept = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return kept.orderBy(key).limit(size)


def sign_cursor(secret: bytes, scope: str, after) -> str:
    body = json.dumps({"scope": scope, "after": after}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode().rstrip("=")


def read_cursor(secret: bytes, scope: str, cursor: str):
    """The key that a cursor of this scope holds; ValueError for any other string."""
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
        body = json.loads(raw[32:])
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if not hmac.compare_digest(raw[:32], hmac.new(secret, raw[32:], hashlib.sha256).digest()) or body["scope"] != scope:
        raise ValueError("not a cursor of this scope")
    return body["after"]


def replay(changes: DataFrame) -> DataFrame:
    """Live vectors of a feed ``(seq, op, vector_id)``: the latest op of each is ``add`` and no ``clear`` came after it."""
    cleared = changes.where("op = 'clear'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    last = changes.where("op <> 'clear'").groupBy("vector_id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    return last.crossJoin(F.broadcast(cleared)).where("op = 'add' and seq > cleared").select("vector_id", "seq")


def feed_page(changes: DataFrame, after: int, size: int) -> DataFrame:
    return page(changes, "seq", after, size)


def acknowledge(changes: DataFrame, through: int) -> DataFrame:
    return changes.where(F.col("seq") > through)


def allocate_ids(rows: DataFrame, order: list[Column], last: int, id_col: str = "id", buckets: int = 256) -> DataFrame:
    """``rows`` with gapless ids from ``last + 1``, never reused, in order within hash buckets: no task numbers all rows."""
    parts = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = parts.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )  # at most ``buckets`` rows
    offsets = counts.select("bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return parts.withColumn("own", own).join(F.broadcast(offsets), "bucket").withColumn(
        id_col, (F.lit(last) + F.col("before") + F.col("own")).cast("long")
    ).select(id_col, *rows.columns)


def patch(
    rows: DataFrame, changes: DataFrame, key: str, allowed: list[str], revision: str | None = None, watched: list[str] = ()
) -> DataFrame:
    """Rows with the non-null values of ``changes`` in the allowed columns; ``revision`` rises where a watched column changes."""
    unknown = set(changes.columns) - {key, *allowed}
    if unknown:
        raise ValueError(f"not allowed: {sorted(unknown)}")
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key])
    joined = rows.join(new, key, "left")
    moved = F.lit(False)
    for c in watched:
        if f"new_{c}" in joined.columns:
            moved = moved | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
    out = []
    for c in rows.columns:
        if f"new_{c}" in joined.columns:
            out.append(F.coalesce(f"new_{c}", c).alias(c))
        else:
            out.append((F.col(c) + moved.cast("int")).cast(rows.schema[c].dataType).alias(c) if c == revision else F.col(c))
    return joined.select(*out)


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``changes`` (one for each key) put in or in place of the old."""
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def delete_person(samples: DataFrame, person_ids: DataFrame, keep_samples: bool) -> DataFrame:
    """Samples after their persons are deleted: without theirs, or with their person null."""
    if not keep_samples:
        return delete(samples, person_ids, "person_id")
    gone = person_ids.select("person_id").distinct().withColumn("gone", F.lit(True))
    joined = samples.join(gone, "person_id", "left")
    return joined.select(*[F.when(F.col("gone").isNull(), F.col(c)).alias(c) if c == "person_id" else F.col(c) for c in samples.columns])


def merge_persons(samples: DataFrame, merges: DataFrame) -> DataFrame:
    """Samples re-pointed by ``merges (source, target)``."""
    joined = samples.join(merges.select(F.col("source").alias("person_id"), F.col("target")).distinct(), "person_id", "left")
    return joined.select(*[F.coalesce("target", "person_id").alias(c) if c == "person_id" else F.col(c) for c in samples.columns])


def deletion_feed(samples: DataFrame, ids: DataFrame, last_seq: int) -> DataFrame:
    """The change rows of deleting ``ids (sample_id)``: (seq, op, vector_id)."""
    gone = samples.join(ids.select("sample_id").distinct(), "sample_id", "left_semi").select(
        F.col("sample_id").alias("vector_id"), F.lit("delete").alias("op")
    )
    return allocate_ids(gone, [F.col("vector_id")], last_seq, "seq")


def under_roots(media: DataFrame, roots: DataFrame) -> DataFrame:
    """``media (path)`` under any of ``roots (root)``: a path's own ancestors are looked up, so the join is by equality."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = media.select("path", F.explode(ancestors).alias("root")).join(
        roots.select(F.rtrim(F.regexp_replace("root", "/+$", "")).alias("root")).distinct(), "root", "left_semi"
    )
    return media.join(found.select("path").distinct(), "path", "left_semi")


def new_paths(paths: DataFrame, existing: DataFrame) -> DataFrame:
    return paths.join(existing.select("path").distinct(), "path", "left_anti")


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether the two key sets are equal, and how many keys only one of them has."""
    flags = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return flags.agg(
        F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a")
    ).select((F.col("only_a") + F.col("only_b") == 0).alias("equal"), "only_a", "only_b")


def first_occurrences(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys with the position of their first row."""
    return rows.groupBy(key).agg(F.min(position).alias(position))


def validation_summary(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Identities (``identity, role``) that lack a gallery image, and pair counts of a gallery and probe layout."""
    g = present.where("role = 'gallery'").groupBy("identity").agg(F.count("*").alias("g"))
    p = present.where("role = 'probe'").groupBy("identity").agg(F.count("*").alias("p"))
    each = expected.select("identity").distinct().join(g, "identity", "left").join(p, "identity", "left")
    each = each.select("identity", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    totals = each.agg(
        F.count("*").alias("identities"),
        F.sum(F.col("g") * F.col("p")).alias("positive_pairs"),
        (F.sum("g") * F.sum("p") - F.sum(F.col("g") * F.col("p"))).alias("negative_pairs"),
        F.sum((F.col("g") == 0).cast("long")).alias("missing_gallery")
    )
    return totals


def index_snapshot(samples: DataFrame, changes: DataFrame) -> DataFrame:
    """Vectors to build an index from, by vector_id, each with the ``revision`` and ``max_seq`` of the feed that they hold.

    ``changes (seq, revision, ...)`` may be empty: both are 0 then. ``samples`` is an immutable snapshot,
    so all rows are of one state.
    """
    state = changes.agg(
        F.coalesce(F.max("revision"), F.lit(0)).cast("long").alias("revision"),
        F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("max_seq")
    )
    return samples.crossJoin(F.broadcast(state)).orderBy("vector_id")


def all_faces(samples: DataFrame) -> DataFrame:
    """All samples, by person, then sample."""
    return samples.orderBy("person_id", "sample_id")


def media_faces(faces: DataFrame, media: DataFrame) -> DataFrame:
    """``faces (face_id, media_id, embedding, created)`` with a vector and their ``media (media_id, path, ...)``, newest first."""
    return faces.where("embedding is not null").join(media, "media_id").orderBy(F.desc("created"), F.desc("face_id"))


def insert_faces(
    added: DataFrame, samples: DataFrame, capacity: int, max_faces: int, last_vector: int, last_revision: int, last_seq: int
) -> tuple[DataFrame, DataFrame]:
    """New faces ``added (position, person_id, ...)`` of new or known persons: (samples with vector ids, change rows).

    Ids follow ``last_vector`` in order of position and are never reused. A person's faces are one
    revision, persons in order of their first face; each face is a change ``add``. ValueError, and nothing
    is added, if they would break a limit.
    """
    if limit_violations(samples, added, capacity, max_faces).head(1):
        raise ValueError("limit")
    one = F.lit(1)
    placed = running_totals(added.withColumn("one", one), "position", ["one"], descending=False).withColumnRenamed("one_to_here", "place")
    firsts = added.groupBy("person_id").agg(F.min("position").alias("first")).withColumn("one", one)
    turns = running_totals(firsts, "first", ["one"], descending=False).select("person_id", F.col("one_to_here").alias("turn"))
    numbered = placed.join(turns, "person_id").withColumn("vector_id", (F.lit(last_vector) + F.col("place")).cast("long"))
    feed = numbered.select(
        (F.lit(last_seq) + F.col("place")).cast("long").alias("seq"),
        (F.lit(last_revision) + F.col("turn")).cast("long").alias("revision"),
        F.lit("add").alias("op"),
        "vector_id",
        "person_id"
    )
    return numbered.select("vector_id", *added.columns), feed


def hub_insert(hub: DataFrame, rows: DataFrame, auto: bool = True) -> DataFrame:
    """``hub (id, embedding)`` with ``rows (position, embedding)`` under ids after its greatest, in order of position,
        or (``auto`` false) under their own ``id``, which must be new."""
    if auto:
        last = hub.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
        placed = running_totals(rows.select("position", "embedding").withColumn("one", F.lit(1)), "position", ["one"], descending=False)
        new = placed.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("one_to_here")).cast("long").alias("id"), "embedding")
    else:
        new = rows.select("id", "embedding")
        if new.join(hub, "id", "left_semi").head(1) or new.groupBy("id").count().where("count > 1").head(1):
            raise ValueError("id is taken")
    return hub.unionByName(new)


def hub_update(hub: DataFrame, rows: DataFrame) -> DataFrame:
    """``hub`` with the vectors of ``rows (id, embedding)`` in place of its own; unknown ids change nothing."""
    return patch(hub, rows.select("id", "embedding"), "id", ["embedding"])


def hub_ids(hub: DataFrame) -> DataFrame:
    return hub.select("id").orderBy("id")


def hub_get(hub: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``ids (id)``, with a null vector where the hub has none."""
    return ids.select("id").distinct().join(hub, "id", "left")


def append_runs(runs: DataFrame, new: DataFrame, position: str = "position") -> DataFrame:
    """``runs (id, created, ...)`` with ``new`` rows under ids after the greatest, in order of ``position``; missing columns are null.

    Evaluation runs, recognition logs and album results are kept so: rows are added, never changed.
    """
    last = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    placed = running_totals(new.withColumn("one", F.lit(1)), position, ["one"], descending=False).crossJoin(F.broadcast(last))
    made = placed.select((F.col("last") + F.col("one_to_here")).cast("long").alias("id"), *[c for c in new.columns if c != position])
    return runs.unionByName(made, allowMissingColumns=True)


def merged_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a``, and those of ``b`` whose key ``a`` lacks: the join of two track lists; ``delete`` is their difference."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))
