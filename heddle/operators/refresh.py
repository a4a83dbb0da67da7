"""REF1-REF5: change detection between two snapshots of the same entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import spread

FAILED = ["source_error", "failed", "blocked"]


def changes(old: DataFrame, new: DataFrame, key: str, fields: dict[str, str], status: str | None = None, strict: bool = False) -> DataFrame:
    """REF1, REF2: differing fields, compared as strings; ``fields`` names the tracked field of each column. A null that a failed source
    left behind (``status`` of the new row) is no change. An entity of one snapshot alone shows all its fields with ``side``, or fails the
    query if ``strict``.

    The snapshots are joined once, a row an entity; only what changed becomes rows.
    """
    packed = lambda rows, name, *more: rows.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in fields], *more).alias(name))
    both = packed(old, "_old").join(packed(new, "_new", *([F.col(status).alias("_status")] if status else [])), key, "full")
    lone = lambda side: F.raise_error(F.lit("both snapshots must have the same entities")).cast("string") if strict else F.lit(side)
    both = both.withColumn("side", F.when(F.col("_old").isNull(), lone("only_new")).when(F.col("_new").isNull(), lone("only_old")).otherwise("both"))
    failed = F.coalesce(F.col("_new._status").isin(FAILED), F.lit(False)) if status else F.lit(False)

    def change(column: str, field: str) -> Column:
        was, now = F.col(f"_old.{column}"), F.col(f"_new.{column}")
        differs = ~was.eqNullSafe(now) & ~(now.isNull() & failed)
        return F.when(differs | (F.col("side") != "both"), F.struct(F.lit(field).alias("field"), was.alias("old_value"), now.alias("new_value")))

    each = both.select(key, "side", F.explode(F.array_compact(F.array(*[change(c, f) for c, f in fields.items()]))).alias("_c"))
    return each.select(key, "_c.field", "_c.old_value", "_c.new_value", "side")


#: Tracked fields of a profile, in order, each with the module whose evidence tells of it (fixed values).
TRACKED = [
    "registry.name", "registry.legal_form", "registry.employees", "registry.municipality", "registry.website", "registry.latest_submitted_accounts",
    "financials.records", "financial_history.years", "roles.roles", "locations.locations", "website.title", "website.description", "website.social_links",
]


def evidence_for(evidence: Column, field: str) -> Column:
    """REF4: the record that tells of a tracked field; the register's live one before its other."""
    module = field.split(".", 1)[0]
    return F.coalesce(evidence["registry_live"], evidence["registry"]) if module == "registry" else evidence[module]


def _packed_hash(text: Column) -> Column:
    """A hash's digits as bytes, half as many, as nothing else of a record is as long when it is sent; what is no text of small hex digits stays one."""
    whole = text.rlike(r"\A([0-9a-f]{2})*\z")
    return F.struct(F.when(whole, F.unhex(text)).alias("bytes"), F.when(~whole, text).alias("text"))


def _unpacked_hash(packed: Column) -> Column:
    return F.coalesce(F.lower(F.hex(packed["bytes"])), packed["text"])


def profile_changes(old: DataFrame, new: DataFrame, key: str = "organisation_number") -> DataFrame:
    """REF1, REF2: what changed between two sets of profiles in the tracked fields: field by field in order, with both values, the source and time of the new one,
    and the content's hashes on both sides. Fails the query if the sets aren't of the same entities, or have one twice.

    Profiles have a column for each tracked field (its name with an underscore for the dot; lists and objects as JSON) and ``evidence``, a map by module of
    ``status, source_url, retrieved_at, effective_at, as_of, source_class, source_type, content_sha256``. A null that a failed or blocked source left is no change.
    """
    c = F.col
    modules = {f.split(".", 1)[0]: f for f in TRACKED}

    def packed(rows: DataFrame, name: str, told) -> DataFrame:
        """A row an entity with its fields and, of each module, what is told of a change; rows are counted once they are sorted by entity, so that they are sent and sorted once."""
        record = lambda f: told(evidence_for(c("evidence"), f))
        values = F.struct(*[c(f.replace(".", "_")).cast("string").alias(f.replace(".", "_")) for f in TRACKED], F.struct(*[record(f).alias(m) for m, f in modules.items()]).alias("evidence"))
        return rows.select(key, values.alias(f"_{name}")).withColumn(f"_n{name}", F.count("*").over(Window.partitionBy(key)))

    before = packed(old, "old", lambda r: F.struct(_packed_hash(r["content_sha256"]).alias("content_sha256")))
    after = packed(new, "new", lambda r: F.struct(
        r["status"].alias("status"), r["source_url"].alias("source_url"), r["retrieved_at"].alias("retrieved_at"), F.coalesce(r["effective_at"], r["as_of"]).alias("effective_at"), F.coalesce(r["source_class"], r["source_type"]).alias("source_class"),
        _packed_hash(r["content_sha256"]).alias("content_sha256"),
    ))
    both = before.join(spread(after), key, "full")
    fault = F.when(c("_old").isNull() | c("_new").isNull(), "Refresh datasets must have identical organisation-number membership").when((c("_nold") > 1) | (c("_nnew") > 1), "Refresh datasets must have each organisation number once")
    both = both.withColumn("_ok", F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).filter("_ok")

    def change(field: str, place: int) -> Column:
        column = field.replace(".", "_")
        was, now = c(f"_old.{column}"), c(f"_new.{column}")
        before, record = (c(f"{side}.evidence.{field.split('.', 1)[0]}") for side in ("_old", "_new"))
        unseen = now.isNull() & F.coalesce(record["status"].isin(FAILED), F.lit(False))
        told = F.struct(
            F.lit(place).alias("place"), F.lit(field).alias("field"), was.alias("old_value"), now.alias("new_value"), record["source_url"].alias("source_url"), record["retrieved_at"].alias("retrieved_at"), record["effective_at"].alias("effective_at"),
            record["source_class"].alias("source_class"), _unpacked_hash(before["content_sha256"]).alias("old_content_sha256"), _unpacked_hash(record["content_sha256"]).alias("new_content_sha256"), record["status"].alias("status"),
        )
        return F.when(~was.eqNullSafe(now) & ~unseen, told)

    each = both.select(key, F.explode(F.array_compact(F.array(*[change(f, i) for i, f in enumerate(TRACKED)]))).alias("x"))
    return each.select(key, "x.*")


def evidence_complete(changes: DataFrame) -> DataFrame:
    """AGG16: whether each change has source, times, and the hashes of both sides, and how many don't."""
    there = F.lit(True)
    for name in ("source_url", "retrieved_at", "effective_at", "old_content_sha256", "new_content_sha256"):
        there = there & (F.coalesce(name, F.lit("")) != "")
    return changes.agg(F.count("*").alias("changes"), F.count_if(~there).alias("incomplete")).withColumn("evidence_complete", F.col("incomplete") == 0)


def materialized(base: DataFrame, live: DataFrame, fields: list[str], key: str = "organisation_number") -> DataFrame:
    """PRJ19: profiles with the fields that a live response (``status`` and the fields) has, where it is available."""
    said = live.select(key, F.struct("status", *fields).alias("_live"))
    now = lambda f: F.when(F.col("_live.status") == "available", F.col(f"_live.{f}"))
    return base.join(said, key, "left").select(*[F.coalesce(now(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns])


def change_type(field: Column, old: Column, new: Column) -> Column:
    """SCA36: the first that fits."""
    has = lambda s: F.contains(field, F.lit(s))
    return (
        F.when(old.isNull() & new.isNotNull(), "new_fact").when(has("roles"), "role_changed").when(has("financial"), "financial_update")
        .when(has("employees"), "workforce_updated").when(has("website"), "website_updated").otherwise("value_updated")
    )


def fingerprint(key: Column, field: Column, value: Column, period: Column | None = None) -> Column:
    """SCA31: a hash of what a fact says, without when it was seen; value as JSON."""
    period = F.lit("") if period is None else F.coalesce(period, F.lit(""))
    return F.sha2(F.concat_ws(":", key.cast("string"), field, F.coalesce(value, F.lit("null")), period), 256)


def event_id(key: Column, field: Column, content_hash: Column) -> Column:
    """A change's id: the same change twice has one id."""
    return F.concat(F.lit("evt-"), F.substring(F.sha2(F.concat_ws(":", key.cast("string"), field, content_hash), 256), 1, 16))


def replay_metrics(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """AGG16: true and false positives, false negatives, precision and recall (1 for nothing expected or observed)."""
    e, o = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), observed.select(*keys).distinct().withColumn("_o", F.lit(1))
    t = e.join(o, keys, "full").agg(F.count(F.expr("case when _e = 1 and _o = 1 then 1 end")).alias("tp"), F.count(F.expr("case when _e is null then 1 end")).alias("fp"), F.count(F.expr("case when _o is null then 1 end")).alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.bround(F.col(a) / (F.col(a) + F.col(b)), 6))
    return t.select("tp", "fp", "fn", ratio("tp", "fp").alias("precision"), ratio("tp", "fn").alias("recall"))
