"""SNK4, PRJ1, PRJ10, FLT10, FLT15: evidence records, terminal envelopes, and their validation in the pass that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.envelope import terminal_state
from heddle.sources.resumable import Check

#: States in which an envelope or a module may end (fixed values).
TERMINAL = ["complete", "not_applicable", "not_found", "blocked_policy", "blocked_robots", "source_error", "budget_exhausted", "submission_error"]
#: Fields of an evidence record, in order; the first six are given for each, the rest may be null.
EVIDENCE = ["field", "status", "source_type", "source_class", "source_url", "retrieved_at", "value", "as_of", "note", "content_sha256", "source_row_key", "effective_at", "retry_count"]


def evidence(field: str, status: Column, source_type: str, source_url: Column, retrieved_at: Column, **more: Column) -> Column:
    """PRJ1: an evidence record as a struct; its class is its type, and what isn't given is null."""
    given = {"field": F.lit(field), "status": status, "source_type": F.lit(source_type), "source_class": F.lit(source_type), "source_url": source_url, "retrieved_at": retrieved_at} | more
    unknown = set(given) - set(EVIDENCE)
    if unknown:
        raise ValueError(f"no fields of an evidence record: {', '.join(sorted(unknown))}")
    kind = lambda c: "int" if c == "retry_count" else "string"
    return F.struct(*[given.get(c, F.lit(None)).cast(kind(c)).alias(c) for c in EVIDENCE])


def module_complete(records: Column, modules: list[str]) -> Column:
    """FLT10: whether a company's records (a map by module) have all ``modules``, none of them not fetched yet."""
    there = [F.coalesce(records[m]["status"], F.lit("")) != "not_fetched" for m in modules]
    known = [records[m].isNotNull() for m in modules]
    out = F.lit(True)
    for x in (*known, *there):
        out = out & x
    return out


def envelopes(profiles: DataFrame, modules: list[str], *, run_id: str, started_at: str, completed_at: str) -> DataFrame:
    """PRJ10: one envelope a profile (``organisation_number``, ``evidence`` by module): the state of each module and of the whole.

    A module without a record is a submission error, and so is an envelope that has one.
    """
    records = F.col("evidence")

    def state(m: str) -> Column:
        r = records[m]
        # A record without status, or none at all, has no state of its own.
        return F.struct(
            F.when(r.isNull(), "submission_error").otherwise(terminal_state(r["status"], r["note"])).alias("state"),
            F.coalesce(r["retry_count"], F.lit(0)).alias("retry_count"), F.coalesce(r["retrieved_at"], F.lit(completed_at)).alias("final_timestamp"),
        )

    states = F.create_map(*[x for m in modules for x in (F.lit(m), state(m))])
    failed = F.exists(F.map_values("modules"), lambda x: x["state"] == "submission_error")
    out = profiles.select("organisation_number", states.alias("modules"))
    return out.select(
        F.lit(run_id).alias("run_id"), "organisation_number", F.when(failed, "submission_error").otherwise("complete").alias("state"),
        F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), "modules",
    )


def _odd(rows: DataFrame) -> DataFrame:
    """Envelopes with ``again``, whether the key was there before, and ``open``, how many modules aren't in a terminal state."""
    again = F.row_number().over(Window.partitionBy("organisation_number").orderBy("run_id")) > 1
    not_ended = F.size(F.filter(F.map_values("modules"), lambda x: ~F.coalesce(x["state"].isin(TERMINAL), F.lit(False))))
    return rows.withColumns({"again": again, "open": not_ended})


def _checks(n, repeated, entities_open, modules_open, expected) -> dict:
    """FLT15: what a set of envelopes has to hold; Columns or plain numbers."""
    exact, unique = n == expected, repeated == 0
    return {"exact_expected_count": exact, "unique_organisation_numbers": unique, "all_entity_states_terminal": entities_open == 0, "all_module_states_terminal": modules_open == 0, "zero_silent_drops": exact & unique}


def _measures() -> dict[str, Column]:
    entity_open = ~F.coalesce(F.col("state").isin(TERMINAL), F.lit(False))
    total = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return {"repeated": total(F.col("again")), "entities_open": total(entity_open), "modules_open": total(F.col("open"))}


def validated(rows: DataFrame, expected: int | Column) -> DataFrame:
    """FLT15: one row with each check and whether all hold."""
    m = _odd(rows).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in _measures().items()])
    c = F.col
    checks = _checks(c("n"), c("repeated"), c("entities_open"), c("modules_open"), F.lit(expected) if isinstance(expected, int) else expected)
    passed = F.lit(True)
    for x in checks.values():
        passed = passed & x
    return m.select(passed.alias("passed"), *[v.alias(k) for k, v in checks.items()], c("modules_open").alias("invalid_states"))


def checked(rows: DataFrame, expected) -> tuple[DataFrame, Check]:
    """Envelopes with what is checked of them while they are written (see :mod:`heddle.sources.resumable`): ``expected`` gives a batch's number of rows."""
    holds = lambda seen: _checks(seen["rows"], seen["repeated"], seen["entities_open"], seen["modules_open"], expected(seen["batch"]))
    return _odd(rows), Check(_measures(), holds)


def invalid_states(rows: DataFrame) -> DataFrame:
    """The modules that aren't in a terminal state: ``organisation_number, module, state``."""
    each = rows.select("organisation_number", F.explode("modules").alias("module", "x"))
    return each.select("organisation_number", "module", "x.state").filter(~F.coalesce(F.col("state").isin(TERMINAL), F.lit(False)))
