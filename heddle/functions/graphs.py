"""SCA38, SCA43: JSON of unknown shape, as variants: all values of a text at any depth, and the objects of a JSON-LD graph among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types of an organisation in a graph (fixed values).
ORGANISATIONS = ["Organization", "Corporation", "LocalBusiness", "Store", "Restaurant"]
#: Levels to which a text is followed.
DEPTH = 24


def children(value: Column) -> Column:
    """The values right below one: a list's items in order, an object's members by name; none below others."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), F.array().cast("array<variant>"))


def values(text: Column, depth: int = DEPTH) -> Column:
    """All values of a JSON text with their ``place``, the positions that lead to each, in the order of a walk that goes down first; none if it is no JSON.

    A fold over the levels holds one level's values besides those found, so the work is that of the text's size times its depth.
    """
    kind = "array<struct<place:array<int>,value:variant>>"
    one = lambda place, v: F.struct(place.alias("place"), v.alias("value"))
    root = F.try_parse_json(text)
    start = F.when(root.isNotNull(), F.array(one(F.array().cast("array<int>"), root))).otherwise(F.array().cast(kind)).cast(kind)
    below = lambda x: F.transform(children(x["value"]), lambda v, i: one(F.concat(x["place"], F.array(i)), v))

    def deeper(state: Column, _: Column) -> Column:
        level = F.flatten(F.transform(state["level"], below)).cast(kind)
        return F.struct(level.alias("level"), F.concat(state["found"], level).alias("found"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.struct(start.alias("level"), start.alias("found")), deeper, lambda s: s["found"])
    order = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    return F.array_sort(found, order)


def types(node: Column) -> Column:
    """The types that an object of a graph names: a list, or one."""
    one = F.try_variant_get(node, "$.@type", "string")
    return F.coalesce(F.try_variant_get(node, "$.@type", "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def nodes(text: Column, kinds: list[str] | None = None, most: int | None = None, depth: int = DEPTH) -> Column:
    """SCA38: the objects of a JSON text at any depth, of one of ``kinds`` if given, the first ``most``."""
    objects = F.filter(F.transform(values(text, depth), lambda x: x["value"]), lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    if kinds is not None:
        objects = F.filter(objects, lambda v: F.arrays_overlap(types(v), F.array(*map(F.lit, kinds))))
    return objects if most is None else F.slice(objects, 1, most)


def graph(texts: Column) -> Column:
    """SCA43: the objects that a page's JSON-LD scripts say on their top level: those of a ``@graph``, of a list, or the one there is."""
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()

    def of(text: Column) -> Column:
        v = F.try_parse_json(text)
        listed = F.coalesce(F.try_variant_get(v, "$.@graph", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.when(is_object(v), F.array(v)), F.array().cast("array<variant>"))
        return F.filter(listed, is_object)

    return F.flatten(F.transform(texts, of))


def text_at(node: Column, path: str) -> Column:
    """The text at a path of an object, null for others."""
    return F.try_variant_get(node, path, "string")
