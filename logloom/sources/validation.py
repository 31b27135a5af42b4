"""Check raw JSON documents against the mapping, and split off what it refuses.

Documents are read as lines and parsed to a variant, not with a typed reader: the
mapping takes ``"12"`` or ``12.7`` for an integer, where a typed reader would
give a null or refuse the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import geohash_corner, parse_timestamp, valid_geo_point, valid_ip, wkt_point
from ..schema import LEAF_TYPES, LOG_SCHEMA

PARSING = "mapper_parsing_exception"
_INT_MIN, _INT_MAX = -2147483648, 2147483647
_OBJECTS = ["service", "error", "request", "business", "metrics", "geo"]
_LEAVES = [(p, k) for p, k in LEAF_TYPES if k not in ("geo_point", "keyword[]")]
# All fields of an object are read in one cast. A path that a document lacks ends, in
# ``try_variant_get``, in an exception, and most documents lack most paths.
_TOP = "struct<" + ", ".join(
    [f"{p}: string" for p, _ in _LEAVES if "." not in p] + [f"{o}: variant" for o in [*_OBJECTS, "tags"]]
) + ">"
_PARTS = {
    o: "struct<"
    + ", ".join(
        [f"{p.split('.')[1]}: string" for p, _ in _LEAVES if p.startswith(o + ".")]
        + ["location: variant"] * (o == "geo")
    )
    + ">"
    for o in _OBJECTS
}
_POINT = "struct<lat: double, lon: double, type: string, coordinates: array<double>, geohash: string>"


def _name(path: str) -> str:
    return "__" + path.replace(".", "__")


def _at(path: str, kind: str) -> Column:
    return F.try_variant_get(F.col("__doc"), f"$.{path}", kind)


def _present(c: Column) -> Column:
    return c.isNotNull() & ~F.is_variant_null(c)


def _is(c: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(c), F.lit(kind))


def _reason(field: str, text: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"), F.lit(PARSING).alias("type"), F.lit(text).alias("reason")
    )


def _finite(d: Column) -> Column:
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def _failed(path: str, kind: str) -> str:
    return f"failed to parse field [{path}] of type [{kind}]"


def _once(df: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """Add columns that are worked out once per row.

    In a plain projection a later filter on the reasons would be pushed below it
    and take a second copy of all checks along. The struct is made in a projection
    of its own, which is compiled; the unfolding only takes it apart.
    """
    whole = df.select(*keep, F.struct(*made).alias("__made"))
    return whole.select(*keep, F.inline(F.array("__made")))


def _text(path: str) -> Column:
    """A leaf as text, as the casts of ``validate`` have read it."""
    part, _, leaf = path.rpartition(".")
    return F.col(f"{_name(part)}.{leaf}" if part else f"__top.{leaf}")


def _value_and_fault(path: str, kind: str) -> tuple[Column, Column]:
    """The coerced value of a leaf, and whether the mapping refuses it."""
    text = _text(path)
    number = text.try_cast("double")
    if kind == "integer":
        whole = number.try_cast("int")
        return whole, text.isNotNull() & ~F.coalesce(
            # fractions are cut off before the limits are looked at
            _finite(number) & (number > _INT_MIN - 1.0) & (number < _INT_MAX + 1.0), F.lit(False)
        )
    if kind == "float":
        return number, text.isNotNull() & ~F.coalesce(_finite(number), F.lit(False))
    if kind == "scaled_float":
        amount = F.round(text.try_cast("decimal(38,10)"), 2).try_cast("decimal(18,2)")
        return amount, text.isNotNull() & amount.isNull()
    if kind == "date":
        when = parse_timestamp(text)
        return when, text.isNotNull() & when.isNull()
    if kind == "ip":
        return text, text.isNotNull() & ~valid_ip(text)
    # An object is no text. Only a value that looks like one is looked at again.
    whole_object = F.when(
        F.startswith(text, F.lit("{")), _is(_at(path, "variant"), "OBJECT")
    ).otherwise(F.lit(False))
    return text, F.coalesce(whole_object, F.lit(False))


def _location() -> tuple[Column, Column]:
    """A point in any form of ``_coordinate``."""
    c = F.col("__location")
    lat, lon = F.col("__lat"), F.col("__lon")
    point = F.when(_present(c), F.struct(lat.alias("lat"), lon.alias("lon")))
    return point, _present(c) & ~F.coalesce(valid_geo_point(lat, lon), F.lit(False))


def _coordinate(name: str) -> Column:
    """Latitude or longitude of a point.

    It may be an object with both, with a ``geohash``, or of type ``Point`` with
    ``coordinates``; ``[lon, lat]``; or a text: ``"lat,lon"``, ``"POINT (lon lat)"``
    or a geohash. A third coordinate is not kept, but has to be a number in a text.
    """
    c = F.col("__location")
    place = 0 if name == "lat" else 1
    index = 1 - place
    point = F.col("__point")
    text = F.try_variant_get(c, "$", "string")
    parts = F.split(text, ",")
    third = F.get(parts, 2).try_cast("double").isNotNull()
    pair = F.when((F.size(parts) == 2) | ((F.size(parts) == 3) & third), F.get(parts, place).try_cast("double"))
    named = F.when(F.lower(point["type"]) == "point", F.get(point["coordinates"], index))
    # a number is no geohash, though its digits may look like one
    in_text = (
        F.when(F.contains(F.lower(text), F.lit("point")), wkt_point(text)[place])
        .when(F.contains(text, F.lit(",")), pair)
        .when(_is(c, "STRING"), geohash_corner(text)[place])
    )
    whole = F.startswith(F.ltrim(text), F.lit("{")) | F.startswith(F.ltrim(text), F.lit("["))
    return F.coalesce(
        point[name],
        F.get(F.try_variant_get(c, "$", "array<double>"), index),
        named,
        geohash_corner(point["geohash"])[place],
        F.when(~whole, in_text),
    )


def validate(
    lines: DataFrame, column: str = "value", required: tuple[str, ...] = ()
) -> DataFrame:
    """Typed records next to ``reject_reasons`` and the raw document.

    A row is accepted when ``reject_reasons`` is empty. Unknown fields are
    dropped, missing ones are null; ``required`` names paths that must be there.
    """
    parsed = lines.select(
        "*", F.try_parse_json(F.col(column)).alias("__doc")
    )
    top = parsed.withColumn("__top", F.try_variant_get(F.col("__doc"), "$", _TOP))
    parts = top.select(
        *parsed.columns,
        "__top",
        *[F.try_variant_get(F.col(f"__top.{o}"), "$", kind).alias(_name(o)) for o, kind in _PARTS.items()],
    )
    located = parts.withColumn("__location", F.col("__geo.location")).withColumn(
        "__point", F.try_variant_get(F.col("__location"), "$", _POINT)
    )
    read = located.withColumn("__lat", _coordinate("lat")).withColumn("__lon", _coordinate("lon"))
    values: dict[str, Column] = {}
    faults: list[tuple[Column, Column]] = []
    whole = F.col("__doc").isNotNull() & F.startswith(F.ltrim(F.col(column)), F.lit("{"))
    faults.append((~whole, _reason("_source", "malformed document")))
    for o in _OBJECTS:
        # only an object can be read as a struct
        wrong = _present(F.col(f"__top.{o}")) & F.col(_name(o)).isNull()
        text = f"object mapping for [{o}] tried to parse field [{o}] as object, but found a concrete value"
        faults.append((wrong, _reason(o, text)))
    for p, k in _LEAVES:
        values[p], wrong = _value_and_fault(p, k)
        faults.append((wrong, _reason(p, _failed(p, k))))
    tags = F.col("__top.tags")
    listed = F.try_variant_get(tags, "$", "array<variant>")
    objects = F.coalesce(F.exists(listed, lambda v: _is(v, "OBJECT")), _is(tags, "OBJECT"))
    # without a brace there is no object, and the items need no closer look
    braced = F.contains(F.try_variant_get(tags, "$", "string"), F.lit("{"))
    wrong = F.when(braced, objects).otherwise(F.lit(False))
    faults.append((_present(tags) & wrong, _reason("tags", _failed("tags", "keyword"))))
    values["tags"] = F.when(
        _present(tags),
        F.coalesce(
            F.try_variant_get(tags, "$", "array<string>"),
            F.array(F.try_variant_get(tags, "$", "string")),
        ),
    )
    values["geo.location"], wrong = _location()
    faults.append((wrong, _reason("geo.location", _failed("geo.location", "geo_point"))))
    for p in required:
        absent = values[p].isNull()
        faults.append((whole & absent, _reason(p, f"field [{p}] is required")))

    def build(name: str) -> Column:
        inner = [p for p, _ in LEAF_TYPES if p.startswith(name + ".")]
        if not inner:
            return values[name].alias(name)
        fields = F.struct(*[values[p].alias(p.split(".", 1)[1]) for p in inner])
        # an empty object is kept apart from an absent one
        return F.when(_present(F.col(f"__top.{name}")), fields).alias(name)

    kept = [c for c in lines.columns if c != column]
    made = [build(f.name) for f in LOG_SCHEMA]
    # constant lists that are joined, and no filter of one list: a lambda would have all tests interpreted
    none = F.array().cast("array<struct<field: string, type: string, reason: string>>")
    reasons = F.concat(*[F.when(wrong, F.array(reason)).otherwise(none) for wrong, reason in faults])
    checked = _once(read, [*kept, column], [*made, reasons.alias("reject_reasons")])
    return checked.withColumnRenamed(column, "document")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reject_reasons") == 0).drop("reject_reasons", "document")


def rejects(checked: DataFrame, source: str = "bulk", batch: Column | None = None) -> DataFrame:
    """One error entry per refused document; it carries its own document."""
    first = F.col("reject_reasons")[0]
    malformed = first["field"] == "_source"
    return checked.where(F.size("reject_reasons") > 0).select(
        F.current_timestamp().alias("timestamp"),
        F.when(malformed, "serialization").otherwise("insertion").alias("error_type"),
        F.lit(source).alias("source"),
        F.concat(
            F.when(malformed, "Document could not be read: ").otherwise(
                "Document insertion failed: "
            ),
            first["type"],
            F.lit(" - "),
            first["reason"],
        ).alias("message"),
        F.struct(
            F.col("id").alias("document_id"),
            F.col("document"),
            (F.lit(None).cast("bigint") if batch is None else batch).alias("batch_index"),
            F.col("reject_reasons").alias("reasons"),
        ).alias("details"),
    )
