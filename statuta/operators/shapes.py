"""Shape checks compiled from schema documents: predicates on a JSON column, made at plan time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What schema_of_variant calls the types of values; whole numbers are numbers too.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",), "null": ("VOID",), "object": ("OBJECT",), "array": ("ARRAY",)}
KEYWORDS = {"type", "required", "properties", "additionalProperties", "enum", "pattern", "minLength", "maxLength", "minimum", "items", "minItems", "uniqueItems"}


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _elements(v: Column, kind: Column) -> Column:
    return F.when(kind == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def _own_rules(document: dict, path: str) -> Iterator[tuple[str, Callable[[Column, Column], Column]]]:
    """(path:keyword, predicate on a VARIANT and its kind) of the keywords that look at a value itself; true where it breaks the keyword."""
    if unknown := set(document) - KEYWORDS:
        raise ValueError(f"{path or 'the document'} uses {sorted(unknown)}")
    at, d = path or "record", document
    kinds = [d["type"]] if isinstance(d.get("type"), str) else d.get("type", [])
    text = lambda v, k: F.when(k == "STRING", F.try_variant_get(v, "$", "string"))
    number = lambda v, k: F.when(k.isin(*TYPES["number"]), F.try_variant_get(v, "$", "double"))
    keys = lambda v, k: F.when(k == "OBJECT", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    if kinds:
        yield f"{at}:type", lambda v, k: ~k.isin(*[t for kind in kinds for t in TYPES[kind]])
    if "enum" in d:
        yield f"{at}:enum", lambda v, k: ~text(v, k).isin(*[x for x in d["enum"] if x is not None])
    if "pattern" in d:
        yield f"{at}:pattern", lambda v, k: ~text(v, k).rlike(d["pattern"])
    if "minLength" in d:
        yield f"{at}:minLength", lambda v, k: F.length(text(v, k)) < d["minLength"]
    if "maxLength" in d:
        yield f"{at}:maxLength", lambda v, k: F.length(text(v, k)) > d["maxLength"]
    if "minimum" in d:
        yield f"{at}:minimum", lambda v, k: number(v, k) < d["minimum"]
    if "minItems" in d:
        yield f"{at}:minItems", lambda v, k: F.size(_elements(v, k)) < d["minItems"]
    if d.get("uniqueItems"):
        same = lambda x: F.concat(_kind(x), F.coalesce(F.to_json(x), F.lit("")))
        yield f"{at}:uniqueItems", lambda v, k: F.size(_elements(v, k)) != F.size(F.array_distinct(F.transform(_elements(v, k), same)))
    if d.get("additionalProperties") is False:
        yield f"{at}:additionalProperties", lambda v, k: F.size(F.array_except(keys(v, k), F.array(*map(F.lit, d.get("properties", {}))))) > 0


def findings(document: dict, path: str = "") -> Callable[[Column], Column]:
    """A function from a VARIANT to the list of `path:keyword` that it breaks.

    Values that are absent break nothing but required; a JSON null is a value. A value of
    another type breaks type alone. In a list (`[]` in the path) one element that breaks a rule
    is enough, and the rule is named once. A keyword that isn't known raises ValueError.
    """
    own, fields = list(_own_rules(document, path)), document.get("properties", {})
    below = f"{path}." if path else ""
    inner = {name: findings(part, below + name) for name, part in fields.items()}
    each = findings(document["items"], f"{path}[]") if "items" in document else None
    child = lambda v, name: F.try_variant_get(v, f"$['{name}']", "variant")

    def of(x: Column) -> Column:
        v, k = x["v"], x["k"]
        lacks = [F.when((k == "OBJECT") & child(v, name).isNull(), F.lit(f"{below}{name}:required")) for name in document.get("required", [])]
        parts = [F.array_compact(F.array(*[F.when(broken(v, k), F.lit(rule)) for rule, broken in own], *lacks))]
        parts += [found(child(v, name)) for name, found in inner.items()]
        if each:
            parts.append(F.array_distinct(F.flatten(F.transform(F.coalesce(_elements(v, k), F.array().cast("array<variant>")), each))))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    # the value and its kind are taken once, however many rules look at them
    once = lambda v: F.filter(F.array(F.struct(v.alias("v"), _kind(v).alias("k"))), lambda x: x["v"].isNotNull())
    return lambda v: F.flatten(F.transform(once(v), of))


def shape_findings(rows: DataFrame, raw: str, document: dict, key: str = "id") -> DataFrame:
    """(record_id, rule, severity) of all that breaks the document in rows' JSON texts.

    All findings of a record are returned. A text that is no JSON object has the single finding
    `record:unreadable`; so does a null one.
    """
    parsed = rows.select(F.col(key).cast("string").alias("record_id"), F.try_parse_json(F.col(raw)).alias("v"))
    readable = F.coalesce(_kind(F.col("v")) == "OBJECT", F.lit(False))
    found = F.when(readable, findings(document)(F.col("v"))).otherwise(F.array(F.lit("record:unreadable")))
    # explode() would have the list made again for a filter on its size
    return parsed.select("record_id", F.explode_outer(found).alias("rule")).filter("rule is not null").withColumn("severity", F.lit("error"))


def well_formed(rows: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """The rows without a finding, which alone go on to the rules of meaning."""
    return rows.join(found.select(F.col("record_id").alias(key)).distinct(), key, "left_anti")
