"""JSON listings to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# fixed values: where the items of a listing may be
ITEM_PATHS = ("data.results", "data.rows", "data.list", "data.records", "results", "rows", "list")


def _list_at(payload: Column, path: Column) -> Column:
    """The texts of the list at a dotted path of any depth, which may differ by row; null if there is none."""
    steps = F.split(path, r"\.")
    # a step that can't be quoted names no field
    json_path = F.when(~path.rlike(r"['\[\]*]"), F.concat(F.lit("$['"), F.array_join(steps, "']['"), F.lit("']")))
    return F.from_json(F.call_function("get_json_object", payload, json_path), "array<string>")


def items(payload: Column, configured: Column | str | None = "data.results") -> Column:
    """The objects of a non-empty list of a payload, as maps of texts: the list at the configured
    dotted path (null: data.results), else at the first of ITEM_PATHS that has one. Elements that
    aren't objects go, also if none is left."""
    path = F.coalesce(configured, F.lit("data.results")) if isinstance(configured, Column) else F.lit(configured)
    found = [_list_at(payload, p) for p in (path, *map(F.lit, ITEM_PATHS))]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in found])
    maps = F.transform(F.filter(first, lambda x: x.startswith("{")), lambda x: F.from_json(x, "map<string,string>"))
    return F.coalesce(maps, F.array().cast("array<map<string,string>>"))


def listing_docs(payloads: DataFrame) -> DataFrame:
    """Documents of listings: payloads has source_id, payload, items_path, field_map, url_template and list_url.

    Fields come by the source's field map. Items go whose title is missing or under four
    characters after cleaning, and those without a url and without all fields of the template.
    """
    path = F.col("items_path") if "items_path" in payloads.columns else None
    p = payloads.select("source_id", "list_url", "url_template", "field_map", F.posexplode(items(F.col("payload"), path if path is not None else "data.results")).alias("at", "item"))
    field = lambda name, default: F.col("item")[F.coalesce(F.col("field_map")[name], F.lit(default))]
    title, url, date = S.clean_title(field("title", "title")), F.trim(field("url", "url")), field("date", "publishedTime")
    link = F.when(F.coalesce(url, F.lit("")) != "", S.absolute_url(url, F.col("list_url"))).otherwise(S.render_template(F.coalesce("url_template", F.lit("")), F.col("item")))
    out = p.select("source_id", "at", title.alias("title"), link.alias("url"), S.any_date(date).alias("published_on"), field("title", "title").alias("raw"))
    return out.filter((F.length("title") >= 4) & F.col("url").isNotNull() & F.col("raw").isNotNull()).drop("raw")

