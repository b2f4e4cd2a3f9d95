"""The report document: every section in one nested JSON text, written in parallel.

The document is a table of pieces of text, one per entry and one per opening or closing
line of a list or object. One range-partitioned sort puts all pieces in order; their
numbers come from the sort's row ids and a count per part. Nothing, neither a section nor
the document, is gathered into a row or a task: the written parts follow each other by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickreports.functions.metrics import iso_date
from clickreports.operators.cells import by_first_source
from clickreports.plans.catalog import BY_SOURCE, OVERALL, SOURCE, Report
from clickreports.plans.marts import Marts

# The sections in document order. "sankey" nests its two parts.
SECTIONS = (
    "meta",
    "kpi",
    "funnel",
    "sankey",
    "journeys",
    "funnel_by_source",
    "daily_trend",
    "event_distribution",
    "purchase_frequency",
    "platform_distribution",
    "revenue_trend",
    "hourly_heatmap",
    "aov_distribution",
    "new_vs_returning",
    "revenue_by_source",
    "session_depth_cvr",
    "engagement_distribution",
    "hourly_revenue",
    "day_of_week",
    "top_items",
    "device_category_cvr",
    "os_cvr",
    "browser_cvr",
    "geo_region",
    "geo_country",
    "traffic_source_name_cvr",
    "traffic_source_medium_cvr",
    "traffic_source_source_cvr",
    "page_path_cvr",
    "event_distribution_full",
    "page_referrer_cvr",
    "visit_frequency",
)
SOURCE_SECTIONS = (
    "kpi",
    "funnel",
    "daily_trend",
    "purchase_frequency",
    "funnel_by_source",
    "revenue_trend",
    "hourly_heatmap",
    "aov_distribution",
    "new_vs_returning",
    "session_depth_cvr",
    "engagement_distribution",
    "hourly_revenue",
    "day_of_week",
    "top_items",
    "device_category_cvr",
    "os_cvr",
    "browser_cvr",
    "geo_region",
    "geo_country",
    "page_path_cvr",
    "event_distribution_full",
    "page_referrer_cvr",
    "visit_frequency",
)
# End of fixed values.
SANKEY_PARTS = {"nodes": "sankey_nodes", "links": "sankey_links"}
SINGLE_ROW = ("meta", "kpi")
ALL = "all"

_JSON = {"ignoreNullFields": "false", "pretty": "true"}
_JSON_LINE = {"ignoreNullFields": "false"}
_KEYS = 4  # most columns that a report is ordered by
_LAST = 1 << 20  # a place after all others

# What a piece is sorted by: section, part of it, source and section within it, opening, entry or closing.
_PLACES = ("at", "part", "ranked", "source", "inner", "kind")


def bundle(m: Marts) -> DataFrame:
    """The document's pieces: ``line``, ``scope``, ``section``, ``is_entry``, ``text``.

    The texts in the order of ``line``, from 0, one per line or several, are the document. An
    entry's piece is its JSON text, followed by a comma unless it is its list's last;
    ``scope`` is ``all`` or a source. The pieces of an empty list are its brackets.
    """
    land = m.store.land
    pieces = land("document_pieces", _union([_entries(m, name, s) for name, s in _sections()] + [_brackets(m)]))
    order = [*_PLACES, *(f"{kind}_{k}" for k in range(_KEYS) for kind in ("null", "whole", "real", "name"))]
    in_order = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    in_order = in_order.select("scope", "section", "inside", "ends", "kind", "text", F.monotonically_increasing_id().alias("row"))
    in_order = land("document_order", in_order)
    part = F.shiftright("row", 33)
    counts = in_order.groupBy(part.cast("int").alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per part of the sort, at most as many as there are shuffle partitions.
    parts, before = [], 0
    for one in sorted(counts.collect()):
        parts.append((one["part"], before - one["first"]))
        before += one["n"]
    parts = in_order.sparkSession.createDataFrame(parts, "part int, offset long")
    last = in_order.where("ends").groupBy("inside").agg(F.max("row").alias("last"))
    numbered = in_order.withColumn("part", part.cast("int")).join(F.broadcast(parts), "part")
    numbered = numbered.join(land("document_lists", last), "inside", "left")
    comma = F.when(F.col("ends") & (F.col("row") < F.col("last")), ",").otherwise("")
    line = F.col("row") + F.col("offset")
    return numbered.select(
        line.alias("line"), "scope", "section", (F.col("kind") == 1).alias("is_entry"), F.concat("text", comma).alias("text")
    )


def write_bundle(m: Marts, path: str) -> None:
    """Write the document as text files in folder ``path``: their contents in the order of their names."""
    lines = bundle(m).repartitionByRange("line").sortWithinPartitions("line")
    lines.select("text").write.mode("overwrite").text(path)


def write_tables(m: Marts, folder: str) -> None:
    """Write each report as a Parquet table, per-source ones under ``by_source``."""
    for reports, place in ((OVERALL, folder), (BY_SOURCE, f"{folder}/by_source")):
        for name, report in reports.items():
            report.table(m).write.mode("overwrite").parquet(f"{place}/{name}")


def section_rows(m: Marts) -> DataFrame:
    """Every entry of every section as a row: ``scope`` (``all`` or a source), ``section``, ``entry``.

    ``entry`` is a struct's JSON text with dates in ISO form. Nothing is gathered, whatever
    the number of entries.
    """
    parts = [section_entries(m, name) for name in OVERALL]
    return _union(parts + [section_entries(m, name, by_source=True) for name in BY_SOURCE])


def section_entries(m: Marts, name: str, by_source: bool = False) -> DataFrame:
    """The rows of one section, as ``section_rows`` has them."""
    report, scope = (BY_SOURCE[name], F.col(SOURCE)) if by_source else (OVERALL[name], F.lit("all"))
    rows = report.rows(m)
    fields = F.struct(*[_field(rows, c).alias(c) for c in report.columns if c != SOURCE])
    return rows.select(scope.alias("scope"), F.lit(name).alias("section"), F.to_json(fields, _JSON_LINE).alias("entry"))


def write_sections(m: Marts, folder: str) -> None:
    """Write each section as JSON lines in parallel, a folder per section; for lists too long for one document."""
    section_rows(m).write.mode("overwrite").partitionBy("section").json(folder)


def _sections() -> list[tuple[str, bool]]:
    listed = [part for name in SECTIONS for part in (SANKEY_PARTS.values() if name == "sankey" else (name,))]
    return [(name, False) for name in listed] + [(name, True) for name in SOURCE_SECTIONS]


def _place(name: str) -> tuple[int, int, int]:
    """Section, part of it, and depth of an overall section's brackets."""
    for number, part in enumerate(SANKEY_PARTS.values(), start=1):
        if name == part:
            return SECTIONS.index("sankey"), number, 2
    return SECTIONS.index(name), 0, 1


def _entries(m: Marts, name: str, by_source: bool) -> DataFrame:
    """The pieces of one section's entries, or of its only row."""
    report: Report = (BY_SOURCE if by_source else OVERALL)[name]
    rows = report.rows(m)
    if by_source and name in ("funnel", "funnel_by_source"):  # by the event's own source
        rows = rows.join(_known_sources(m), SOURCE, "left_semi")
    fields = F.struct(*[_field(rows, c).alias(c) for c in report.columns if c != SOURCE])
    source = F.col(SOURCE) if by_source else F.lit(None).cast("string")
    at, part, depth = (len(SECTIONS), 0, 3) if by_source else _place(name)
    single = name in SINGLE_ROW
    text = F.to_json(fields, _JSON)
    if single:
        text = F.concat(F.lit(f'"{name}" : '), text)
    inside = _inside(name, source, by_source, outer=single)
    places = [F.lit(at), F.lit(part), F.lit(1 if by_source else 0), source, F.lit(SOURCE_SECTIONS.index(name) if by_source else 0)]
    keys = [key for key in report.order if key != SOURCE]
    return rows.select(
        *[p.alias(c) for p, c in zip((*places, F.lit(1)), _PLACES, strict=True)],
        *[column for k in range(_KEYS) for column in _key(rows, keys[k] if k < len(keys) else None, k)],
        (source if by_source else F.lit(ALL)).alias("scope"),
        F.lit(name).alias("section"),
        inside.alias("inside"),
        F.lit(True).alias("ends"),
        _indented(text, depth if single else depth + 1).alias("text"),
    )


def _key(rows: DataFrame, key: str | None, number: int) -> list[Column]:
    """One of a report's order columns in a form that all reports share: NULLs first when ascending."""
    null, whole, real, name = F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if key is not None:
        falls, column = key.startswith("-"), F.col(key.removeprefix("-"))
        kind = rows.schema[key.removeprefix("-")].dataType
        null = (column.isNull() if falls else column.isNotNull()).cast("int")
        sign = F.lit(-1 if falls else 1)
        if isinstance(kind, T.StringType):
            if falls:
                raise ValueError(f"{key}: texts ascend")
            name = column
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            real = column.cast("double") * sign
        else:
            whole = (F.unix_date(column) if isinstance(kind, T.DateType) else column).cast("long") * sign
    columns = {"null": null, "whole": whole, "real": real, "name": name}
    return [column.alias(f"{kind}_{number}") for kind, column in columns.items()]


def _brackets(m: Marts) -> DataFrame:
    """The pieces around the entries; those of every source that has users, also for its empty lists."""
    rows = [(-1, 0, 0, 0, 0, "", "", False, "{"), (_LAST, 0, 0, 0, 2, "", "", False, "}")]
    for name in SECTIONS:
        at = SECTIONS.index(name)
        if name == "sankey":
            rows += [(at, 0, 0, 0, 0, name, "", False, '  "sankey" : {'), (at, _LAST, 0, 0, 2, name, "document", True, "  }")]
        for part in SANKEY_PARTS if name == "sankey" else (name,):
            section = SANKEY_PARTS.get(part, part)
            if section not in SINGLE_ROW:
                place, number, depth = _place(section)
                outer = "sankey" if name == "sankey" else "document"
                rows += _list(place, number, 0, 0, section, part, outer, depth)
    at = len(SECTIONS)
    rows += [(at, 0, 0, 0, 0, "by_source", "", False, '  "by_source" : {'), (at, 0, 2, 0, 2, "by_source", "document", True, "  }")]
    fields = "at int, part int, ranked int, inner int, kind int, section string, inside string, ends boolean, text string"
    spark = m.users.sparkSession
    overall = spark.createDataFrame(rows, fields).withColumn("scope", F.lit(ALL)).withColumn("source", F.lit(None).cast("string"))
    rows = [(at, 0, 1, -1, 0, "", "", False, '    "{source}" : {'), (at, 0, 1, _LAST, 2, "", "by_source", True, "    }")]
    for number, name in enumerate(SOURCE_SECTIONS):
        if name not in SINGLE_ROW:
            rows += _list(at, 0, 1, number, name, name, "{source}", 3)
    names = [field.split()[0] for field in fields.split(", ")]
    listed = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row, strict=True)]) for row in rows])
    per_source = _known_sources(m).select(F.col(SOURCE).alias("source"), F.inline(listed))
    filled = {c: F.replace(F.col(c), F.lit("{source}"), F.col("source")) for c in ("inside", "text")}
    per_source = per_source.withColumns({**filled, "scope": F.col("source")})
    both = overall.unionByName(per_source)
    unused = [column for k in range(_KEYS) for column in _key(both, None, k)]
    return both.select(*_PLACES, *unused, "scope", "section", "inside", "ends", "text")


def _known_sources(m: Marts) -> DataFrame:
    """Sources that touched somebody first; only these stand under ``by_source``."""
    return by_first_source(m.users).select(SOURCE).distinct()


def _list(at: int, part: int, ranked: int, inner: int, section: str, name: str, outer: str, depth: int) -> list[tuple]:
    margin = "  " * depth
    return [
        (at, part, ranked, inner, 0, section, "", False, f'{margin}"{name}" : ['),
        (at, part, ranked, inner, 2, section, outer, True, f"{margin}]"),
    ]


def _inside(name: str, source: Column, by_source: bool, outer: bool) -> Column:
    """The list or object that a piece is a member of."""
    if by_source:
        return source if outer else F.concat(source, F.lit(f"/{name}"))
    return F.lit("document" if outer else f"document/{name}")


def _indented(text: Column, depth: int) -> Column:
    margin = "  " * depth
    return F.concat(F.lit(margin), F.regexp_replace(text, "\n", f"\n{margin}"))


def _field(rows: DataFrame, name: str) -> Column:
    return iso_date(name) if isinstance(rows.schema[name].dataType, T.DateType) else F.col(name)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union in pairs: every step analyses its whole plan, so a chain would be quadratic."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [pair[0].unionByName(pair[1]) if len(pair) == 2 else pair[0] for pair in pairs]
    return parts[0]
