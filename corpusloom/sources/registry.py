"""Registries of legal sources and laws, and the order in which laws are loaded."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_text

LAW_FIELDS = ("code", "full_id", "title", "canonical_title", "type", "hierarchy_level", "priority", "issuer", "issued_date", "effective_date", "repealed_date")


def read_mapping(path: str) -> dict[str, Any]:
    """A registry file: JSON, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML registries needs a YAML package; use JSON instead") from e
        return yaml.safe_load(f) or {}


def source_registry(spark: SparkSession, sources: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(source, title, alias, atom lists): one row for each folded alias of each source, its title among them.

    A source without a title or aliases is an error.
    """
    rows = []
    for key, value in sources.items():
        title = str(value.get("canonical_title") or "").strip()
        aliases = [str(a).strip() for a in value.get("aliases") or [] if str(a).strip()]
        if not title or not aliases:
            raise ValueError(f"source {key} needs a canonical_title and aliases")
        atoms = [str(a).strip().lower() for a in value.get("prolog_law_ids") or [] if str(a).strip()]
        rows += [(str(key), title, a, atoms) for a in [title, *aliases]]
    df = spark.createDataFrame(rows, "source string, title string, alias string, atoms array<string>")
    return df.withColumn("alias", fold_text(F.col("alias"))).where("alias <> ''").distinct()


def law_table(spark: SparkSession, laws: Mapping[str, Mapping[str, Any]], order: list[str] | None = None) -> DataFrame:
    """(law, ord, the fields of LAW_FIELDS, aliases, repeals): laws in load order, with the usual defaults."""
    chosen = [x for x in order or [] if x in laws] or list(laws)
    rows = []
    for i, key in enumerate(chosen):
        v = laws[key]
        if not v.get("full_id"):
            raise ValueError(f"law {key} needs a full_id")
        given = dict(v)
        given.setdefault("code", v.get("id") or key)
        given["title"] = v.get("title") or v.get("canonical_title") or key
        given["canonical_title"] = v.get("canonical_title") or v.get("title") or key
        given["type"], given["hierarchy_level"], given["priority"] = v.get("type") or "law", v.get("hierarchy_level") or "luật", v.get("priority") or 100
        names = sorted({str(key), *(str(given[f]) for f in ("code", "full_id", "title", "canonical_title")), *map(str, v.get("aliases") or []), *map(str, v.get("prolog_law_ids") or [])})
        rows.append((str(v.get("id") or key), i, *(None if given.get(f) in (None, "") else str(given[f]) for f in LAW_FIELDS), names, [str(r) for r in v.get("repeals") or []]))
    fields = ", ".join(f"{f} string" for f in LAW_FIELDS)
    return spark.createDataFrame(rows, f"law string, ord int, {fields}, aliases array<string>, repeals array<string>")


def alias_index(laws: DataFrame) -> DataFrame:
    """(alias, target): each folded name of a law, the last law of the load order for a shared one."""
    rows = laws.select("law", "ord", F.explode("aliases").alias("name")).select("law", "ord", fold_text(F.col("name")).alias("alias")).where("alias <> ''")
    return rows.groupBy("alias").agg(F.max_by("law", "ord").alias("target"))


def resolve_laws(values: DataFrame, column: str, laws: DataFrame, out: str = "law") -> DataFrame:
    """Adds the law that each value names: its id, a folded name, or a code whose number and year make a known id; else null."""
    known = F.broadcast(alias_index(laws))
    code = F.when(F.col(column).rlike(r"^\d+/\d{4}/"), F.concat(F.lit("L"), F.regexp_extract(column, r"^(\d+)/", 1), F.lit("_"), F.regexp_extract(column, r"^\d+/(\d{4})/", 1)))
    ids = F.broadcast(laws.select(F.col("law").alias("_id")))
    rows = values.join(ids, F.col(column) == F.col("_id"), "left").join(known.select("alias", F.col("target").alias("_t")), fold_text(F.col(column)) == F.col("alias"), "left").drop("alias")
    made = F.broadcast(laws.select(F.col("law").alias("_made")))
    rows = rows.join(made, code == F.col("_made"), "left")
    return rows.withColumn(out, F.coalesce("_id", "_t", "_made")).drop("_id", "_t", "_made")


def predicate_names(spark: SparkSession, aliases: Mapping[str, str], names: DataFrame, column: str = "name") -> DataFrame:
    """Adds ``canonical``: the name that an alias stands for, else the name."""
    table = spark.createDataFrame([(str(a), str(c)) for a, c in aliases.items()], "_alias string, _canonical string")
    return names.join(F.broadcast(table), F.col(column) == F.col("_alias"), "left").withColumn("canonical", F.coalesce("_canonical", column)).drop("_alias", "_canonical")
