"""Small dimension tables from YAML or dicts: concepts, synonyms, conflicts, policies."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

def load_yaml(path: str) -> dict:
    """Parsed YAML; a missing file gives an empty dict."""
    try:
        import yaml
    except ImportError as e:  # optional dependency
        raise RuntimeError("reading YAML needs the yaml package") from e
    p = Path(path)
    return (yaml.safe_load(p.read_text(encoding="utf-8")) or {}) if p.exists() else {}


def concept_tables(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """(concepts with an ``editions`` map, edition years) from a timeline document."""
    years = [(e["edition_id"], int(e["year"])) for e in data.get("editions_metadata", [])]
    rows = []
    for i, c in enumerate(data.get("concepts", [])):
        eds = {
            k: ((v.get("status", "maintained"), v.get("note", "")) if isinstance(v, dict) else ("maintained", ""))
            for k, v in (c.get("editions") or {}).items()
        }
        rows.append((c.get("concept_id", ""), i, c.get("name_ko", ""), c.get("name_en", ""), c.get("category", ""),
                     c.get("first_edition", ""), c.get("last_edition"), c.get("description", ""), eds))
    concepts = spark.createDataFrame(
        rows,
        "concept_id string, concept_ord int, name_ko string, name_en string, category string, first_edition string, "
        "last_edition string, description string, editions map<string,struct<status:string,note:string>>",
    )
    return concepts, spark.createDataFrame(years, "edition_id string, year int")


def synonym_clusters(spark: SparkSession, data: dict) -> DataFrame:
    rows = [(i, c.get("name", ""), list(c.get("terms", []))) for i, c in enumerate(data.get("synonym_clusters", []))]
    return spark.createDataFrame(rows, "cluster_ord int, name string, terms array<string>")


def known_conflicts(spark: SparkSession, data: dict) -> DataFrame:
    raw = data.get("temporal_conflict", {}).get("known_conflicts", [])
    rows = [(i, c.get("concept", ""), c.get("concept_id", ""), list(c.get("editions", [])), c.get("note", "")) for i, c in enumerate(raw)]
    return spark.createDataFrame(rows, "ord int, concept string, concept_id string, editions array<string>, note string")


def policy_values(data: dict, default: dict) -> dict:
    """Policy parameters from a policy document, the default where it is silent."""
    p = data.get("policy", {})
    latest, evo = p.get("latest_first", {}), p.get("evolution", {})
    return {
        "latest_first_intents": latest.get("forced_intents", default["latest_first_intents"]),
        "primary_edition": latest.get("primary_edition", default["primary_edition"]),
        "min_hits": latest.get("min_hits", default["min_hits"]),
        "fallback_editions": latest.get("fallback_editions", default["fallback_editions"]),
        "evolution_intents": evo.get("forced_intents", default["evolution_intents"]),
    }
