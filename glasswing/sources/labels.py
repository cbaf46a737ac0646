"""Label files, dictionaries and settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswing.functions.vectors import normalized
from glasswing.operators.store import overridden

FILE = "model string, dim int, logitScale double, labels array<struct<name:string,prompt:string,group:string,embedding:array<float>>>"
BLOCKS = "array<struct<text:string,confidence:float,x:float,y:float,w:float,h:float>>"


def label_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """``(label, ord, grp, prototype)`` of a JSON label file, and its logit scale; an empty group is none."""
    rows = spark.read.schema(FILE).json(path, multiLine=True)
    scale = rows.select("logitScale").first()[0]
    out = rows.select(F.posexplode("labels").alias("ord", "l"))
    return out.select(F.col("l.name").alias("label"), "ord", F.nullif(F.col("l.group"), F.lit("")).alias("grp"), F.col("l.embedding").alias("prototype")), scale


def export_labels(labels: DataFrame, path: str, model: str, scale: float) -> None:
    """Writes a label file with unit-length embeddings; the vocabulary is small by its nature."""
    rows = labels.orderBy("ord").select("label", "prompt", "grp", normalized(F.col("prototype")).alias("v")).collect()
    made = [{"name": r.label, "prompt": r.prompt, "group": r.grp or "", "embedding": list(r.v)} for r in rows]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"model": model, "dim": len(made[0]["embedding"]) if made else 0, "logitScale": scale, "labels": made}, f)


def label_definitions(text: str) -> list[dict]:
    """Labels of a YAML list with name, prompt and group; names must be there and differ."""
    import yaml

    out = [{"name": x.get("name"), "prompt": x.get("prompt") or x.get("name"), "group": x.get("group") or ""} for x in (yaml.safe_load(text) or {}).get("labels", [])]
    names = [x["name"] for x in out]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("labels need names, each once")
    return out


def definitions(spark: SparkSession, base: str, local: str | None = None) -> DataFrame:
    """``(name, ord, prompt, group)`` of a YAML list of labels, with those of an optional local one.

    A local label takes the place of the base label of its name, in its order; others come after
    the base ones in theirs. No labels at all are an error.
    """
    schema = "name string, ord int, prompt string, `group` string"
    frame = lambda text: spark.createDataFrame([(x["name"], i, x["prompt"], x["group"]) for i, x in enumerate(label_definitions(text))], schema)
    rows = frame(base)
    if local is not None:
        rows = overridden(rows, frame(local).select(*rows.columns)).select(*rows.columns)
    if rows.isEmpty():
        raise ValueError("no labels defined")
    return rows


def characters(text: str) -> list[str]:
    """The dictionary of a recogniser: the blank, a character for each line, a space."""
    return ["", *text.splitlines(), " "]


def blocks_of(value: Column) -> Column:
    """Recognised blocks from their JSON."""
    return F.from_json(value, BLOCKS)


@dataclass
class Settings:
    """What can be configured, with the values that hold otherwise."""

    roots: dict[str, str] = field(default_factory=dict)
    detection_threshold: float = 0.5
    classification_threshold: float = 0.2
    frames: int = 4
    search_limit: int = 500
    thumbnail_days: int = 90
    videos: bool = True
    analyse_on_browse: bool = True

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        import yaml

        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (yaml.safe_load(text) or {}).items() if k in known})
