"""Save and load fitted models, as committed versions below one folder."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from effectspark.operators.effects import EffectModel, EffectSpec, EffectTable
from effectspark.sources.store import Stored, Workspace
from effectspark.sources.versions import Versions


def save_model(model: EffectModel, path: str) -> str:
    """Write one parquet table per effect, then commit them as the next version.

    Until the commit, readers find the version before; two writers give two versions.
    """
    spark = model.tables[0].stored.df.sparkSession if model.tables else SparkSession.active()
    versions = Versions(spark, path)
    folder = versions.new_folder()
    about = {
        "lambdas": list(model.lambdas),
        "by": model.by,
        "mu": [[k, v] for k, v in model.mu.items()],
        "effects": [],
    }
    for t in model.tables:
        where = f"{folder}/effect={t.spec.name}"
        t.stored.df.write.parquet(where)
        about["effects"].append(
            {
                "name": t.spec.name, "key": t.spec.key, "wide": t.spec.wide, "shared_dev": t.shared_dev,
                "path": where, "rows": t.stored.rows, "bytes": t.stored.bytes, "schema": t.stored.df.schema.json(),
            }
        )
    versions.commit_next(about)
    return path


def load_model(spark: SparkSession, path: str, ws: Workspace, version: int | None = None) -> EffectModel:
    """The newest committed model, or a given version of it."""
    versions = Versions(spark, path)
    version = versions.latest() if version is None else version
    if version is None:
        raise FileNotFoundError(f"no model has been saved to {path}")
    about = versions.read(version)
    tables = []
    for e in about["effects"]:
        df = spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(e["path"])
        spec = EffectSpec(e["name"], e["key"], e["wide"])
        tables.append(EffectTable(spec, Stored(df, e["path"], e["rows"], e["bytes"]), e["shared_dev"]))
    return EffectModel(
        specs=tuple(t.spec for t in tables),
        lambdas=tuple(about["lambdas"]),
        by=about["by"],
        mu={k: v for k, v in about["mu"]},
        tables=tuple(tables),
        broadcast_bytes=ws.broadcast_bytes,
    )
