"""Outputs that appear together or not at all.

A release is a folder of tables and reports named after its manifest: rows, columns and content fingerprint of every
table, and the reports.  Everything is written to a staging folder first, read back from there, checked and fingerprinted;
only then the folder gets its name and the pointer file is replaced.  Readers go by the pointer, so they see the last complete
release at any time.  The same content has the same name: repeating a release changes nothing.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import files_of
from .sinks import table_fingerprint

POINTER = "CURRENT"


class PublishError(AssertionError):
    """A check of the staged tables failed; nothing was published."""


def canonical_columns(df: DataFrame) -> list:
    """Columns in a form that every engine writes alike: doubles as integer millionths, nulls as ``-``."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.floor(c * 1_000_000 + 0.5).cast("long")
        out.append(F.coalesce(c.cast("string"), F.lit("-")))
    return out


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by one stream, replaced whole."""
    fs, where = files_of(spark, path)
    part = files_of(spark, f"{path}.{uuid.uuid4().hex}")[1]
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(where, False)
    fs.rename(part, where)


def _read_text(spark: SparkSession, path: str) -> str | None:
    if not files_of(spark, path)[0].exists(files_of(spark, path)[1]):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())   # one small file


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], dict] | None = None,
            reports: dict | None = None) -> dict:
    """Publishes ``tables`` and ``reports`` under ``root`` as one release and gives its manifest.

    ``check`` gets the staged tables as they were read back and returns violation counts; any that is not 0 discards the staging
    folder and raises :class:`PublishError`, as does any failure while writing.  A staging folder that a lost driver left
    behind is never read.
    """
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    fs, where = files_of(spark, staging)
    try:
        staged, listed = {}, {}
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            staged[name] = spark.read.parquet(f"{staging}/{name}")
            found = table_fingerprint(staged[name], canonical_columns(staged[name])).first()
            listed[name] = {"rows": found["rows"], "fingerprint": found["fingerprint"] or 0, "columns": [f"{n} {t}" for n, t in staged[name].dtypes]}
        bad = {k: v for k, v in (check(staged) if check else {}).items() if v}
        if bad:
            raise PublishError(f"checks failed, nothing published: {bad}")
        manifest = {"tables": listed, "reports": reports or {}}
        text = json.dumps(manifest, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()[:32]
        _write_text(spark, f"{staging}/manifest.json", text)
        final = files_of(spark, f"{root.rstrip('/')}/{name}")[1]
        if not fs.exists(final):
            fs.rename(where, final)
        _write_text(spark, f"{root.rstrip('/')}/{POINTER}", name)
        return manifest | {"release": name}
    finally:
        if fs.exists(where):
            fs.delete(where, True)


def current(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the release that is visible now, with its name; None before the first one."""
    name = _read_text(spark, f"{root.rstrip('/')}/{POINTER}")
    if name is None:
        return None
    return json.loads(_read_text(spark, f"{root.rstrip('/')}/{name}/manifest.json") or "{}") | {"release": name}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the visible release."""
    found = current(spark, root)
    if found is None or table not in found["tables"]:
        raise FileNotFoundError(f"no published table {table} under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{found['release']}/{table}")
