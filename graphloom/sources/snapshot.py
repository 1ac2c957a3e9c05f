"""Snapshots: JSON lines, a header first, then a record a line; portable exports; rows as JSON, CSV or a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let

#: The schema's version; per table the columns a record may have with their kinds, and those it must.
VERSION = 21
COLUMNS = {
    "thought": """thought_id string, thought_type string, essence string, content string, content_hash string, priority string, lifecycle_status string, created_cycle long, updated_cycle long,
        source string, confidence double, embedding_ref string, source_type string, confirmation_count long, consolidated_from string, visibility string, access_count long, last_accessed_at string,
        created_at string, updated_at string, expires_at string, metadata_json string, valid_from string, valid_until string, action_outcome_score double, provenance string, pinned long,
        archived_at_cycle long, archived_at string, revision long""",
    "edge": """edge_id string, from_thought_id string, to_thought_id string, edge_type string, weight double, created_cycle long, source string, decay_multiplier double, valid_from string,
        valid_until string, metadata_json string, revision long""",
    "embedding": "embedding_id string, owner_type string, owner_id string, model_name string, dimension long, vector_blob string, created_at string",
    "action": "action_id string, source_thought_id string, action_type string, intent string, status string, verification_status string, raw_metrics_json string, revision long",
}
REQUIRED = {
    "thought": ("thought_id", "thought_type", "essence", "content", "priority"), "edge": ("edge_id", "from_thought_id", "to_thought_id", "edge_type"),
    "embedding": ("embedding_id", "owner_type", "owner_id", "model_name", "dimension", "vector_blob"), "action": ("action_id", "source_thought_id", "action_type", "intent"),
}
TIMES = ("last_accessed_at", "created_at", "updated_at", "expires_at", "valid_from", "valid_until", "archived_at")


def _fields(name: str) -> dict[str, str]:
    return dict(part.split() for part in COLUMNS[name].split(","))


def packed(vector: Column) -> Column:
    """A vector as base 64 of its places in 32-bit floating point, the least significant byte first."""
    @F.pandas_udf("string")
    def pack(vectors):
        import base64

        import numpy as np
        import pandas as pd

        return pd.Series([None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in vectors])

    return pack(vector)


def unpacked(blob: Column) -> Column:
    """The vector of a base 64 text; null if it is none."""
    @F.pandas_udf("array<float>")
    def unpack(blobs):
        import base64
        import binascii

        import numpy as np
        import pandas as pd

        def one(text):
            try:
                raw = base64.b64decode(text, validate=True)
            except (binascii.Error, TypeError, ValueError):
                return None
            return np.frombuffer(raw, "<f4").tolist() if len(raw) % 4 == 0 else None

        return pd.Series([one(x) for x in blobs])

    return unpack(blob)


def _written(c: str, kind: str) -> Column:
    """A column as a snapshot writes it: instants in one UTC form, Booleans as 0 and 1."""
    if kind.startswith("timestamp"):
        at = F.col(c).cast("timestamp")
        whole, micros = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.pmod(F.unix_micros(at), F.lit(1_000_000))
        return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00")).alias(c)
    return F.col(c).cast("long").alias(c) if kind == "boolean" else F.col(c)


def lines(tables: dict[str, DataFrame], model: str | None = None, dimension: int | None = None) -> DataFrame:
    """One text column: the header, then every table's records. Columns that a table's records may not have are left out."""
    spark = next(iter(tables.values())).sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.lit("metadata").alias("_type"), F.lit(VERSION).alias("schema_version"), F.lit(model).alias("embedding_model_name"), F.lit(dimension).alias("embedding_dimension"))).alias("value"))
    for name, df in tables.items():
        if name == "embedding" and "vector" in df.columns:
            df = df.withColumn("vector_blob", packed(F.col("vector")))
        kinds = dict(df.dtypes)
        data = F.struct(*[_written(c, kinds[c]) for c in _fields(name) if c in kinds])
        head = head.unionByName(df.select(F.to_json(F.struct(F.lit(name).alias("_type"), data.alias("data"))).alias("value")))
    return head


def export(tables: dict[str, DataFrame], path: str, model: str | None = None, dimension: int | None = None) -> None:
    """Write a snapshot as a folder of JSON lines; Spark's commit makes it appear whole or not at all."""
    lines(tables, model, dimension).write.text(path)


def parsed(text: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(records of a table, its lines that are no valid record with the reason) of a snapshot's lines (column value).

    A record may have no column that its table hasn't, must have those that it requires, and each value's kind
    must be its column's. Instants are put into one UTC form, and vectors unpacked.
    """
    fields = _fields(name)
    # A map of texts keeps what the typed struct can't: names that no column has, and values of another kind.
    shape = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.data", "variant"))
    line = F.struct(
        F.from_json("value", "_type string, data map<string,string>").alias("x"),
        F.from_json("value", f"data struct<{', '.join(f'{k}:{v}' for k, v in fields.items())}>")["data"].alias("r"),
        F.coalesce(F.regexp_replace(shape, "[<>]", ", "), F.lit("")).alias("shape"),
    )

    def judged(line: Column) -> Column:
        data = line["x"]["data"]
        unknown = F.exists(F.map_keys(data), lambda k: ~k.isin(*fields))
        missing, wrong = F.lit(False), F.lit(False)
        for c in REQUIRED[name]:
            missing |= data[c].isNull()
        for c, kind in fields.items():
            bad = line["r"][c].isNull()
            if kind == "string":  # a text that reads like another JSON value must have been quoted
                bad |= ~F.contains(line["shape"], F.lit(f" {c}: STRING"))
            if c in TIMES:
                bad |= F.try_to_timestamp(data[c]).isNull()
            wrong |= data[c].isNotNull() & bad
        reason = F.when(data.isNull(), "no record").when(unknown, "unknown column").when(missing, "missing column").when(F.coalesce(wrong, F.lit(True)), "value of another kind")
        return F.when(line["x"]["_type"] == name, F.struct(reason.alias("reason"), line["r"].alias("r")))

    told = text.select("value", let(line, judged).alias("told")).filter("told IS NOT NULL")
    good = told.filter("told.reason IS NULL").select("told.r.*")
    for c in fields:
        if c in TIMES:
            good = good.withColumn(c, F.try_to_timestamp(c).cast("timestamp_ntz"))
    if name == "embedding":
        good = good.withColumn("vector", unpacked(F.col("vector_blob"))).drop("vector_blob")
    return good, told.filter("told.reason IS NOT NULL").select("value", F.col("told.reason").alias("reason"))


def header(text: DataFrame) -> DataFrame:
    """The header's row: schema_version, embedding_model_name, embedding_dimension."""
    x = F.from_json("value", "_type string, schema_version int, embedding_model_name string, embedding_dimension int")
    return text.select(x.alias("x")).filter("x._type = 'metadata'").select("x.schema_version", "x.embedding_model_name", "x.embedding_dimension")


def restore(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """parsed for the snapshot under a path. A snapshot of another schema version is an error."""
    text = spark.read.text(path)
    found = [r["schema_version"] for r in header(text).limit(2).collect()]
    if found != [VERSION]:
        raise ValueError(f"a snapshot has one header, of version {VERSION}, not {found}")
    return parsed(text, name)


def merged(store: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(store with the records whose key it hasn't, keys that it has already or that come twice)."""
    known = store.select(key)
    twice = records.groupBy(key).count().filter("count > 1").select(key)
    conflict = records.select(key).join(known, key, "left_semi").unionByName(twice).distinct()
    fresh = records.join(conflict, key, "left_anti")
    return store.unionByName(fresh, allowMissingColumns=True), conflict


def portable(thought: DataFrame, edge: DataFrame, status: str | None = None) -> DataFrame:
    """One text column of JSON: records, of one status if asked for, and all edges."""
    rows = thought if status is None else thought.filter(F.col("lifecycle_status") == status)
    line = lambda name, df: df.select(F.to_json(F.struct(F.lit(name).alias("kind"), F.struct(*df.columns).alias("record"))).alias("value"))
    return line("thought", rows).unionByName(line("edge", edge))


def formatted(df: DataFrame, form: str, most: int = 100) -> str:
    """The first rows as text: json, csv or table."""
    rows = df.limit(most)
    if form == "json":
        return "[" + ", ".join(r[0] for r in rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()) + "]"
    if form == "csv":
        body = [r[0] for r in rows.select(F.to_csv(F.struct(*[F.col(c).cast("string") for c in df.columns]))).collect()]
        return "\n".join([",".join(df.columns), *body])
    if form == "table":
        cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows.collect()]]
        width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
        return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells)
    raise ValueError(f"{form!r} is no format")
