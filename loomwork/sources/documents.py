"""Documents of records in JSON: a wrapped list, a list, or a single record, with bad ones told rather than dropped.

All of it is VARIANT expressions in one scan; a document is bad as a whole, as one record that can't be read spoils the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _items(text: Column, key: str) -> tuple[Column, Column]:
    doc = F.try_parse_json(text)
    wrapped, listed = (F.try_variant_get(doc, p, "array<variant>") for p in (f"$.{key}", "$"))
    whole = F.try_variant_get(doc, "$", "map<string,variant>")
    return doc, F.coalesce(wrapped, listed, F.when(whole.isNotNull(), F.array(doc)))


def parsed(files: DataFrame, key: str, fields: dict[str, str], required: list[str] = ("id",)) -> DataFrame:
    """(path, items, error): the records of each document (path, text), or what is wrong with it.

    A record is a struct of the fields (name: type), ``other`` (a JSON text of all its keys that aren't fields, which are kept),
    and the line of its id.  Wrong are text that isn't JSON, a record that isn't an object, a required field that is missing and
    a field of another type.
    """
    doc, items = _items(F.col("text"), key)
    rows = files.select("path", "text").withColumns({"_doc": doc, "_items": items})

    def record(v: Column) -> Column:
        known = F.map_filter(F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin(*fields))
        return F.struct(*[F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in fields.items()], F.to_json(F.transform_values(known, lambda _, x: F.to_json(x))).alias("other"))

    def fault(v: Column) -> Column:
        wrong = F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), F.lit("a record isn't an object"))
        for n in required:
            wrong = wrong.when(F.try_variant_get(v, f"$.{n}", "variant").isNull() | F.is_variant_null(F.try_variant_get(v, f"$.{n}", "variant")), F.lit(f"missing field {n}"))
        for n, t in fields.items():
            inner = F.try_variant_get(v, f"$.{n}", "variant")
            wrong = wrong.when(inner.isNotNull() & ~F.is_variant_null(inner) & F.try_variant_get(v, f"$.{n}", t).isNull(), F.lit(f"field {n} isn't {t}"))
        return wrong

    error = F.when(F.col("_doc").isNull(), "not JSON").when(F.col("_items").isNull(), "neither records nor a record").otherwise(F.get(F.filter(F.transform("_items", fault), lambda e: e.isNotNull()), F.lit(0)))
    rows = rows.withColumn("error", error)
    return rows.select("path", "text", F.when(F.col("error").isNull(), F.transform("_items", record)).alias("items"), "error")


def id_line(text: Column, identifier: Column) -> Column:
    """The first line that begins with the key ``id`` and holds the identifier; null if none does."""
    lines = F.split(text, r"\r?\n")
    own = lambda x: (F.startswith(F.ltrim(x), F.lit("id:")) | F.startswith(F.ltrim(x), F.lit('"id"'))) & F.contains(x, identifier)
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(own(x), i + 1)), lambda i: i.isNotNull()), F.lit(0))
    return at.cast("int")


def records(files: DataFrame, key: str, fields: dict[str, str], required: list[str] = ("id",)) -> DataFrame:
    """(path, place, line, fields..., other) of the records of good documents."""
    rows = parsed(files, key, fields, required).where("error IS NULL").select("path", "text", F.posexplode("items").alias("place", "x"))
    line = id_line(F.col("text"), F.col("x.id").cast("string")) if "id" in fields else F.lit(None).cast("int")
    return rows.select("path", "place", line.alias("line"), "x.*")


def record_errors(files: DataFrame, key: str, fields: dict[str, str], required: list[str] = ("id",)) -> DataFrame:
    """(severity, code, path, message) of bad documents."""
    rows = parsed(files, key, fields, required).where("error IS NOT NULL")
    return rows.select(F.lit("error").alias("severity"), F.lit("metadata-parse").alias("code"), "path", F.col("error").alias("message"))


def read_faults(raw: DataFrame, largest: int) -> DataFrame:
    """(severity, code, path) of files (path, content) that can't be scanned: too large, with NUL bytes, or not UTF-8."""
    text = F.col("content").cast("string")
    code = F.when(F.length("content") > largest, F.struct(F.lit("warning").alias("severity"), F.lit("source-size").alias("code"))).when(F.contains(text, F.lit("\x00")), F.struct(F.lit("info").alias("severity"), F.lit("source-binary").alias("code")))
    code = code.when(~F.is_valid_utf8(text), F.struct(F.lit("info").alias("severity"), F.lit("source-encoding").alias("code")))
    return raw.withColumn("_f", code).where("_f IS NOT NULL").select("_f.severity", "_f.code", "path")
