"""Text, CSV and document files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.sources import store

CSV = {"header": True, "nullValue": "\\N", "escape": '"'}


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.options(**CSV, sep=sep).csv(path)


def read_csv(spark: SparkSession, path: str, schema, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(**CSV, sep=sep).csv(path)


def through_csv(df: DataFrame, name: str, sep: str = ",") -> DataFrame:
    """Written as CSV to the shared folder and read back."""
    path = store.fresh(df.sparkSession, name)
    write_csv(df, path, sep)
    return read_csv(df.sparkSession, path, df.schema, sep)


def through_text(lines: DataFrame, name: str) -> DataFrame:
    """One string column as a text file, read back as `value`."""
    path = store.fresh(lines.sparkSession, name)
    lines.write.text(path)
    return lines.sparkSession.read.text(path)


def statements(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Lines `user, frame_id, text1, text2` as statements of the frames' relation; others are left out."""
    part = F.split(F.trim("value"), ", ")
    rows = lines.where(F.size(part) == 4).select(part[0].alias("user"), part[1].try_cast("int").alias("frame_id"), part[2].alias("text1"), part[3].alias("text2"))
    return rows.join(F.broadcast(frames.select("frame_id", "relation", "freq")), "frame_id").select("user", "frame_id", "relation", "freq", "text1", "text2")


def lexicon(lines: DataFrame) -> DataFrame:
    """Lines `word TAG TAG ...` as (lower-case word, tag) rows."""
    part = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    return lines.select(F.lower(part[0]).alias("word"), F.explode(F.slice(part, F.lit(2), F.greatest(F.size(part), F.lit(1)))).alias("tag"))


def rules(lines: DataFrame) -> DataFrame:
    """Lines `match replacement words` as autocorrection rules, split at the first space."""
    part = F.split(F.trim("value"), r"\s+", 2)
    return lines.where(F.size(part) == 2).select(part[0].alias("match"), part[1].alias("replace_with"))


def colour_contexts(spark: SparkSession, paths: list[str], strong: int = 50, weak: int = 10) -> DataFrame:
    """Files of comma-separated words, named by colour, as (colour, word, weight): the colour's own name weighs more.

    A folder of part files counts as a file of the folder's name.
    """
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:/part-[^/]*|\.[a-z]+)?$", 1)
    rows = spark.read.text(paths, wholetext=True).select(stem.alias("colour"), F.explode(F.split("value", ",")).alias("word"))
    word = F.lower(F.regexp_replace("word", r"^\s+|\s+$", ""))
    return rows.select("colour", word.alias("word")).where("word <> ''").select("colour", "word", F.when(F.col("word") == F.col("colour"), strong).otherwise(weak).alias("weight"))


def corrected(text: Column, rules_: list[tuple[str, str]]) -> Column:
    """Whole words replaced by the rules, in their order."""
    for match, by in rules_:
        text = F.regexp_replace(text, rf"\b\Q{match}\E\b", by)
    return text


def documents_out(df: DataFrame, model: str, key: str) -> DataFrame:
    """Rows as YAML documents {model, pk, fields}; JSON is YAML's flow form."""
    fields = F.struct(*[c for c in df.columns if c != key])
    return df.select(F.concat(F.lit("--- "), F.to_json(F.struct(F.lit(model).alias("model"), F.col(key).cast("string").alias("pk"), fields.alias("fields")))).alias("value"))


def documents_in(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """model, pk and fields of a stream of such documents."""
    docs = spark.read.option("lineSep", "\n").text(path)
    parsed = F.from_json(F.regexp_replace("value", "^--- ", ""), f"model string, pk string, fields struct<{fields}>")
    return docs.where("value <> ''").select(parsed.alias("d")).select("d.model", "d.pk", "d.fields.*")


def blocks_out(df: DataFrame, model: str, key: str) -> DataFrame:
    """Rows as YAML documents in block form: strings as literal blocks over as many lines as they have, other fields as JSON.

    Lines of a literal block are indented, so no text looks like the start of a document.
    """
    fields = []
    for f in df.schema.fields:
        if f.name != key:
            if f.dataType.typeName() == "string":
                value = F.concat(F.lit("|\n    "), F.replace(F.col(f.name), F.lit("\n"), F.lit("\n    ")))
            else:
                value = F.regexp_extract(F.to_json(F.struct(F.col(f.name).alias("x"))), r"^\{.x.:(.*)\}$", 1)
            fields.append(F.concat(F.lit(f"\n  {f.name}: "), F.when(F.col(f.name).isNull(), "null").otherwise(value)))
    head = F.concat(F.lit(f"--- \nmodel: {model}\npk: "), F.col(key).cast("string"), F.lit("\nfields:"))
    return df.select(F.concat(head, *fields).alias("value"))


def blocks_in(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """model, pk and fields of a stream of such documents.

    Files are split into documents at `\\n--- `, wherever the splits of a file lie, so large files are read by many tasks.
    """
    docs = spark.read.option("lineSep", "\n--- ").text(path).select(F.concat(F.lit("\n"), F.regexp_replace("value", "^--- |\n$", "")).alias("d")).where("d <> '\n'")
    # what stands behind a name up to the next line that is indented as a name is
    after = lambda indent, name: F.split(F.get(F.split(F.col("d"), f"\n{indent}{name}: ", 2), F.lit(1)), f"\n {{0,2}}(?=[^ \n])", 2)[0]
    out = [after("", "model").alias("model"), after("", "pk").alias("pk")]
    for f in spark.createDataFrame([], fields).schema.fields:
        raw = after("  ", f.name)
        if f.dataType.typeName() == "string":
            value = F.when(raw.startswith("|\n    "), F.replace(F.substring(raw, 7, 1 << 30), F.lit("\n    "), F.lit("\n")))
        else:
            value = F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), f"x {f.dataType.simpleString()}").x
        out.append(value.alias(f.name))
    return docs.select(*out)


def through_blocks(df: DataFrame, model: str, key: str) -> DataFrame:
    """Written as block documents to the shared folder and read back."""
    path = store.fresh(df.sparkSession, model)
    blocks_out(df, model, key).write.text(path)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != key)
    return blocks_in(df.sparkSession, path, fields)


def masked(df: DataFrame, private: list[str]) -> DataFrame:
    """A table for publication: private columns blank."""
    return df.select(*[F.lit("").alias(c) if c in private else F.col(c) for c in df.columns])


def emitted(df: DataFrame, kind: str) -> DataFrame:
    """Rows as `json`, `xml` or `yaml` texts."""
    row = F.struct(*df.columns)
    if kind == "xml":
        return df.select(F.to_xml(row).alias("value"))
    text = F.to_json(row)
    return df.select((F.concat(F.lit("--- "), text) if kind == "yaml" else text).alias("value"))
