"""Functions that Markdown files define: their schemas, dependencies and creation, and calls checked against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.frontmatter import front_matter

# The schema of a function that states none, and what a name looks like.
DEFAULT_SCHEMA = '{"type":"object","properties":{"input":{"type":"string","description":"Input"}},"required":["input"]}'
NAME = "^[a-zA-Z_][a-zA-Z0-9_-]*$"
#: What is read of a schema to check calls.
SCHEMA = "struct<properties:map<string,struct<type:string,enum:array<string>>>,required:array<string>>"


def defined(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(folder, name, description, schema, doc) of the functions that files define, one a folder that isn't private.

    Name and description are those of the front matter, else the folder's name
    and the first 80 characters of the body; schema is JSON, by default one text.
    A file without front matter or body defines nothing.
    """
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    rows = files.select(folder.alias("folder"), F.col(text).alias("_text")).where((folder != "") & ~folder.startswith("_"))
    rows = rows.select("folder", front_matter(F.col("_text")).alias("_f")).where(F.col("_f.body") != "")
    field = lambda k: F.get_json_object("_f.fields", f"$.{k}")
    name, said = F.coalesce(field("name"), F.col("folder")), F.nullif(field("description"), F.lit(""))
    return rows.select("folder", name.alias("name"), F.coalesce(said, F.substring("_f.body", 1, 80)).alias("description"), F.coalesce(field("schema"), F.lit(DEFAULT_SCHEMA)).alias("schema"), F.col("_f.body").alias("doc"))


def offered(functions: DataFrame) -> DataFrame:
    """(name, description, required) as a model sees them: the description cut to 500 characters, required null if nothing is."""
    said = F.concat(F.lit("[ONE-TIME] Load instructions for '"), "name", F.lit("' skill. Call ONCE, then follow the instructions — do NOT call again. "), "description")
    needed = F.from_json("schema", SCHEMA)["required"]
    return functions.select(F.concat(F.lit("skill_"), "name").alias("name"), F.substring(said, 1, 500).alias("description"), F.when(F.size(needed) > 0, needed).alias("required"))


def dependencies(doc: Column) -> Column:
    """The commands of the bullets below the heading Dependencies: in backquotes, else up to the first dash between blanks."""
    part = F.regexp_extract(doc, r"(?ms)^##\s+Dependenc(?:ies|ias)\s*\n(.*?)(?=\n##\s|\z)", 1)
    lines = F.transform(F.filter(F.transform(F.split(part, "\n"), F.trim), lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, 3, 10_000)))
    command = F.transform(lines, lambda x: F.when(x.rlike("^`[^`]+`"), F.regexp_extract(x, "^`([^`]+)`", 1)).otherwise(F.trim(F.regexp_replace(x, "(?s) [-–—] .*$", ""))))
    return F.filter(command, lambda x: x != "")


def creations(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests, (name, content, replace), with error: null, or why the function isn't made."""
    there = existing.select(F.col("folder").alias("name"), F.lit(True).alias("_there")).distinct()
    rows = requests.withColumn("_f", front_matter(F.col("content"))).join(there, "name", "left")
    own = F.coalesce(F.get_json_object("_f.fields", "$.name"), F.lit(""))
    error = (
        F.when(F.coalesce("name", F.lit("")) == "", "a name is required")
        .when(~F.col("name").rlike(NAME), "the name has other characters than letters, digits, _ and -")
        .when(F.col("_f.body").isNull(), "the content has no front matter")
        .when((own != "") & (own != F.col("name")), "the front matter has another name")
        .when(F.col("_there").isNotNull() & ~F.coalesce("replace", F.lit(False)), "the function exists")
    )
    return rows.select(*requests.columns, error.alias("error"))


def _fits(kind: Column, value_type: Column) -> Column:
    """Whether a JSON value's type is of a schema's kind; a kind that isn't known fits all."""
    whole = value_type.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    number = whole | value_type.rlike("^(DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(kind == "string", value_type == "STRING")
        .when(kind == "integer", whole)
        .when(kind == "number", number)
        .when(kind == "boolean", value_type == "BOOLEAN")
        .when(kind == "array", value_type.startswith("ARRAY"))
        .when(kind == "object", value_type.startswith("OBJECT"))
        .when(kind == "null", value_type == "VOID")
        .otherwise(F.lit(True))
    )


def checked(calls: DataFrame, functions: DataFrame, key: str = "id") -> DataFrame:
    """(key, name, errors) of calls, (key, name, arguments as JSON): what is wrong by the function's schema, sorted; empty if nothing.

    The errors are `no such function`, `not an object`, `missing: x`,
    `unknown: x`, `not a string: x` (or another kind) and `not one of its
    values: x`. No arguments count as an empty object. A key names one call; of
    functions with one name, one holds.
    """
    spark = calls.sparkSession
    specs = functions.groupBy("name").agg(F.first("schema").alias("_s")).select("name", F.from_json("_s", SCHEMA).alias("_spec"))
    given = F.nullif(F.trim(F.coalesce("arguments", F.lit(""))), F.lit(""))
    rows = calls.select(key, "name", F.try_parse_json(F.coalesce(given, F.lit("{}"))).alias("_v")).join(specs.withColumn("_known", F.lit(True)), "name", "left")
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("_object", is_object & F.col("_known").isNotNull())
    values = rows.where("_object").select(key, "_spec", "_v").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    values = values.select(key, F.col("key").alias("_field"), F.schema_of_variant("value").alias("_type"), F.try_variant_get("value", "$", "string").alias("_text"), F.try_element_at("_spec.properties", F.col("key")).alias("_p"))
    bad = F.when(F.col("_p").isNull(), F.concat(F.lit("unknown: "), "_field")).when(~_fits(F.col("_p.type"), F.col("_type")), F.concat(F.lit("not "), F.when(F.col("_p.type").rlike("^[aeiou]"), "an ").otherwise("a "), F.col("_p.type"), F.lit(": "), F.col("_field")))
    bad = bad.when(F.col("_p.enum").isNotNull() & ~F.coalesce(F.array_contains("_p.enum", F.col("_text")), F.lit(False)), F.concat(F.lit("not one of its values: "), "_field"))
    found = values.groupBy(key).agg(F.array_sort(F.collect_list(bad)).alias("_bad"), F.collect_list("_field").alias("_fields"))
    rows = rows.drop("_v").join(found, key, "left")
    none = F.array().cast("array<string>")
    missing = F.transform(F.array_except(F.coalesce("_spec.required", none), F.coalesce("_fields", none)), lambda x: F.concat(F.lit("missing: "), x))
    errors = F.when(F.col("_known").isNull(), F.array(F.lit("no such function"))).when(~F.col("_object"), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, F.coalesce("_bad", none))))
    return rows.select(key, "name", errors.alias("errors"))
