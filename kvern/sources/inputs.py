"""Lists of organisation numbers in any of the usual file forms.

Files are read by line, so a large list is split like any text.  Each file's first
line that isn't blank tells its form: rows with a separator and perhaps a header, or
lines of JSON or plain numbers.  Only a JSON document that spans several lines is taken
whole, as one value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.functions.identifiers import is_org_number, org_number

#: Names that a column or key with the number may have, and keys of a list of inputs.
NAMES = ("organisation_number", "organization_number", "organisasjonsnummer", "orgnr", "org_nr", "orgnummer", "org")
LISTS = ("organisation_numbers", "companies", "organisations", "inputs")
HEADER = r"^(?i)\s*(organi[sz]ation[ _-]?(number|no|nr)|organisasjonsnummer|org[ _.-]?(nr|nummer|number|no)?)\s*$"
SEPARATORS = ("\t", ";", ",")


def _json_entry(item: Column) -> Column:
    """The number in a JSON value's text: of an object by the first name it has, else the value itself; empty where there is none."""
    members = F.map_entries(F.from_json(item, "map<string,string>"))
    named = [F.get(F.filter(members, _is_member(n)), F.lit(0))["value"] for n in NAMES]
    plain = F.regexp_replace(item, r'^\s*"|"\s*$', "")
    return F.when(item.startswith("{"), F.coalesce(*named, F.lit(""))).otherwise(F.coalesce(plain, F.lit("null")))


def _is_member(name: str) -> Callable[[Column], Column]:
    return lambda e: (F.lower(e["key"]) == name) & (e["value"] != "")


def _json_items(text: Column) -> Column:
    """The JSON texts of what a document lists: an array's elements, those of an object's list of inputs, else the document."""
    listed = [F.from_json(F.get_json_object(text, f"$.{k}"), "array<string>") for k in LISTS]
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.coalesce(*listed, F.array(text))).otherwise(F.array(text))


def _is_json(text: Column) -> Column:
    return text.rlike(r'^[\[{"]') & F.try_parse_json(text).isNotNull()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, place, line)`` of lines that aren't blank; ``(block, place)`` is their order in the file."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    bare = read.withColumn("line", F.trim(F.regexp_replace("line", "[\ufeff\r]", "")))
    return bare.where("line <> ''")


def _forms(lines: DataFrame) -> DataFrame:
    """``(file, first_block, first_place, separator, column, whole)``, a row per file: its form, by the first line."""
    first = lines.groupBy("file").agg(F.min(F.struct("block", "place", "line")).alias("f"), F.count("*").alias("n"))
    line = F.col("f.line")
    several = lambda s: F.size(F.split(line, s))
    separator = F.when(F.contains(line, F.lit("\t")), "\t").when(several(";") > several(","), ";").otherwise(",")
    cells = reduce(lambda c, s: F.when(F.col("separator") == s, F.split(line, s)).otherwise(c), SEPARATORS, F.split(line, ","))
    heads = F.transform(cells, lambda c: F.regexp_replace(c, '^\\s*"|"\\s*$', "").rlike(HEADER))
    column = F.when(~line.rlike(r"^[\[{]"), F.array_position(heads, True) - 1)
    whole = line.rlike(r"^[\[{]") & (F.col("n") > 1) & ~_is_json(line)
    formed = first.withColumn("separator", separator).withColumn("column", F.when(column >= 0, column.cast("int"))).withColumn("whole", whole)
    return formed.select("file", F.col("f.block").alias("first_block"), F.col("f.place").alias("first_place"), "separator", "column", "whole")


def _cells(line: Column, separator: str) -> Column:
    """A row's cells: quoted ones without their quotes, a separator inside quotes being none."""
    quoted = rf'\s*"((?:[^"]|"")*)"\s*(?:{separator}|$)'
    found = F.regexp_extract_all(line, F.lit(rf'(?:{quoted}|([^{separator}]*)(?:{separator}|$))'), F.lit(0))
    return F.transform(found, lambda c: F.replace(F.regexp_replace(F.regexp_replace(c, rf"{separator}$", ""), r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, entry, org, valid)``: every entry of every file; one that is no valid number stays, with ``org`` as written.

    ``position`` counts a file's entries from 0.  A row without the number's column
    gives its first cell.  A line that should be JSON and isn't stands for itself.  Blank
    lines and empty files give none.
    """
    lines = _lines(spark, path)
    formed = lines.join(_forms(lines), "file")  # a row per file on the other side
    header = F.col("column").isNotNull() & (F.col("block") == F.col("first_block")) & (F.col("place") == F.col("first_place"))
    apart = formed.where(~header & ~F.col("whole"))
    line = F.col("line")
    cells = reduce(lambda c, s: F.when(F.col("separator") == s, _cells(line, s)).otherwise(c), SEPARATORS[:2], _cells(line, ","))
    wanted = F.coalesce(F.get(cells, F.coalesce("column", F.lit(0))), F.get(cells, F.lit(0)), line)
    as_json = F.col("column").isNull() & _is_json(line)
    items = F.when(as_json, F.transform(_json_items(line), _json_entry)).otherwise(F.array(F.trim(wanted)))
    rows = apart.select("file", "block", "place", F.posexplode(items).alias("item", "entry"))

    # documents over several lines; one that is none after all is taken by its lines
    texts = formed.where("whole").select("file").distinct()
    bodies = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim(F.regexp_replace("value", "[\ufeff\r]", "")).alias("body"))
    bodies = bodies.join(F.broadcast(texts), "file", "left_semi") if not texts.isEmpty() else None
    if bodies is not None:
        sound = F.try_parse_json("body").isNotNull()
        document = bodies.where(sound).select("file", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("place"), F.posexplode(F.transform(_json_items(F.col("body")), _json_entry)).alias("item", "entry"))
        broken = formed.where("whole").join(bodies.where(~sound).select("file"), "file", "left_semi")
        rows = rows.unionByName(document).unionByName(broken.select("file", "block", "place", F.lit(0).alias("item"), F.trim("line").alias("entry")))

    # positions: entries of the blocks before, and the place inside the block, so that no file is one task
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "block", before.alias("offset"))
    placed = rows.withColumn("inside", F.row_number().over(Window.partitionBy("file", "block").orderBy("place", "item")) - 1)
    numbered = placed.join(offsets, ["file", "block"]).select("file", (F.col("offset") + F.col("inside")).alias("position"), "entry")
    return numbered.withColumn("valid", is_org_number(F.col("entry"))).withColumn("org", F.coalesce(org_number(F.col("entry")), "entry"))


def once_each(entries: DataFrame) -> DataFrame:
    """``(org)``: what has to be worked on."""
    return entries.select("org").distinct()


def back_to_entries(entries: DataFrame, results: DataFrame) -> DataFrame:
    """A result for every entry, repeated ones included; entries without a result keep nulls."""
    return entries.join(results, "org", "left")
