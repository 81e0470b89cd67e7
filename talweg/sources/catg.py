"""Reader of RORB ``.catg`` node-link files.

Lines are numbered within their file, sections are cut out by line numbers, and each
record looks ahead to the two lines after it; all of it on DataFrame functions, file by
file, so a folder of files is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("pos", "line"))


def _section(lines: DataFrame, header: str) -> DataFrame:
    """Lines after the first one that holds the header, up to another ``C #`` line or the end of the graphical block; with pos."""
    upper = F.upper("line")
    has = upper.contains(header)
    start = F.min(F.when(has, F.col("pos"))).over(Window.partitionBy("file"))
    after = lines.withColumn("start", start).where("pos > start")
    stops = (F.col("line").startswith("C #") & ~has) | upper.startswith("C END RORB_GE")
    stop = F.min(F.when(stops, F.col("pos"))).over(Window.partitionBy("file"))
    return after.withColumn("stop", stop).where("stop is null or pos < stop").select("file", "pos", "line")


def _body(line: Column) -> Column:
    """A line without its leading C."""
    return F.trim(F.when(line.startswith("C"), F.substring(line, 2, 1 << 20)).otherwise(line))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _tokens(lines: DataFrame) -> DataFrame:
    body = _body(F.col("line"))
    return lines.withColumn("body", body).withColumn("t", F.split(body, r"\s+"))


def _is_id(text: Column) -> Column:
    return text.rlike(r"^[+-]*\d+$")


def _ref(text: Column) -> Column:
    return F.btrim(text, F.lit("<>"))


def read_nodes(lines: DataFrame) -> DataFrame:
    """(file, node_id, name, downstream, is_basin, is_outlet, area_km2, imperv_frac, print_code, x, y); of several records of a node the last counts."""
    rows = _tokens(_section(lines, "#NODES"))
    at = lambda i: F.try_element_at("t", F.lit(i))
    number = lambda i: F.coalesce(_number(at(i)), F.lit(0.0))
    whole = lambda i: number(i).cast("int")
    good = (F.size("t") >= 8) & ~F.col("body").startswith("#") & _is_id(at(1)) & _number(at(2)).isNotNull() & _number(at(3)).isNotNull()
    got = rows.where(good).select(
        "file", "pos", _ref(at(1)).alias("node_id"), at(8).alias("name"), _ref(at(7)).alias("downstream"), whole(5).alias("is_basin"), whole(6).alias("is_outlet"),
        number(9).alias("area_km2"), number(10).alias("imperv_frac"), whole(11).alias("print_code"), _number(at(2)).alias("x"), _number(at(3)).alias("y"),
    )
    last = F.row_number().over(Window.partitionBy("file", "node_id").orderBy(F.desc("pos")))
    return got.withColumn("k", last).where("k = 1").drop("k", "pos")


def read_reaches(lines: DataFrame) -> DataFrame:
    """(file, reach_id, name, us_node, ds_node, reach_type, length_km, slope, print_code, mid_x, mid_y). A record of eleven or more words whose second is no number has a name."""
    rows = _tokens(_section(lines, "#REACHES"))
    head = F.split(F.col("body"), r"\s+")[0]
    in_file = Window.partitionBy("file").orderBy("pos")
    rows = rows.withColumn("n1", F.lead(head, 1).over(in_file)).withColumn("n2", F.lead(head, 2).over(in_file))
    at = lambda i: F.try_element_at("t", F.lit(i))
    named = (F.size("t") >= 11) & _number(at(2)).isNull()
    pick = lambda i: F.when(named, at(i + 1)).otherwise(at(i))
    number = lambda i: F.coalesce(_number(pick(i)), F.lit(0.0))
    good = (F.size("t") >= 10) & _is_id(at(1))
    x = _number(F.col("n1"))
    # without a number on the next line, the one after is not looked at as x, but as y
    y = F.when(x.isNotNull(), _number(F.col("n2")))
    return rows.where(good).select(
        "file", _ref(at(1)).alias("reach_id"), F.when(named, at(2)).otherwise("").alias("name"), _ref(pick(2)).alias("us_node"), _ref(pick(3)).alias("ds_node"),
        number(5).cast("int").alias("reach_type"), number(7).alias("length_km"), number(8).alias("slope"), number(6).cast("int").alias("print_code"), x.alias("mid_x"), y.alias("mid_y"),
    )


def read_catg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and links with their line from node to middle to node; links to unknown nodes are left out."""
    return from_lines(read_lines(spark, path))


def from_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes, reaches = read_nodes(lines), read_reaches(lines)
    end = lambda k: nodes.select("file", F.col("node_id").alias(f"{k}_node"), F.struct("x", "y").alias(k))
    both = reaches.join(end("us"), ["file", "us_node"]).join(end("ds"), ["file", "ds_node"])
    middle = F.when(F.col("mid_x").isNotNull() & F.col("mid_y").isNotNull(), F.struct(F.col("mid_x").alias("x"), F.col("mid_y").alias("y")))
    raw = F.array_compact(F.array("us", middle, "ds"))
    line = F.transform(F.filter(F.sequence(F.lit(1), F.size(raw)), lambda i: (i == 1) | (F.element_at(raw, i) != F.element_at(raw, F.greatest(i - 1, F.lit(1))))), lambda i: F.element_at(raw, i))
    return nodes, both.select("file", "reach_id", "name", "us_node", "ds_node", "reach_type", "length_km", "slope", "print_code", line.alias("line")).where(F.size("line") > 1)
