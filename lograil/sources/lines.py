"""Text lines with their physical line numbers, read in parallel."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograil.functions.once import computed_once


def numbered(lines: DataFrame) -> DataFrame:
    """Line numbers for (line, file_name, block, at): splits are numbered on their own and
    offset by those before. Only one row per file split takes part in the offsets."""
    blocks = lines.groupBy("file_name", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("at") - F.col("first") + F.col("offset")
    return lines.join(offsets, ["file_name", "block"]).select(
        "file_name", (place + 1).alias("row_number"),
        F.when(place == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")).alias("line"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file_name, block, at) of text files: `at` orders the lines of a file split, `block` the splits."""
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, row_number, line) of text files."""
    return numbered(placed_lines(spark, path))


# A cell is quoted, with quotes doubled inside, or does not begin with a quote.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|(?:[^",][^,]*+)?)'
UNCLOSED = "a quoted CSV cell is not closed, or text follows its closing quote"
MISFIT = "the CSV record has another number of cells than its header"
LIMIT = 64 << 10
TOO_LONG = f"a CSV record over several lines exceeds {LIMIT >> 10} KiB"

# How a line goes on: what it leaves open when it begins between cells, and when it begins inside a quoted one.
_OPENED = r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?:[^",][^,]*+)?),)*+"[^"]*+(?:""[^"]*+)*+$'
_GOES_ON = r'^[^"]*+(?:""[^"]*+)*+'


def _opens(line: Column) -> tuple[Column, Column]:
    """Whether a quoted cell is open at the line's end: if none was open at its beginning, and if one was."""
    quoted = line.contains('"')
    return (quoted & line.rlike("^" + _OPENED),
            ~quoted | line.rlike(_GOES_ON + "$") | line.rlike(_GOES_ON + '"[^,]*+,' + _OPENED))


def _open_before(first: Column, fixed: Column, flips: Column) -> Column:
    """State behind lines of which `fixed` (value, flips) is the last that does not depend on what came before."""
    return F.when(fixed.isNotNull(), F.pmod(fixed["value"] + flips - fixed["flips"], F.lit(2))).otherwise(F.pmod(first + flips, F.lit(2)))


def csv_records(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(file_name, row_number, line, too_long): CSV records of (line, file_name, block, at), quoted line breaks in them.

    A record over several lines has the number of its last line; its breaks are single newlines. A line
    turns the state "inside a quoted cell" into the same, the opposite or a fixed one. Such turns are
    composed inside each file split, then over splits, where a split is one row; so a file is
    read in parallel and a record may lie over any number of splits. Of a record longer than
    `limit` bytes only the first lines are gathered, and it is marked.
    """
    lines = lines.withColumn("line", F.when(F.col("block") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
    alone, inside = _opens(F.col("line"))
    turned = computed_once(lines, {"alone": alone.cast("int"), "inside": inside.cast("int")})
    if turned.where("alone = 1").isEmpty():
        # No cell is ever open at a line's end: every line is a record.
        return numbered(lines).withColumn("too_long", F.lit(False))
    split = Window.partitionBy("file_name", "block").orderBy("at")
    until, before = split.rowsBetween(Window.unboundedPreceding, 0), split.rowsBetween(Window.unboundedPreceding, -1)
    rows = (turned.withColumn("bytes", F.octet_length("line") + 1)
            .withColumn("flips", F.sum(F.when(F.col("alone") > F.col("inside"), 1).otherwise(0)).over(until))
            .withColumn("place", F.row_number().over(split)).withColumn("upto", F.sum("bytes").over(until))
            .withColumn("fixed", F.when(F.col("alone") == F.col("inside"), F.struct("place", F.col("alone").alias("value"), "flips"))))
    # One row for each split: how it turns the state, how many lines and bytes it has.
    by_file = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (rows.groupBy("file_name", "block").agg(F.max("flips").alias("n"), F.max("fixed").alias("last"), F.max("place").alias("lines"), F.max("upto").alias("size"))
              .withColumn("odd", F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("known", F.when(F.col("last").isNotNull(), F.struct("block", F.pmod(F.col("last.value") + F.col("n") - F.col("last.flips"), F.lit(2)).alias("value"),
                                                                               F.col("odd").alias("flips")))))
    none = F.lit(0)
    splits = splits.select("file_name", "block", F.coalesce(F.sum("lines").over(by_file), none).alias("lines_before"), F.coalesce(F.sum("size").over(by_file), none).alias("bytes_before"),
                           _open_before(none, F.max("known").over(by_file), F.coalesce(F.sum("n").over(by_file), none)).alias("first"))
    placed = (rows.join(splits, ["file_name", "block"])
              .withColumn("open", _open_before(F.col("first"), F.max("fixed").over(before), F.coalesce(F.max("flips").over(before), none)))
              .withColumn("upto", F.col("upto") + F.col("bytes_before")).withColumn("row_number", F.col("place") + F.col("lines_before"))
              .withColumn("start", F.when(F.col("open") == 0, F.struct("block", "at", (F.col("upto") - F.col("bytes")).alias("from"))))
              .withColumn("single", F.coalesce((F.col("open") == 0) & (F.lead("open").over(split) == 0), F.lit(False))))
    single = placed.where("single").select("file_name", "row_number", "line", F.lit(False).alias("too_long"))
    # A record that began in an earlier split belongs to the last beginning there.
    carried = (placed.groupBy("file_name", "block").agg(F.max("start").alias("latest"))
               .select("file_name", "block", F.max("latest").over(by_file).alias("earlier")))
    owned = (placed.withColumn("start", F.max("start").over(until)).where("not single").join(carried, ["file_name", "block"])
             .withColumn("start", F.coalesce("start", "earlier")).withColumn("fits", F.col("upto") - F.col("start.from") <= limit + 1))
    parts = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("block", "at", "line"))))
    gathered = (owned.groupBy("file_name", F.col("start.block").alias("b"), F.col("start.at").alias("a"))
                .agg(parts.alias("parts"), F.max("row_number").alias("row_number"), F.min("fits").alias("fits"), F.count("*").alias("lines"), F.max(F.when(F.col("open") == 0, F.col("line"))).alias("first")))
    return single.unionByName(gathered.select(
        "file_name", "row_number", F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).otherwise(F.col("first")).alias("line"),
        (~F.col("fits") & (F.col("lines") > 1)).alias("too_long")))


def cells_of(line: str | Column) -> Column:
    """The cells of a CSV line, quotes taken off; null if a quote is unclosed or stray."""
    joined = F.concat(F.lit(","), line)
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    cells = F.transform(F.regexp_extract_all(joined, F.lit(f",({_CELL})"), F.lit(1)),
                        lambda c: F.when(F.startswith(c, F.lit('"')), inner(c)).otherwise(c))
    return F.when(joined.rlike(f"^(?:,{_CELL})++$"), cells)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, names) of every file: the cells of its own first line."""
    first = placed_lines(spark, path).where("block = 0").groupBy("file_name").agg(F.min_by("line", "at").alias("line"))
    return first.select("file_name", cells_of(F.regexp_replace("line", "^\ufeff", "")).alias("names"))


def check_headers(names: DataFrame, problem: Column, message: str) -> None:
    """Raises when some file's header has the problem."""
    found = names.where(F.coalesce(problem, F.lit(True))).take(1)
    if found:
        raise ValueError(f"{message}: {found[0].file_name}")


def csv_cells(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Records (file_name, row_number, line, perhaps too_long) with `cells`, a map from the names of their own file's
    header, and `read_error` where the line is no CSV or does not fit that header."""
    too_long = F.col("too_long") if "too_long" in lines.columns else F.lit(False)
    parsed = computed_once(lines.where((F.col("row_number") > 1) & (F.trim("line") != "")), {"values": F.when(~too_long, cells_of("line")), "too_long": too_long})
    joined = parsed.join(names, "file_name")
    fits = F.size("values") == F.size("names")
    error = F.when(F.col("too_long"), TOO_LONG).when(F.col("values").isNull(), UNCLOSED).when(~fits, MISFIT)
    return (joined.withColumn("cells", F.when(fits, F.map_from_arrays("names", "values")))
            .withColumn("read_error", error).drop("values", "names", "too_long"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all files under `path`, each read by its own header.

    Columns are file_name, row_number (of the record's last line), line, cells and read_error. Quoted cells
    may hold line breaks; a quote that is never closed takes the lines behind it into its record.
    """
    names = headers(spark, path)
    unique = (F.size(F.array_distinct("names")) == F.size("names")) & ~F.array_contains("names", "")
    check_headers(names, ~unique, "CSV headers must be unique and nonempty")
    return csv_cells(csv_records(placed_lines(spark, path)), names)


def cell(name: str) -> Column:
    """A cell by name; null where it is empty or its file has no such column."""
    value = F.element_at("cells", F.lit(name))
    return F.when(value != "", value)


def typed(variant: str, path: str):
    """Type name of a JSON member, null when absent."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def text(variant: str, path: str):
    return F.try_variant_get(variant, path, "string")
