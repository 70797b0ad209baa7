"""Files as tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def text_files(spark: SparkSession, root: str, glob: str = "*", skip_dirs: tuple[str, ...] = (), skip_names: tuple[str, ...] = (), extensions: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to root), length, modified, sha1 of the content as a version-control blob, text of the files below root; bytes that are no UTF-8 become U+FFFD.

    Skips act on parts of the relative path; with extensions only files that end in one of them, in whatever case. Files that cannot be read are passed over.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    base = root.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    path = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})") if "'" not in base else F.substring_index("path", f"{base}/", -1)
    rows = found.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    parts = F.split("path", "/")
    if skip_dirs:
        rows = rows.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skip_dirs))))
    if skip_names:
        rows = rows.where(~F.element_at(parts, -1).isin(*skip_names))
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*(x.lower() for x in extensions)))
    blob = F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length("content").cast("string")).cast("binary"), F.unhex(F.lit("00")), F.col("content")))
    return rows.select("path", "length", "modified", blob.alias("sha1"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def land_bundles(files: DataFrame, root: str, folder: str, most: int = 50_000) -> None:
    """files: path (relative to the folder that the column `folder` names), text; lands them below root as bundles of many files, `most` at most, a file a line of JSON. Their number grows with the tasks and not with the files."""
    files.select(folder, "path", "text").write.partitionBy(folder).option("maxRecordsPerFile", most).option("ignoreNullFields", False).json(root)


def bundled_files(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """path (with its folder before it), text of the files in all bundles below root; a bundle that is no JSON stops the run."""
    found = spark.read.schema(f"path string, text string, {folder} string").option("mode", "FAILFAST").json(root)
    return found.select(F.concat_ws("/", folder, "path").alias("path"), "text")


def newest(listed: DataFrame, pattern: str) -> DataFrame:
    """The one path that matches a regular expression and was modified last, ties to the greater path; no row if none does."""
    return listed.where(F.col("path").rlike(pattern)).agg(F.max_by("path", F.struct("modified", "path")).alias("path")).where("path is not null")


def tolerant_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines) of JSON lines; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("value", "r.*")
    return parsed.where("_corrupt is null").drop("_corrupt", "value"), parsed.where("_corrupt is not null").select(F.col("value").alias("_corrupt"))


def next_run(names: DataFrame, column: str, pattern: str) -> DataFrame:
    """The next number of run folders, compared as numbers."""
    return names.agg((F.coalesce(F.max(F.expr(f"try_cast(regexp_extract({column}, '{pattern}', 1) as int)")), F.lit(0)) + 1).alias("next"))
