"""Reading folders of files, catalog differences, sidecars, and exports."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as an image, and folders that are never entered.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "tif", "tiff", "bmp")
SKIPPED_SUFFIXES = (".app", ".photoslibrary")
SKIPPED_NAMES = ("appdata", "node_modules", "bower_components", "__pycache__", "__macosx", "site-packages", "steamapps", "system volume information")
SKIPPED_ON_DRIVES = ("windows", "program files", "program files (x86)", "programdata", "recovery", "perflogs", "msocache", "windows.old")
MAX_SIDECAR_BYTES = 64_000
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def plain(path: str) -> str:
    return re.sub("^file:/+", "/", path.replace("\\", "/")).rstrip("/")


def _plain(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^file:/+", "/")


def is_image(name: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*extensions)


def below(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root + "/")


def skipped(path: Column, root: str, names: tuple[str, ...] = ()) -> Column:
    """True if the file is not below the root, or a folder between them is never entered.

    Such folders are hidden ones, bundles, the fixed names and those given, and right under a drive
    the system's own.
    """
    inner = F.split(F.lower(F.substr(path, F.lit(len(root) + 2), F.length(path))), "/")
    folders = F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0)))
    ending = lambda s: reduce(Column.__or__, [s.endswith(x) for x in SKIPPED_SUFFIXES])
    bad = lambda s: s.startswith(".") | s.startswith("$") | ending(s) | s.isin(*SKIPPED_NAMES, *(n.lower() for n in names))
    out = ~below(path, root) | F.exists(folders, bad)
    out = out | path.rlike("^/Users/[^/]+/Library/")  # a home folder's own, on macOS
    if re.fullmatch("|[A-Za-z]:", root):
        out = out | F.coalesce(F.get(folders, F.lit(0)).isin(*SKIPPED_ON_DRIVES), F.lit(False))
    return out


def root_of(path: Column, roots: list[str], excluded: list[str]) -> Column:
    """The longest root that the path is under; null under an excluded folder."""
    longest = sorted(roots, key=len, reverse=True)
    found = F.coalesce(*(F.when(below(path, r), r) for r in longest)) if roots else F.lit(None).cast("string")
    return reduce(lambda c, e: F.when(below(path, e), F.lit(None)).otherwise(c), excluded, found)


def located(files: DataFrame, roots: list[str], excluded: list[str] = (), skip_names: tuple[str, ...] = ()) -> DataFrame:
    """(path, folder, name, mtime, size) of image files below the roots, from rows of a file listing."""
    roots, excluded = sorted({plain(r) for r in roots}), [plain(e) for e in excluded]
    path = _plain(F.col("path"))
    rows = files.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    rows = rows.withColumns({"name": F.regexp_extract("path", r"[^/]*$", 0), "folder": root_of(F.col("path"), roots, excluded)})
    kept = reduce(Column.__or__, [(F.col("folder") == r) & ~skipped(F.col("path"), r, skip_names) for r in roots], F.lit(False))
    return rows.filter(is_image(F.col("name")) & F.col("folder").isNotNull() & kept).select("path", "folder", "name", "mtime", "size")


def scan(spark: SparkSession, roots: list[str], excluded: list[str] = (), skip_names: tuple[str, ...] = ()) -> DataFrame:
    """The image files below the roots. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sorted(set(roots))).select("path", "modificationTime", "length")
    return located(files, roots, excluded, skip_names)


def scan_roots(spark: SparkSession, roots: list[str], excluded: list[str] = (), skip_names: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The image files below those roots that can be listed to the end, and these roots."""
    found, complete = [], []
    for root in sorted(set(roots)):
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
            files.limit(1).count()
        except (PySparkException, Py4JError):  # a root that is gone or can't be read
            continue
        found.append(files)
        complete.append(root)
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "path string, modificationTime timestamp, length long")
    return located(every, roots, excluded, skip_names), complete


def everywhere(spark: SparkSession, home: str, drives: list[str] = ()) -> list[str]:
    """The roots of the scope "everywhere": the fixed drives that are there, or the home folder."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    there = [d for d in sorted(set(drives)) if Path(d).getFileSystem(spark._jsc.hadoopConfiguration()).exists(Path(d))]
    return there or [home]


def images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, width, height, channels, data) of images that the JVM can decode and that are not too large."""
    rows = spark.read.format("image").option("dropInvalid", True).load(paths).select("image.*")
    fits = F.col("width").cast("long") * F.col("height") * 4 <= 200 << 20
    return rows.filter(fits).select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, ok) of files (path, content) against their SHA-256 (name, sha256) by file name."""
    named = files.select("path", F.sha2("content", 256).alias("found"), F.regexp_extract(_plain(F.col("path")), r"[^/]*$", 0).alias("name"))
    return named.join(expected, "name").select("path", (F.col("found") == F.lower("sha256")).alias("ok"))


def catalog_diff(found: DataFrame, catalog: DataFrame, roots: list[str], complete: list[str], excluded: list[str] = ()) -> DataFrame:
    """(path, id, change, folder, name, mtime, size): new, changed, gone, kept or same.

    A row that was not found is gone only if its root was listed to the end, or it is excluded or
    under no root any more; else it is kept.
    """
    known = catalog.select("id", "path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("folder").alias("old_folder"))
    both = found.join(known, "path", "full_outer")
    under = lambda folders: reduce(Column.__or__, [below(F.col("path"), plain(f)) for f in folders], F.lit(False))
    gone = under(excluded) | ~under(roots) | under(complete)
    change = (
        F.when(F.col("id").isNull(), "new")
        .when(F.col("mtime").isNull() & gone, "gone")
        .when(F.col("mtime").isNull(), "kept")
        .when((F.col("mtime") != F.col("old_mtime")) | (F.col("size") != F.col("old_size")), "changed")
        .otherwise("same")
    )
    old = lambda c: F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c)
    return both.select("path", "id", change.alias("change"), old("folder"), F.coalesce("name", F.regexp_extract("path", r"[^/]*$", 0)).alias("name"), old("mtime"), old("size"))


def apply_diff(catalog: DataFrame, diff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, ids to read again): changed rows keep what was read of them; new ones get the next ids."""
    from sparkseek.operators.ordering import with_rank
    from sparkseek.schema import conform

    gone = diff.filter("change = 'gone'").select("id")
    changed = diff.filter("change = 'changed'").select("id", *(F.col(c).alias(f"new_{c}") for c in ("mtime", "size", "folder")))
    kept = catalog.join(gone, "id", "left_anti").join(changed, "id", "left")
    renewed = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in ("mtime", "size", "folder")}
    kept = kept.withColumns(renewed | {"error": F.when(F.col("new_mtime").isNull(), F.col("error"))}).select(*catalog.columns)
    start = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = diff.filter("change = 'new'").select("path", "folder", "name", "mtime", "size")
    new = with_rank(new, [F.asc("path")], "id").withColumn("id", F.col("id") + start)
    return kept.unionByName(conform(new).select(*kept.columns), allowMissingColumns=True), changed.select("id")


def insert_or_ignore(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog with those rows whose path it lacks, one of each path."""
    new = rows.dropDuplicates(["path"]).join(catalog.select("path"), "path", "left_anti")
    return catalog.unionByName(new.select(*catalog.columns))


def import_sidecars(catalog: DataFrame, sidecars: DataFrame, suffix: str) -> DataFrame:
    """The catalog with source_url and note from ``<stem>.<suffix>.json`` files beside the items, where these are empty.

    sidecars holds rows (path, length, content). A sidecar counts if it is small enough, of
    version 1, names the item's file, and has an address that may be stored.
    """
    body = F.from_json(F.col("content").cast("string"), "version int, imageName string, sourceUrl string, title string")
    path = _plain(F.col("path"))
    read = sidecars.filter(F.col("length") <= MAX_SIDECAR_BYTES).filter(path.endswith(f".{suffix}.json")).select(F.regexp_replace(path, re.escape(f".{suffix}.json") + "$", "").alias("stem"), body.alias("b"))
    url = F.trim("b.sourceUrl")
    storable = (F.octet_length(url) <= 8192) & url.rlike(r"^(?i:https?)://[^/?#@\s]+([/?#]|$)")
    read = read.filter((F.col("b.version") == 1) & storable & F.col("b.title").isNotNull())
    read = read.select("stem", F.col("b.imageName").alias("name"), url.alias("new_url"), F.concat(F.lit("Captured page: "), "b.title").alias("new_note")).dropDuplicates(["stem", "name"])
    rows = catalog.withColumn("stem", F.regexp_replace(_plain(F.col("path")), r"\.[^./]*$", "")).join(read, ["stem", "name"], "left")
    fill = lambda old, new: F.when((F.coalesce(F.col(old), F.lit("")) == "") & F.col(new).isNotNull(), F.col(new)).otherwise(F.col(old))
    return rows.withColumns({"source_url": fill("source_url", "new_url"), "note": fill("note", "new_note")}).select(*catalog.columns)


def folder_suggestions(files: DataFrame, folders: list[str], most: int = 100_000) -> DataFrame:
    """(folder, images) of known folders that hold images, counted up to a bound; folders that differ in case only are one."""
    once = list({plain(f).lower(): plain(f) for f in reversed(folders)}.values())
    path = _plain(F.col("path"))
    holding = F.filter(F.array(*(F.when(below(path, f), f) for f in once)), lambda f: f.isNotNull())
    rows = files.filter(is_image(path)).select(F.explode(holding).alias("folder"))
    return rows.groupBy("folder").agg(F.least(F.count("*"), F.lit(most)).alias("images")).filter("images > 0").orderBy("folder")


def export_manifest(catalog: DataFrame, ids: list[int]) -> DataFrame:
    """(id, path, file, metadata, pinned) of up to 5000 shown items to export, each under a name of its own."""
    wanted = sorted(set(ids))
    if not 1 <= len(wanted) <= 5000:
        raise ValueError("export takes 1 to 5000 items")
    rows = catalog.filter(~F.col("hidden") & F.col("id").isin(wanted))
    metadata = F.struct("note", F.col("user_tags").alias("tags"), "collections", F.col("source_url").alias("sourceUrl"))
    return rows.select("id", "path", F.concat_ws("-", F.col("id").cast("string"), F.col("name")).alias("file"), metadata.alias("metadata"), "pinned").orderBy("id")


def export(catalog: DataFrame, ids: list[int], folder: str) -> DataFrame:
    """Copies the originals to a new folder and writes the manifest; gives (id, ok) of every file.

    All goes through Hadoop's file systems, so either side may be local or shared. There are 5000
    files at most; what was copied before a failure stays and is in the manifest.
    """
    import json
    from concurrent.futures import ThreadPoolExecutor

    spark = catalog.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = place(folder).getFileSystem(conf)
    if store.exists(place(folder)):
        raise FileExistsError(folder)
    store.mkdirs(place(folder))
    rows = export_manifest(catalog, ids).collect()

    def copy(row) -> bool:
        try:
            source, target = place(row["path"]), place(f"{folder}/{row['file']}")
            return jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, store, target, False, conf)
        except Py4JError:
            return False

    with ThreadPoolExecutor(8) as pool:
        copied = list(pool.map(copy, rows))
    images = [{"file": r["file"], "metadata": r["metadata"].asDict(), "pinned": r["pinned"]} for r, ok in zip(rows, copied) if ok]
    out = store.create(place(f"{folder}/manifest.json"), False)
    out.write(json.dumps({"version": 1, "images": images}, ensure_ascii=False).encode())
    out.close()
    return spark.createDataFrame([(r["id"], ok) for r, ok in zip(rows, copied)], "id long, ok boolean")
