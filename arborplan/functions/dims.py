"""Fixed dimensions: bookkeeping names of operating systems, and the category of an extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are metadata, in lower case. A name that begins with "._" is metadata too.
METADATA_NAMES = [
    ".appledouble", ".apdisk", ".documentrevisions-v100", ".ds_store", ".fseventsd", ".localized", ".spotlight-v100", ".temporaryitems", ".trash",
    ".trash-1000", ".trashes", ".vol", "$recycle.bin", "desktop.ini", "ehthumbs.db", "recycler", "system volume information", "thumbs.db",
]

# Extensions of each category.
CATEGORIES = {
    "Archives": "7z bz2 deb dmg gz iso pkg rar rpm tar tar.bz2 tar.gz tar.lz4 tar.xz tar.zst tgz xz zip zst",
    "Audio": "aac aif aiff alac flac m4a mid midi mp3 oga ogg opus wav wma",
    "Code": "bash bat c cc cjs clj cpp cs css dockerfile el fish go graphql h hpp hs htm html ipynb java js json jsonc jsx kt less lua makefile mjs php pl proto ps1 py r rb rs sass scala scss sh sql swift toml ts tsx vim xml yaml yml zsh",
    "Documents": "azw3 djvu doc docx epub log markdown md mobi odt pages pdf rst rtf tex txt",
    "Fonts": "eot otf ttf woff woff2",
    "Images": "ai arw avif bmp cr2 cr3 dng eps gif heic heif ico jpeg jpg nef orf png psd raw rw2 svg tif tiff webp",
    "Presentations": "key odp ppt pptx",
    "Spreadsheets": "csv numbers ods tsv xls xlsm xlsx",
    "Video": "3gp avi flv m2ts m4v mkv mov mp4 mpeg mpg mts webm wmv",
}
OTHER = "Other"
NO_EXTENSION = "no-extension"
COMPOUND = ["tar.gz", "tar.bz2", "tar.xz", "tar.zst", "tar.lz4"]


def category_table(spark: SparkSession) -> DataFrame:
    """(ext, category): the fixed table turned over; its size is fixed, so it may be broadcast."""
    rows = spark.createDataFrame([(c, e.split()) for c, e in CATEGORIES.items()], "category string, exts array<string>")
    return rows.select(F.explode("exts").alias("ext"), "category")


def with_category(df: DataFrame, ext: str = "ext") -> DataFrame:
    dim = F.broadcast(category_table(df.sparkSession).withColumnRenamed("ext", "__ext"))
    return df.join(dim, F.col(ext) == F.col("__ext"), "left").drop("__ext").withColumn("category", F.coalesce("category", F.lit(OTHER)))


def is_metadata(name: Column) -> Column:
    low = F.lower(name)
    return low.startswith("._") | low.isin(METADATA_NAMES)
