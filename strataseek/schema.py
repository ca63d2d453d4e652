"""Schemas of the tables that the engine reads and writes.

``file_ord`` is a row's place in its scan; every sort ends with it, because sorts are stable.
"""

from pyspark.sql import types as T

#: Attribute flags in the order of their display, with their bits. Fixed values.
ATTRIBUTE_BITS = {
    "read_only": 1,
    "hidden": 2,
    "system": 4,
    "directory": 16,
    "archive": 32,
    "device": 64,
    "normal": 128,
    "temporary": 256,
    "sparse_file": 512,
    "reparse_point": 1024,
    "compressed": 2048,
    "offline": 4096,
    "not_content_indexed": 8192,
    "encrypted": 16384,
}

ATTRIBUTES = T.StructType([T.StructField(n, T.BooleanType()) for n in ATTRIBUTE_BITS])

FILE_ENTRY = T.StructType(
    [
        T.StructField("file_ord", T.LongType()),
        T.StructField("full_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("date_created", T.TimestampType()),
        T.StructField("date_modified", T.TimestampType()),
        T.StructField("date_accessed", T.TimestampType()),
        T.StructField("date_recently_changed", T.TimestampType()),
        T.StructField("attributes", ATTRIBUTES),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("file_list_filename", T.StringType()),
        T.StructField("run_count", T.LongType()),
        T.StructField("date_run", T.TimestampType()),
    ]
)

DOC_META = T.StructType(
    [
        T.StructField("file_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("file_size", T.LongType()),
    ]
)

DOC_PAGE = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("location", T.LongType()), T.StructField("body", T.StringType())])

FILE_LIST = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "size", "date_created", "date_modified", "date_accessed", "attributes")])

WATCH_EVENT = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())])
