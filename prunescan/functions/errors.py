"""Error codes as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Class of the code's upper half, then name and whether a retry helps, in the order of the codes from the given first one.
TYPES = {0: "USER_ERROR", 1: "INTERNAL_ERROR", 2: "INSUFFICIENT_RESOURCES", 3: "EXTERNAL"}
CODES = {
    0x00000001: (("INVALID_REQUEST", False), ("NOT_FOUND", False), ("PERMISSION_DENIED", False), ("NOT_SUPPORTED", False)),
    0x00010000: (
        ("GENERIC_INTERNAL_ERROR", False), ("CORRUPT_PAGE", False), ("DISK_IO_ERROR", True), ("PAGE_NOT_CACHED", True), ("METADATA_PARSE_ERROR", False),
        ("SERVER_SHUTTING_DOWN", True), ("SENDFILE_ERROR", True), ("WRITE_ERROR", True), ("CODEC_ERROR", False),
    ),
    0x00020001: (("SERVER_OVERLOADED", True), ("CONNECTION_LIMIT", True)),
    0x00030001: (
        ("GCS_TRANSIENT_ERROR", True), ("GCS_PERMANENT_ERROR", False), ("GCS_TIMEOUT", True), ("GCS_RESPONSE_INVALID", True), ("CONNECTION_ERROR", True), ("MEMBERSHIP_ERROR", True),
    ),
}


# The code that a client is told for each kind of storage failure.
FAILURES = {
    "object store, transient": "GCS_TRANSIENT_ERROR",
    "object store, permanent": "GCS_PERMANENT_ERROR",
    "object store, timeout": "GCS_TIMEOUT",
    "disk": "DISK_IO_ERROR",
    "page assembly": "PAGE_NOT_CACHED",
    "response syntax": "GCS_RESPONSE_INVALID",
    "response length": "GCS_RESPONSE_INVALID",
    "connection": "CONNECTION_ERROR",
    "tls": "CONNECTION_ERROR",
    "serialization": "CODEC_ERROR",
    "metadata": "METADATA_PARSE_ERROR",
}


def rows() -> list[tuple[int, str, str, bool]]:
    """(code, name, type, retriable) of every error."""
    return [(first + k, name, TYPES[first >> 16], retry) for first, group in CODES.items() for k, (name, retry) in enumerate(group)]


def error_codes(spark: SparkSession) -> DataFrame:
    """``code, name, error_type, retriable``."""
    return spark.createDataFrame(rows(), "code int, name string, error_type string, retriable boolean")


def with_codes(failures: DataFrame, kind: str = "failure") -> DataFrame:
    """Rows with the ``name``, ``code`` and ``retriable`` of their kind of failure; unknown kinds are internal errors."""
    table = {r[1]: r for r in rows()}
    known = failures.sparkSession.createDataFrame([(f, *(table[n][i] for i in (1, 0, 3))) for f, n in FAILURES.items()], "_kind string, name string, code int, retriable boolean")
    out = failures.join(F.broadcast(known), F.col(kind) == F.col("_kind"), "left").drop("_kind")
    other = table["GENERIC_INTERNAL_ERROR"]
    return out.withColumns({"name": F.coalesce("name", F.lit(other[1])), "code": F.coalesce("code", F.lit(other[0])), "retriable": F.coalesce("retriable", F.lit(other[3]))})


def display(name: Column, code: Column) -> Column:
    """``NAME:0x%08X``."""
    return F.format_string("%s:0x%08X", name, code)


class EngineError(Exception):
    """An error with its code; ``retriable`` tells callers whether to try again."""

    def __init__(self, name: str, message: str):
        self.code, self.name, self.error_type, self.retriable = next(r for r in rows() if r[1] == name)
        super().__init__(f"{name}:0x{self.code:08X}: {message}")
