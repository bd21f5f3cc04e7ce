"""The façade: one object for scans, ranges, metadata and placement."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from prunescan.functions.errors import EngineError
from prunescan.operators import ring
from prunescan.plans.predicate import Predicate, from_json
from prunescan.plans.scan import batch_scan, scan
from prunescan.sources import footer, ranges


@dataclass(frozen=True)
class Settings:
    """Defaults of an engine."""

    page_size: int = 4 << 20
    vnodes: int = 150
    metadata_ttl_seconds: int = 300
    nodes: tuple[str, ...] = field(default_factory=tuple)


class Engine:
    """Queries over Parquet files. A predicate may be given as a tree or as its JSON."""

    def __init__(self, spark: SparkSession, settings: Settings = Settings()):
        self.spark, self.settings = spark, settings

    @staticmethod
    def _predicate(p: Predicate | str | None) -> Predicate | None:
        if not isinstance(p, str):
            return p
        try:
            return from_json(p)
        except (ValueError, KeyError, TypeError) as e:
            raise EngineError("INVALID_REQUEST", str(e)) from e

    def scan(self, uri: str | list[str], predicate: Predicate | str | None = None, projection: list[str] | None = None, mode: str = "exact") -> DataFrame:
        """Rows of files; see ``plans.scan.scan``."""
        return scan(self.spark, uri, self._predicate(predicate), projection, mode)

    def batch_scan(self, requests: list[tuple], mode: str = "exact") -> DataFrame:
        """Several scans at once, told apart by ``scan_id``."""
        return batch_scan(self.spark, [(u, self._predicate(p), c) for u, p, c in requests], mode)

    def read_range(self, uri: str, offset: int = 0, length: int | None = None) -> DataFrame:
        """Bytes of a file."""
        return ranges.read_range(self.spark, uri, offset, length)

    def batch_read(self, requests: DataFrame) -> DataFrame:
        """Bytes of many ranges (``ord, uri, offset, length``)."""
        return ranges.read_ranges(requests)

    def metadata(self, uris: list[str]) -> DataFrame:
        """Sizes of files and their footers."""
        return footer.files(footer.footers(self.spark, uris))

    def row_groups(self, uris: list[str]) -> DataFrame:
        """Row groups with ranges and statistics."""
        return footer.row_groups(footer.footers(self.spark, uris))

    def owners(self, keys: DataFrame, key: str) -> DataFrame:
        """Node in charge of each key, by the settings' nodes."""
        return ring.owners(keys, ring.build_ring(self.spark, list(self.settings.nodes), self.settings.vnodes), key)
