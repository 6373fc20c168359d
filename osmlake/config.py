"""Storage settings of tables."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TableConfig:
    """How a table is laid out: files by ranges of the key, rows sorted in each, bloom filters on the key.

    ``files``: of a whole table; by its size unless given.
    """

    files: int | None = None
    bloom_filter: bool = True
    bloom_filter_bytes: int | None = 1 << 20
    compression: str = "snappy"
    sorted_files: bool = True

    def writer_options(self, key: str) -> dict[str, str]:
        """Options of the Parquet writer."""
        blooms = {f"parquet.bloom.filter.enabled#{key}": "true"} if self.bloom_filter else {}
        if blooms and self.bloom_filter_bytes:
            blooms["parquet.bloom.filter.max.bytes"] = str(self.bloom_filter_bytes)
        return {"compression": self.compression, **blooms}


#: Files and bytes of bloom filter in a file, for small tests and for a planet's tables.
PRESETS = {
    "testing": (4, 131_072),
    "nodes": (2000, 8_388_608),
    "ways": (500, 1_048_576),
    "relations": (20, 262_144),
}


def preset(name: str, **changes) -> TableConfig:
    """The settings of that name in ``PRESETS``; ``changes``: fields to set otherwise."""
    files, blooms = PRESETS[name]
    return replace(TableConfig(files=files, bloom_filter_bytes=blooms), **changes)
