"""Where inputs are: an ordered list of roots, searched through Hadoop's file system."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Catalog:
    """Finds files and folders under roots, the first root first; endings come before roots."""

    spark: SparkSession
    roots: list[str]
    templates: dict[str, str] = field(default_factory=dict)
    depth: int = 6

    def _list(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else [])

    def walk(self, root: str, depth: int | None = None):
        """(path, is a folder) of all below root, level by level."""
        level = [root]
        for _ in range(self.depth if depth is None else depth):
            found = [x for p in level for x in self._list(p)]
            yield from found
            level = [p for p, is_dir in found if is_dir]

    def file(self, stem: str, endings: tuple[str, ...] = (".parquet", ".csv"), contains: str = "") -> str:
        """The file stem + ending; a path must hold ``contains``, which keeps decoys out."""
        found = [p for root in self.roots for p, _ in self.walk(root) if contains in p]
        for ending in endings:
            for p in found:
                if p.rsplit("/", 1)[-1] == stem + ending:
                    return p
        raise FileNotFoundError(f"no {stem} with {', '.join(endings)} under {', '.join(self.roots)}")

    def folder(self, marker: str) -> str:
        """The first folder that holds an entry of the marker's name."""
        for root in self.roots:
            for p, _ in self.walk(root):
                if p.rsplit("/", 1)[-1] == marker:
                    return p.rsplit("/", 1)[0]
        raise FileNotFoundError(f"no folder with {marker} under {', '.join(self.roots)}")

    def named(self, name: str, **values) -> str:
        """A template's path, such as "rosters/{year}.csv", under the first root that has it."""
        tail = self.templates[name].format(**values)
        head, _, last = tail.rpartition("/")
        for root in self.roots:
            if any(p.rsplit("/", 1)[-1] == last for p, _ in self._list(f"{root}/{head}".rstrip("/"))):
                return f"{root}/{tail}"
        raise FileNotFoundError(f"no {tail} under {', '.join(self.roots)}")

    def describe(self):
        """(root, entries, name, template) of what there is, as a table."""
        rows = [(r, len(self._list(r)), None, None) for r in self.roots] + [(None, None, k, v) for k, v in sorted(self.templates.items())]
        return self.spark.createDataFrame(rows, "root string, entries int, name string, template string")

    def built(self, path: str) -> bool:
        """Whether a table was written there to its end."""
        return any(p.endswith("/_SUCCESS") for p, _ in self._list(path))
