"""The session the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "tidewell", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Settings:
    """Settings from text (spark.tidewell.* of a session, or a dictionary), with defaults; every problem is reported at once.

    A value of white space counts as absent.
    """

    def __init__(self, values: dict[str, str]):
        self.values, self.problems = {k: v.strip() for k, v in values.items() if v and v.strip()}, []

    @classmethod
    def of(cls, spark: SparkSession, prefix: str = "spark.tidewell.") -> Settings:
        return cls({k[len(prefix) :]: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(prefix)})

    def _read(self, key: str, default, convert, kind: str):
        if key not in self.values:
            return default
        try:
            return convert(self.values[key])
        except ValueError:
            self.problems.append(f"{key} must be {kind}, got {self.values[key]!r}")
            return default

    def required(self, key: str) -> str:
        if key not in self.values:
            self.problems.append(f"{key} is required")
        return self.values.get(key, "")

    def text(self, key: str, default: str = "") -> str:
        return self.values.get(key, default)

    def number(self, key: str, default: int) -> int:
        return self._read(key, default, int, "a whole number")

    def flag(self, key: str, default: bool) -> bool:
        return self._read(key, default, _flag, "true or false")

    def seconds(self, key: str, default: float) -> float:
        return self._read(key, default, _seconds, "a duration such as 30s or 5m, not below 0")

    def one_of(self, key: str, default: str, *allowed: str) -> str:
        def chosen(value: str) -> str:
            if value.lower() not in allowed:
                raise ValueError(value)
            return value.lower()

        return self._read(key, default, chosen, "one of " + ", ".join(allowed))

    def names(self, key: str) -> list[str]:
        """A comma list; empty items don't count."""
        return [x.strip() for x in self.values.get(key, "").split(",") if x.strip()]

    def targets(self, key: str) -> dict[str, str]:
        """name=url pairs in a comma list; a name must come once, and a url be absolute."""
        out: dict[str, str] = {}
        for item in self.names(key):
            name, _, url = (x.strip() for x in item.partition("="))
            if not name or "://" not in url or name in out:
                self.problems.append(f"{key} must be name=url pairs with distinct names, got {item!r}")
            out[name] = url
        return out

    def check(self) -> None:
        if self.problems:
            raise ValueError("invalid configuration: " + "; ".join(self.problems))


def _flag(value: str) -> bool:
    if value.lower() not in ("1", "t", "true", "0", "f", "false"):
        raise ValueError(value)
    return value.lower() in ("1", "t", "true")


def _seconds(value: str) -> float:
    import re

    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", value)
    if not parts or "".join(a + b for a, b in parts) != value:
        raise ValueError(value)
    return sum(float(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[unit] for n, unit in parts)


def backing_table(spark: SparkSession, alias: str) -> str | None:
    """The one table that a view over a chunk index reads, null if there is no such name.

    A table of that name, or a view of several tables, is an error: writes would not know where to go.
    """
    if not spark.catalog.tableExists(alias):
        return None
    if spark.catalog.getTable(alias).tableType not in ("VIEW", "TEMPORARY"):
        raise ValueError(f"{alias} is a table, not a view")
    files = {f.rsplit("/", 1)[0] for f in spark.table(alias).inputFiles()}
    if len(files) > 1:
        raise ValueError(f"{alias} reads {len(files)} tables")
    return next(iter(files), None)


def ensure_index(spark: SparkSession, alias: str, ddl: str) -> str:
    """The table behind the view `alias`; both are made if the name is free."""
    if (found := backing_table(spark, alias)) is not None or spark.catalog.tableExists(alias):
        return found or alias
    spark.sql(f"CREATE TABLE {alias}_v1 ({ddl}) USING parquet")
    spark.sql(f"CREATE VIEW {alias} AS SELECT * FROM {alias}_v1")
    return f"{alias}_v1"
