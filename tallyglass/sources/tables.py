"""Tables as temporary views, their keys, and their description as DDL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass
class KeyRegistry:
    """Primary and foreign keys, which Parquet does not hold. foreign: table -> [(columns, other table, its columns or None)]."""

    primary: dict[str, list[str]] = field(default_factory=dict)
    foreign: dict[str, list[tuple[list[str], str, list[str] | None]]] = field(default_factory=dict)


STAR = KeyRegistry(
    {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]},
    {
        "nation": [(["n_regionkey"], "region", ["r_regionkey"])],
        "customer": [(["c_nationkey"], "nation", ["n_nationkey"])],
        "supplier": [(["s_nationkey"], "nation", ["n_nationkey"])],
        "orders": [(["o_custkey"], "customer", ["c_custkey"])],
        "lineitem": [(["l_orderkey"], "orders", ["o_orderkey"]), (["l_partkey"], "part", ["p_partkey"]), (["l_suppkey"], "supplier", ["s_suppkey"])],
    },
)


def load(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Parquet tables of a folder, registered as temporary views."""
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names or TABLES}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def schema_dict(spark: SparkSession) -> dict[str, list[str]]:
    """Columns of each table and view of the current namespace, by sorted name."""
    return {name: spark.table(name).columns for name in sorted(t.name for t in spark.catalog.listTables())}


def schema_rows(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str]]:
    """(table, position, column, type) of all tables, sorted by table."""
    return [(name, k, f.name, f.dataType.simpleString()) for name in sorted(tables) for k, f in enumerate(tables[name].schema)]


def quoted(name: str) -> str:
    return name if name.isidentifier() else "`" + name.replace("`", "``") + "`"


def ddl(tables: dict[str, DataFrame], keys: KeyRegistry = STAR) -> str:
    """A CREATE TABLE statement for each table: columns with types, then primary and foreign keys."""
    blocks = []
    for name in sorted(tables):
        parts = [f"{quoted(f.name)} {f.dataType.simpleString().upper()}" for f in tables[name].schema]
        if own := keys.primary.get(name):
            parts.append(f"PRIMARY KEY ({', '.join(map(quoted, own))})")
        for columns, other, theirs in keys.foreign.get(name, []):
            target = f" ({', '.join(map(quoted, theirs))})" if theirs else ""
            parts.append(f"FOREIGN KEY ({', '.join(map(quoted, columns))}) REFERENCES {quoted(other)}{target}")
        blocks.append(f"CREATE TABLE {quoted(name)} (" + ", ".join(parts) + ");")
    return "\n\n".join(blocks)


def sample_rows(spark: SparkSession, table: str, n: int = 3) -> DataFrame:
    """Any n rows of a table."""
    return spark.table(quoted(table)).limit(n)
