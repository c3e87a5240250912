"""Column types of other databases as types of a target."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source base types and the target type they become. A target
# ending in "*" keeps the source's "(...)" part.
SPARK_TYPES = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int2": "SMALLINT",
    "int": "INT", "integer": "INT", "int4": "INT", "mediumint": "INT", "serial": "INT",
    "smallserial": "INT", "bigint": "BIGINT", "int8": "BIGINT", "bigserial": "BIGINT",
    "float": "FLOAT", "float4": "FLOAT", "real": "FLOAT", "double": "DOUBLE", "float8": "DOUBLE",
    "decimal": "DECIMAL*", "numeric": "DECIMAL*", "number": "DECIMAL*",
    "bool": "BOOLEAN", "boolean": "BOOLEAN", "bit": "BOOLEAN", "date": "DATE",
    "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP",
    "binary": "BINARY", "varbinary": "BINARY", "blob": "BINARY", "tinyblob": "BINARY",
    "mediumblob": "BINARY", "longblob": "BINARY", "bytea": "BINARY", "image": "BINARY",
}
POSTGRES_TYPES = {
    "int": "INTEGER", "integer": "INTEGER", "int4": "INTEGER", "mediumint": "INTEGER",
    "bigint": "BIGINT", "int8": "BIGINT", "smallint": "SMALLINT", "int2": "SMALLINT",
    "tinyint": "SMALLINT", "float": "REAL", "float4": "REAL", "real": "REAL",
    "double": "DOUBLE PRECISION", "float8": "DOUBLE PRECISION",
    "bool": "BOOLEAN", "boolean": "BOOLEAN", "bit": "BOOLEAN", "date": "DATE", "time": "TIME",
    "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP",
    "blob": "BYTEA", "tinyblob": "BYTEA", "mediumblob": "BYTEA", "longblob": "BYTEA",
    "binary": "BYTEA", "varbinary": "BYTEA", "image": "BYTEA", "bytea": "BYTEA",
    "json": "JSONB", "jsonb": "JSONB", "uuid": "UUID",
}
MYSQL_TYPES = {
    "int": "INT", "integer": "INT", "int4": "INT", "mediumint": "INT", "bigint": "BIGINT",
    "int8": "BIGINT", "smallint": "SMALLINT", "int2": "SMALLINT", "tinyint": "TINYINT",
    "serial": "BIGINT AUTO_INCREMENT", "bigserial": "BIGINT AUTO_INCREMENT",
    "smallserial": "BIGINT AUTO_INCREMENT", "float": "FLOAT", "float4": "FLOAT", "real": "FLOAT",
    "double": "DOUBLE", "float8": "DOUBLE", "bool": "TINYINT(1)", "boolean": "TINYINT(1)",
    "bit": "BIT", "date": "DATE", "time": "TIME", "datetime": "DATETIME", "timestamp": "DATETIME",
    "timestamptz": "DATETIME", "longtext": "LONGTEXT", "mediumtext": "MEDIUMTEXT",
    "longblob": "LONGBLOB", "mediumblob": "MEDIUMBLOB", "blob": "BLOB", "tinyblob": "BLOB",
    "binary": "BLOB", "varbinary": "BLOB", "image": "BLOB", "bytea": "BLOB",
    "json": "JSON", "jsonb": "JSON", "uuid": "VARCHAR(36)",
}
SQLSERVER_TYPES = {
    "int": "INT", "integer": "INT", "int4": "INT", "mediumint": "INT", "bigint": "BIGINT",
    "int8": "BIGINT", "smallint": "SMALLINT", "int2": "SMALLINT", "tinyint": "TINYINT",
    "serial": "INTEGER", "bigserial": "INTEGER", "smallserial": "INTEGER", "float": "FLOAT",
    "float4": "FLOAT", "real": "FLOAT", "double": "DOUBLE", "float8": "DOUBLE", "bool": "BIT",
    "boolean": "BIT", "bit": "BIT", "date": "DATE", "time": "TIME", "datetime": "DATETIME",
    "timestamp": "DATETIME2", "timestamptz": "DATETIME2", "longblob": "VARBINARY(MAX)",
    "mediumblob": "VARBINARY(MAX)", "blob": "VARBINARY(MAX)", "tinyblob": "VARBINARY(MAX)",
    "binary": "VARBINARY(MAX)", "varbinary": "VARBINARY(MAX)", "image": "VARBINARY(MAX)",
    "bytea": "BLOB", "uuid": "VARCHAR(36)",
}
OTHER_TYPES = {
    "int": "INTEGER", "integer": "INTEGER", "int4": "INTEGER", "mediumint": "INTEGER",
    "bigint": "BIGINT", "int8": "BIGINT", "smallint": "SMALLINT", "int2": "SMALLINT",
    "tinyint": "TINYINT", "serial": "INTEGER", "bigserial": "INTEGER", "smallserial": "INTEGER",
    "float": "FLOAT", "float4": "FLOAT", "real": "FLOAT", "double": "DOUBLE", "float8": "DOUBLE",
    "bool": "BOOLEAN", "boolean": "BOOLEAN", "bit": "BIT", "date": "DATE", "time": "TIME",
    "datetime": "DATETIME", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP",
    "longblob": "BLOB", "mediumblob": "BLOB", "blob": "BLOB", "tinyblob": "BLOB",
    "binary": "BLOB", "varbinary": "BLOB", "image": "BLOB", "bytea": "BLOB",
    "uuid": "VARCHAR(36)",
}
CLICKHOUSE_TYPES = {
    **OTHER_TYPES, "datetime": "DateTime64(6)", "timestamp": "DateTime64(6)",
    "timestamptz": "DateTime64(6)",
}
TARGETS = {
    "spark": SPARK_TYPES, "postgres": POSTGRES_TYPES, "mysql": MYSQL_TYPES,
    "sqlserver": SQLSERVER_TYPES, "clickhouse": CLICKHOUSE_TYPES, "other": OTHER_TYPES,
}
# Targets that keep the precision of a sized decimal.
SIZED_DECIMAL = ("postgres", "mysql", "sqlserver")


def column_type_map(source: Column, target: str = "spark") -> Column:
    """The target's type for a source type text such as ``Decimal(10,2)`` or
    ``bigint unsigned``."""
    low = F.lower(source)
    base = F.regexp_extract(low, r"^\s*([^\s(]+)", 1)
    tail = F.regexp_extract(low, r"(\(.*)$", 1)
    table = TARGETS[target]
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    hit = F.try_element_at(F.create_map(*pairs), base)
    hit = F.when(hit.endswith("*"), F.concat(F.rtrim(hit, F.lit("*")), tail)).otherwise(hit)
    if target == "spark":
        return F.coalesce(hit, F.lit("STRING"))
    sized = F.when(tail != "", tail)
    number = F.lit("NUMERIC")
    if target in SIZED_DECIMAL:
        number = F.when(sized.isNull(), number).otherwise(F.concat(F.lit("DECIMAL"), sized))
    word = "NVARCHAR" if target == "sqlserver" else "VARCHAR"
    text = F.when(sized.isNull(), "VARCHAR(255)").otherwise(F.concat(F.lit(word), sized))
    fixed = F.when(sized.isNull(), "CHAR(1)").otherwise(F.concat(F.lit("CHAR"), sized))
    if target == "postgres":
        serial = base.isin("serial", "bigserial", "smallserial")
        hit = F.when(serial, F.upper(source)).otherwise(hit)
    return (
        F.when(base.isin("decimal", "numeric", "number"), number)
        .when(base.isin("varchar", "nvarchar", "varchar2"), text)
        .when(base.isin("char", "nchar", "character"), fixed)
        .otherwise(F.coalesce(hit, F.lit("TEXT")))
    )
