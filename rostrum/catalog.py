"""Read-only SQL over named tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(ValueError):
    pass


class Catalog:
    """Tables by name as views of a session of its own; only one SELECT or WITH statement is accepted."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]) -> None:
        self.spark = spark
        self.tables = tables

    def read(self, sql: str, args: list | None = None) -> DataFrame:
        bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
        if not re.match(r"(?i)(select|with|values|from)\b", bare) or ";" in re.sub(r"'(?:[^']|'')*'", "", bare):
            raise NotReadOnly("one SELECT statement is accepted")
        if re.search(r"(?i)\b(insert|merge|delete|update|drop|create|alter|truncate)\s+(into|overwrite|from|table|view|or|database|schema|\w+\s+set)\b", re.sub(r"'(?:[^']|'')*'", "", bare)):
            raise NotReadOnly("only reading is accepted")
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(bare, args=args)

    def scalar(self, sql: str, args: list | None = None) -> object:
        """The first cell, or None."""
        row = self.read(sql, args).first()
        return row[0] if row else None
