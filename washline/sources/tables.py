"""Typed scans of the input parquet tables.

Every read goes through ``Tables`` so a job only names the columns it uses; Catalyst
prunes the rest at the parquet scan and pushes filters into it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


class Tables:
    """Lazily opened parquet tables under one directory (one file or folder per table)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(f"unknown table {name!r}")
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.read("supplier")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")
