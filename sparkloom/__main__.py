"""``python -m sparkloom COMMAND FOLDER``: checks and copies of a folder of Parquet tables."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .session import EngineSession
from .sources import read_table, write_table


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    parser.add_argument("command", choices=["integrity-check", "analyze", "schema-dump", "vacuum", "backup", "restore", "query"])
    parser.add_argument("folder", help="a folder of <table>.parquet")
    parser.add_argument("target", nargs="?", help="the copy's folder, or the text of a query")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("sparkloom").getOrCreate()
    source = given.target if given.command == "restore" else given.folder
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = tuple(sorted(s.getPath().getName()[: -len(".parquet")] for s in found if s.getPath().getName().endswith(".parquet")))
    session = EngineSession(spark, read_only=True)
    session.load_dir(source, names)
    if given.command == "integrity-check":
        print(*session.integrity_check(), sep=os.linesep)
        return int(session.integrity_check() != ["ok"])
    if given.command == "analyze":
        session.exec("ANALYZE").returned.show(1000, truncate=False)
    elif given.command == "schema-dump":
        print(*(f"{line};" for line in session.schema_dump()), sep=os.linesep)
    elif given.command == "query":
        session.sql(given.target).show(1000, truncate=False)
    elif given.command == "backup":
        session.backup(given.target)
    elif given.command == "restore":
        session.backup(given.folder)
    else:  # vacuum: fewer files, written beside and then put in place
        for name in names:
            rows = read_table(spark, f"{given.folder}/{name}.parquet")
            write_table(rows.coalesce(max(1, rows.rdd.getNumPartitions() // 4)), f"{given.folder}/{name}.parquet.new", mode="overwrite")
            fs, old, new = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *(spark._jvm.org.apache.hadoop.fs.Path(f"{given.folder}/{name}.parquet{x}") for x in ("", ".new"))
            fs.delete(old, True)
            fs.rename(new, old)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
