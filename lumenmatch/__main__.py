"""Recognise scans of a Parquet file: python -m lumenmatch SCANS DICTIONARY PRINTINGS HASHES COLLECTION OUT [--write] [--remote FOLDER] [--database NAME].

With --write and a database the results go into its tables: the collection is upserted by a
batch id (the same scans again change nothing), review rows and fresh hashes are inserted where
they are absent, and each write is logged. Without one they go into folders under OUT.
"""

from __future__ import annotations

import argparse
import sys

from .common import require_rows, session
from .plans.recognition import log_only, recognise
from .plans.store import batch_id, store
from .schemas import create_tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumenmatch", description="Match scans to a dictionary and route them.")
    for name in ("scans", "dictionary", "printings", "hashes", "collection", "out"):
        p.add_argument(name, help=f"Parquet folder: {name}")
    p.add_argument("--write", action="store_true", help="write collection, attention and error rows; else only what was matched")
    p.add_argument("--remote", help="Parquet folder: freshly fetched hashes; those not stored yet are kept. Default: the stored ones")
    p.add_argument("--database", help="write into the tables of this database, made if absent")
    p.add_argument("--batch", help="id of this batch; default: a digest of the scans")
    a = p.parse_args(argv)
    spark = session()
    read = spark.read.parquet
    scans, hashes = require_rows(read(a.scans), "scans"), read(a.hashes)
    remote = read(a.remote) if a.remote else hashes
    found = recognise(scans, read(a.dictionary), read(a.printings), hashes, remote, read(a.collection))
    log_only(found).write.mode("overwrite").parquet(f"{a.out}/matches")
    if a.write and a.database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {a.database}")
        create_tables(spark, a.database)
        written = store(spark, found, a.database, a.batch or batch_id(scans))
        failed = {table: w.error for table, w in written.items() if not w.done}
        if failed:
            print("\n".join(f"{table}: {error}" for table, error in failed.items()), file=sys.stderr)
            return 1
    elif a.write:
        for name, rows in (("collection", found.collection), ("attention", found.attention), ("errors", found.errors)):
            rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
