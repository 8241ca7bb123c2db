"""Items and members kept in matching buckets of (mailbox, date), so that joining them moves neither.

The largest join of every report is that of items with the days their mailbox is a member. Both sides are
written once in `buckets` buckets by the hash of (mailboxid, orderdate), one file per bucket; a report that
combines items by mailbox and date and joins members then reads bucket by bucket, without an exchange. The date is part
of the key, so a mailbox with very many items spreads over all buckets; one mailbox on one date is what a bucket can't
split. Give a number of buckets at which a bucket of items fits a task (100 TB: some 200,000 of 500 MB).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import mailbox_zip_prefix
from .scope import members_of_all_reports

KEYS = ("mailboxid", "orderdate")


@dataclass(frozen=True)
class Colocated:
    """Bucketed tables: items as they are, and one row per member day with zip, copies and copies_all."""

    items: DataFrame
    members: DataFrame

    def kept_items(self, wanted: Column | None = None, cohort_all: bool = False) -> DataFrame:
        """Items of members on the days they are active, with `copies` and `zip`, by a join within buckets.

        `wanted` limits the items; `cohort_all` keeps members of cohort 'all' and counts its rows only.
        """
        items = self.items if wanted is None else self.items.filter(wanted)
        copies = F.col("copies_all") if cohort_all else F.col("copies")
        members = self.members.select(*KEYS, "zip", copies.alias("copies")).filter("copies > 0")
        return items.join(members, list(KEYS))


def write_buckets(frame: DataFrame, name: str, folder: str, buckets: int) -> DataFrame:
    """A frame as a bucketed table `name` of the catalogue, its files under `folder`."""
    dealt = frame.repartition(buckets, *KEYS)  # a task holds one bucket, so a bucket is one file
    writer = dealt.write.mode("overwrite").option("path", folder).bucketBy(buckets, *KEYS).sortBy(*KEYS)
    writer.saveAsTable(name)
    return frame.sparkSession.table(name)


def colocated(
    items: DataFrame,
    cohort: DataFrame,
    mailbox_zip: DataFrame,
    name: str,
    folder: str,
    buckets: int,
    zip_of: Column | None = None,
) -> Colocated:
    """Write both tables (`name`_items and `name`_members) and return them.

    `zip_of` turns a mailbox's `shiptozip` into its zip; by default its first five characters.
    """
    zip_of = mailbox_zip_prefix(F.col("shiptozip")) if zip_of is None else zip_of
    members = members_of_all_reports(cohort, mailbox_zip, zip_of)
    return Colocated(
        write_buckets(items, f"{name}_items", f"{folder}/items", buckets),
        write_buckets(members, f"{name}_members", f"{folder}/members", buckets),
    )
