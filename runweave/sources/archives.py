"""Members of zip archives as rows, and rows as archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_zip(spark: SparkSession, path: str, members: str | None = None) -> DataFrame:
    """members_of() the archives that path names."""
    return members_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"), members)


def members_of(archives: DataFrame, members: str | None = None, most_bytes: int = 16 << 20) -> DataFrame:
    """archive, member and content of each file in the zip files (archive, content); members is a pattern on their names.

    Archives spread over tasks; members leave whenever their contents reach most_bytes, so a task holds one archive, about so many
    bytes, and one member more.
    """

    def run(batches):
        import re

        frame = lambda archive, part: pd.DataFrame({"archive": archive, "member": [n for n, _ in part], "content": [c for _, c in part]})
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    part, size = [], 0
                    for name in z.namelist():
                        if not name.endswith("/") and (members is None or re.search(members, name)):
                            part.append((name, z.read(name)))
                            size += len(part[-1][1])
                            if size >= most_bytes:
                                yield frame(archive, part)
                                part, size = [], 0
                    if part:
                        yield frame(archive, part)

    return archives.select("archive", "content").mapInPandas(run, "archive string, member string, content binary")


def to_zips(rows: DataFrame, most_members: int = 1000) -> DataFrame:
    """archive, part and content: the rows (archive, member, content) as zip files of at most most_members members.

    An archive's members are dealt over parts by their names' hash, so one large archive does not meet in one task; a part that
    has more than most_members then falls into several, by the members' order. A part is one task's, and in memory once.
    """
    sizes = rows.groupBy("archive").agg(F.ceil(2 * F.count("*") / most_members).alias("parts"))
    dealt = rows.join(sizes, "archive").withColumn("bin", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    place = F.row_number().over(Window.partitionBy("archive", "bin").orderBy("member")) - 1
    dealt = dealt.withColumn("piece", F.floor(place / most_members).cast("int"))
    # numbers without gaps: the pieces before a bin's are those of lesser bins
    counts = dealt.groupBy("archive", "bin").agg((F.max("piece") + 1).alias("own"))
    before = F.sum("own").over(Window.partitionBy("archive").orderBy("bin")) - F.col("own")
    dealt = dealt.join(counts.select("archive", "bin", before.alias("before")), ["archive", "bin"]).withColumn("part", (F.col("before") + F.col("piece")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(pdf["member"], pdf["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({"archive": [pdf["archive"].iloc[0]], "part": [pdf["part"].iloc[0]], "content": [out.getvalue()]})

    return dealt.select("archive", "part", "member", "content").groupBy("archive", "part").applyInPandas(run, "archive string, part int, content binary")
