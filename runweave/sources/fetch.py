"""Files behind URLs as rows: schemes choose how, tasks fetch."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rows


def _open(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read()


#: What fetches each scheme; a session may pass its own beside or instead of these.
READERS: dict[str, Callable[[str, float], bytes]] = {"http": _open, "https": _open, "ftp": _open}


def fetch(urls: DataFrame, column: str = "url", timeout: float = 60, readers: dict[str, Callable[[str, float], bytes]] | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """urls with content and error: the bytes behind each URL, or why there are none.

    Spark reads shared files itself (`file` and Hadoop schemes need no fetching); each row here is fetched by the task that holds
    it, so repartition a short list first. A retried task fetches again. A task holds about most_bytes of bodies, and one more.
    """
    known = {**READERS, **(readers or {})}
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in urls.schema) + ", _scheme string, content binary, error string"

    def one(url: str, scheme: str) -> tuple[bytes | None, str | None]:
        try:
            if scheme not in known:
                raise ValueError(f"nothing reads {scheme}")
            return known[scheme](url, timeout), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        return rows.in_slices(batches, ["content", "error"], lambda r: one(r[column], r["_scheme"]), most_bytes)

    return urls.withColumn("_scheme", scalars.url_scheme(F.col(column))).mapInPandas(run, schema).drop("_scheme")
