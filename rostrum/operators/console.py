"""What a console asks for: docket search, agency lists, one comment in full, exports, and one stage at a time."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEARCH, LOG = 25, 400


class NoDocket(ValueError):
    """No docket was named."""


class NotReady(RuntimeError):
    """The docket has no analysed units yet."""


def search(dockets: DataFrame, term: str, limit: int = SEARCH) -> DataFrame:
    """Dockets whose title holds the term in any case, newest first."""
    found = dockets.where(F.contains(F.lower("title"), F.lit(term.lower())))
    return found.orderBy(F.desc("modified"), "docket_id").limit(limit)


def agencies(listed: DataFrame) -> DataFrame:
    """slug and name in order of name; entries that lack either are dropped."""
    full = (F.coalesce("slug", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    return listed.where(full).select("slug", "name").distinct().orderBy("name", "slug")


def comment_detail(units: DataFrame, dedup: DataFrame, comment_id: object, responses: DataFrame | None = None) -> DataFrame:
    """One comment's row with the size of its campaign and, if `responses` are given, the paragraphs of its response.

    The members of its campaign with words of their own are those of `campaigns.siblings`.
    """
    own = units.where(F.col("comment_id") == F.lit(comment_id))
    sizes = dedup.where("campaign_id is not null").groupBy("docket_id", "campaign_id").agg(F.count(F.lit(1)).alias("campaign_size"))
    found = own.join(sizes, ["docket_id", "campaign_id"], "left").withColumn("campaign_size", F.coalesce("campaign_size", F.lit(1)))
    return found if responses is None else found.join(responses.select("response_id", "comment_para", "response_para"), "response_id", "left")


def export(ledger: DataFrame, docket_id: str | None) -> DataFrame:
    """The ledger of one docket, whole."""
    if not docket_id:
        raise NoDocket("name a docket")
    rows = ledger.where(F.col("docket_id") == docket_id)
    if rows.limit(1).count() == 0:
        raise NotReady(f"{docket_id} has no analysed units")
    return rows.orderBy("place")


class Runner:
    """Runs one stage at a time in the background and keeps its last lines."""

    def __init__(self) -> None:
        self.lines: deque[str] = deque(maxlen=LOG)
        self._busy = threading.Lock()
        self._thread: threading.Thread | None = None

    def start(self, name: str, stage: Callable[[Callable[[str], None]], object]) -> bool:
        """False if a stage is running already."""
        if not self._busy.acquire(blocking=False):
            return False

        def work() -> None:
            try:
                self.lines.append(f"{name}: started")
                stage(self.lines.append)
                self.lines.append(f"{name}: done")
            except Exception as e:  # a stage's failure is told in the log
                self.lines.append(f"{name}: {type(e).__name__}: {e}")
            finally:
                self._busy.release()

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()
        return True

    def wait(self) -> None:
        if self._thread:
            self._thread.join()
